"""Hidden parts of pages, words in attributes that hide nothing, and layouts without names."""

import pytest

pytest.importorskip("quarry.llm.queries")

from quarry.llm.html_extract import is_hidden, leaf_blocks, main_text, trained_crf  # noqa: E402

SENTENCE = "The river was high that year, and the bridges were closed for weeks."


def article(inner):
    return f'<html><body><nav><a href="/">Home</a></nav><article><h1>A title</h1><p>{inner}</p><p>{SENTENCE}</p></article><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    "inner,want",
    [
        ('See <a href="/x" title="The hidden truth">a link</a> there.', "See a link there."),
        ('See <a href="/hidden/x">words</a> there.', "See words there."),
        ('See <span class="overflow-hidden">words</span> there.', "See words there."),
        ("See <span data-hidden=true>words</span> there.", "See words there."),
        ('See <span style="display: inline; --x: none">words</span> there.', "See words there."),
        ("See <span hidden>not these</span> words.", "See words."),
        ('See <b aria-hidden="true">not <b>these</b> here</b> words.', "See words."),
        ('See <i style="color:red;display:none">not</i> words.', "See words."),
        ("See <button>Press</button> words.", "See words."),
        ("See <svg><text>x</text></svg>words.", "See words."),
    ],
)
def test_only_hiding_attributes_hide(inner, want):
    assert main_text(article(inner), trained_crf()) == f"A title\n{want}\n{SENTENCE}"


def test_hidden_elements_with_blocks_inside():
    crf = trained_crf()
    assert main_text(article(f"x</p><div hidden><p>{SENTENCE} No.</p></div><p>{SENTENCE}"), crf).count("No.") == 0
    page = f"<article><p>{SENTENCE}</p><div><span hidden>AAA<div>{SENTENCE} No.</div></span></div><p>{SENTENCE}</p></article>"
    assert main_text(page, crf) == f"{SENTENCE}\n{SENTENCE}"
    # a hidden inline element without an end ends with its block
    page = f"<article><p>One <span hidden>two</p><p>{SENTENCE}</p></article>"
    assert [b.text for b in leaf_blocks(page)] == ["One", SENTENCE]


def test_names_and_values_are_told_apart():
    assert is_hidden(" hidden") and is_hidden(' id=x hidden=""') and is_hidden(" aria-hidden='true'") and is_hidden(' style="display:none"') and is_hidden(" HIDDEN")
    assert not is_hidden(' title="hidden"') and not is_hidden(" aria-hidden=false") and not is_hidden(' class="hidden"') and not is_hidden(' style="background:none"')


def test_a_page_of_plain_elements():
    page = "<html><body>" + "".join(f"<div><p>{SENTENCE}</p></div>" for _ in range(3)) + "</body></html>"
    assert main_text(page, trained_crf()) == "\n".join([SENTENCE] * 3)
