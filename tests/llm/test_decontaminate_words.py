"""Words of many texts cut at once, against a regular expression over one text after the other."""

import random
import re
import time

import pandas as pd
import pytest

pytest.importorskip("quarry.llm.queries")

from quarry.llm import decontaminate  # noqa: E402

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:;\"\n()\[\]“”„«»…]")


def plain(text):
    """``word, starts, slot, open slot`` of a text, token by token."""
    out, start, number = [], True, False
    for t in TOKEN.findall(text):
        num, low = t[0].isdigit(), t.lower()
        if not num and not t[0].isalpha():
            start = True
            continue
        cap = not num and t[0] != low[0] and len(t) > 1
        unit = number and low in decontaminate.UNITS
        out.append((low, start, num or unit or (cap and not start), num or unit or cap))
        start, number = False, num
    return out


def test_words_of_texts_read_together():
    rng = random.Random(3)
    letters = list("aAbZéÉßẞİΣσς123.,;:\n ()½²٣Ⅷ_-\0\"…«ǅ漢क्\U0001d7d8\U00010400")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["3", "km", "it is 3 km, 1.5 Hours or 1,2.3;4 KM. km 3", "", "ΟΔΟΣ οδος"]
    words, number, back = decontaminate.Words(texts), {}, {}
    want = [(i, *w) for i, t in enumerate(texts) for w in plain(t)]
    got = list(zip(words.text.tolist(), words.raw.tolist(), words.starts.tolist(), words.slot.tolist(), words.open_slot.tolist(), strict=True))
    assert [(a[0], *a[2:]) for a in got] == [(b[0], *b[2:]) for b in want]
    assert all(number.setdefault(b[1], a[1]) == a[1] and back.setdefault(a[1], b[1]) == b[1] for a, b in zip(got, want, strict=True))


def test_windows_stay_in_their_text():
    """As many windows as the texts have one by one, the same hashes, and parts of a batch keep every row."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Anna", "has", "3", "km", "to", "go", ".", "home", "then"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    for size in (2, 5, 8):
        together = [k for _, keys in decontaminate.Words(texts).keys(size) for k in keys.tolist()]
        alone = [k for t in texts for _, keys in decontaminate.Words([t]).keys(size) for k in keys.tolist()]
        assert sorted(together) == sorted(alone) != []
    rows = pd.DataFrame({"_text": ["x" * n for n in (0, decontaminate.TOGETHER, 3, 0, 2 * decontaminate.TOGETHER, 5, 0)]})
    assert pd.concat(list(decontaminate._together(rows)))["_text"].tolist() == rows["_text"].tolist()


def test_reading_costs_less_than_half_of_a_pass_token_by_token():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "Word", "12.5", "km", "and,", "runs."]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(400)) for _ in range(600)]
    decontaminate.Words(texts[:1])  # the table of characters is made once

    def seconds(f):
        best = []
        for _ in range(3):
            t = time.process_time()
            f()
            best.append(time.process_time() - t)
        return min(best)

    memo = {}
    one_by_one = seconds(lambda: [[memo.setdefault(w, len(memo)) for w in TOKEN.findall(t)] for t in texts])
    assert seconds(lambda: [decontaminate.Words(p["_text"].tolist()) for p in decontaminate._together(pd.DataFrame({"_text": texts}))]) < one_by_one / 2
