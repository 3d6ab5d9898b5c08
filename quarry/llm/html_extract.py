"""Main text of web pages by a linear-chain CRF over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches

#: Elements inside a block of text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that have no end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = "script|style|noscript|template|textarea|select|svg|iframe|object|title|head|button"
#: An open one of these is closed by a new one of the same list.
CLOSES = {"p": set("p h1 h2 h3 h4 h5 h6 div ul ol table article section header footer nav aside form pre blockquote figure main address".split()), "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Hints in class, id and role names, by kind.
HINTS = {
    "menu": "nav menu breadcrumb pagination pager tabs toolbar navbar skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer copyright bottom legal colophon",
    "side": "sidebar side aside widget related recommended trending popular archive tagcloud tags toc",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot adbox",
    "notice": "cookie notice consent gdpr alert popup modal newsletter subscribe overlay paywall disclaimer",
    "form": "form search login signup register contact input",
    "comment": "comment comments respond reply replies disqus discussion responses reviews",
    "share": "share social sharing follow tools meta byline",
    "main": "article post content main story entry body text",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>?", re.I) for name in HIDDEN.split("|")}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_ONE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAYBE_GONE = re.compile("hidden|none", re.I)
_STYLE_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:;|!|$)", re.I)


@dataclass
class Block:
    """Text of a leaf block, its tag, the tags and hints it stands in, and its letters in links."""

    text: str
    tag: str
    tags: frozenset[str]
    hints: frozenset[str]
    linked: int


def is_hidden(attrs: str) -> bool:
    """Whether an element's attributes hide it: ``hidden``, ``aria-hidden="true"``, or such a ``style``.

    Names and values are told apart, so a title, an address or a class with such a word hides nothing.
    """
    if not _MAYBE_GONE.search(attrs):
        return False
    for m in _ONE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _STYLE_GONE.search(value)):
            return True
    return False


def _hints(attrs: str) -> frozenset[str]:
    found = set()
    for m in _ATTR.finditer(attrs):
        for w in _NAME.findall((m[1] or m[2] or m[3] or "").lower()):
            if w in _HINT:
                found.add(_HINT[w])
    return frozenset(found)


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; white space inside is one space.

    Hidden elements have no blocks, whatever they hold; a hidden inline element ends
    with its end tag, or with the block element that it was opened in. Elements
    that show no text (scripts, buttons, pictures) do not end a block.
    """
    page = page or ""
    # each open element holds what it and its ancestors add up to, so that depth costs nothing
    stack: list[tuple[str, frozenset[str], frozenset[str], bool]] = []
    still_open: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    muted, mutes, within = "", 0, 0  # a hidden inline element, how many of its name are open, and in how many blocks it lies

    def flush() -> None:
        nonlocal linked
        if parts:
            name, tags, hints, hidden = stack[-1] if stack else ("", frozenset(), frozenset(), False)
            if not hidden and (text := " ".join(html.unescape("".join(parts)).split())):
                out.append(Block(text, name, tags, hints, linked))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not mutes:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is not None:
            text(m[1])
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if mutes:
                mutes += (name == muted) * (-1 if m[2] else 1)
                continue
            if not m[2] and name not in VOID and m[4] and is_hidden(m[4]) and not m[4].rstrip().endswith("/"):
                muted, mutes, within = name, 1, len(stack)
            if name == "a":
                links = max(0, links - 1) if m[2] else links + 1
            elif name in ("br", "wbr", "img"):
                text(" ")
            continue
        if name in _RAW_END and name != "head":  # the elements of a head are skipped one by one: its end tag may be missing
            if not m[2] and not m[4].rstrip().endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        flush()
        links = 0
        if m[2]:
            while still_open[name]:
                still_open[stack[-1][0]] -= 1
                if stack.pop()[0] == name:
                    break
            mutes = 0 if len(stack) < within else mutes
            continue
        if name == "head":
            continue
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        while stack and stack[-1][0] in CLOSES and name in CLOSES[stack[-1][0]]:
            still_open[stack.pop()[0]] -= 1
        mutes = 0 if len(stack) < within else mutes
        attrs = m[4]
        _, tags, hints, hidden = stack[-1] if stack else ("", frozenset(), frozenset(), False)
        own = _hints(attrs) if attrs else frozenset()
        gone = hidden or bool(attrs and is_hidden(attrs))
        stack.append((name, tags if name in tags else tags | {name}, hints if own <= hints else hints | own, gone))
        still_open[name] += 1
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block: its tags, hints, text and place."""
    out = []
    for k, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        dense = b.linked / max(n, 1)
        f = ["bias", f"tag={b.tag}", *(f"in={t}" for t in b.tags), *(f"hint={h}" for h in b.hints)]
        f.append("words=" + ("1" if words == 1 else "2-4" if words < 5 else "5-9" if words < 10 else "10-29" if words < 30 else "30+"))
        f.append("links=" + ("0" if not dense else "some" if dense < 0.4 else "most"))
        f.append("stop" if b.text[-1] in ".!?…\"”»" else "open")
        f.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inner")
        if "©" in b.text or re.search(r"(?i)\b(?:cookies?|all rights reserved|subscribe|newsletter|advertisement|log ?in|sign up)\b", b.text):
            f.append("notice words")
        out.append(f)
    return out


@dataclass
class Crf:
    """Weights per feature and label (0 other, 1 main text) and between neighbours."""

    index: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), 2))
        for k, f in enumerate(feats):
            out[k] = self.unary[[self.index[x] for x in f if x in self.index]].sum(axis=0)
        return out

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Labels of the best path (Viterbi)."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        best, back = s[0], []
        for a, b in s[1:]:
            x, y = best[0] + p00, best[1] + p10
            u, w = best[0] + p01, best[1] + p11
            back.append((int(y > x), int(w > u)))
            best = [max(x, y) + a, max(u, w) + b]
        path = [int(best[1] > best[0])]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train_crf(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.2, penalty: float = 0.02) -> Crf:
    """Maximum likelihood by forward-backward over all pages at once, with Adam."""
    index = {f: i for i, f in enumerate(sorted({f for feats, _ in pages for block in feats for f in block}))}
    longest, n = max(len(y) for _, y in pages), len(pages)
    x = np.zeros((n, longest, len(index)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (feats, labels) in enumerate(pages):
        mask[i, : len(labels)], y[i, : len(labels)] = True, labels
        for k, f in enumerate(feats):
            x[i, k, [index[w] for w in f]] = 1
    unary, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
    gold = np.stack([y == 0, y == 1], axis=2) & mask[:, :, None]
    gold_pair = np.einsum("nka,nkb->ab", gold[:, :-1].astype(float), gold[:, 1:].astype(float))
    flat, state = x.reshape(-1, len(index)), [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, rounds + 1):
        s = (flat @ unary).reshape(n, longest, 2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = s[:, 0]
        for k in range(1, longest):
            nxt = s[:, k] + np.logaddexp(ahead[:, k - 1, 0, None] + pair[0], ahead[:, k - 1, 1, None] + pair[1])
            ahead[:, k] = np.where(mask[:, k, None], nxt, ahead[:, k - 1])
        behind = np.zeros((n, longest, 2))
        for k in range(longest - 2, -1, -1):
            v = s[:, k + 1] + behind[:, k + 1]
            nxt = np.logaddexp(v[:, 0, None] + pair[:, 0], v[:, 1, None] + pair[:, 1])
            behind[:, k] = np.where(mask[:, k + 1, None], nxt, 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        node = np.exp(ahead + behind - z) * mask[:, :, None]
        edge = np.exp(ahead[:, :-1, :, None] + pair + (s + behind)[:, 1:, None, :] - z[..., None]) * mask[:, 1:, None, None]
        grads = (flat.T @ (node - gold).reshape(-1, 2) / n + penalty * unary / n, (edge.sum(axis=(0, 1)) - gold_pair) / n + penalty * pair / n)
        for k, (w, g) in enumerate(zip((unary, pair), grads, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Crf(index, unary, pair)


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, str]]:
    """Made pages with their main text: layouts of the usual kinds, to train on."""
    rng = random.Random(seed)
    vowels, tails = "aeiouy", "nrstlmdkbp"
    word = lambda: "".join(rng.choice(tails) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: phrase(1, 25).capitalize() + rng.choice([".", ".", ".", "!", "?", "***", ","])
    para = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 7])))
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'

    def listing() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"

    def shell(kind: str) -> str:
        body = {"nav": listing, "head": lambda: f"<div>{phrase(1, 4)}</div>" + rng.choice(["", listing()]), "foot": lambda: rng.choice([f"&copy; {word()}.com &middot; {para()}", f"<p>{para()}</p>", listing()]), "side": lambda: f"<h3>{phrase(1, 3)}</h3>" + rng.choice([listing(), f"<p>{para()}</p>"]), "ad": para, "notice": lambda: f"<p>{para()}</p>", "form": lambda: f"<label>{phrase(1, 3)}</label><input type=text><p>{phrase(2, 9)}</p>", "comments": lambda: f"<h3>{phrase(1, 2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><p>{para()}</p></div>' for _ in range(rng.randint(1, 4))), "share": lambda: f"<span>{phrase(1, 3)}</span> {link()}"}[kind]()
        tags = {"nav": ["nav", 'div class="menu"', 'ul class="nav"', 'nav role="navigation"', 'div id="breadcrumb"'], "head": ["header", 'div id="header"', 'div class="masthead"'], "foot": ["footer", 'div id="footer"', 'div class="copyright"'], "side": ["aside", 'div class="sidebar"', 'div id="related"', 'section class="widget"'], "ad": ['div class="ad"', 'div class="advert"', 'div id="ads-top"', 'p class="sponsored"', 'aside class="promo"'], "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="newsletter"', 'div role="alert"'], "form": ["form", 'form class="search"', 'div class="login-form"'], "comments": ['section id="comments"', 'div class="comments"', 'ol class="comment-list"', 'div id="disqus"'], "share": ['div class="share"', 'div class="social"']}[kind]
        tag = rng.choice(tags)
        return f"<{tag}>{body}</{tag.split()[0]}>"

    out = []
    for _ in range(n):
        blocks, markup = [], ""
        for k in range(rng.choice([1, 2, 3, 6, 12])):
            p = phrase(2, 9).capitalize() if k == 0 and rng.random() < 0.7 else para() if rng.random() < 0.9 else phrase(1, 8)
            tag = rng.choice(["h1", "h1", "h2"]) if k == 0 and p[-1] not in ".!?*," else rng.choice(["p"] * 8 + ["h2", "h3", "li", "blockquote", "pre", "td", "div"])
            inner = p if rng.random() < 0.7 else f"<b>{p}" if tag == "p" else f"<em>{p}</em>"
            if rng.random() < 0.15:
                inner += " " + link()
                p += " " + re.sub("<[^>]*>", "", inner.rsplit(" <a", 1)[1].split(">", 1)[1])
            wrap = {"li": ("<ul><li>", "</li></ul>"), "td": ("<table><tr><td>", "</td></tr></table>")}.get(tag, (f"<{tag}>", f"</{tag}>" if rng.random() < 0.9 or tag != "p" else ""))
            markup += wrap[0] + inner + wrap[1]
            blocks.append(p)
            if rng.random() < 0.06:
                markup += shell(rng.choice(["ad", "share", "side", "form", "notice"]))
        main = rng.choice(["article"] * 4 + ["main", 'div class="content"', 'div class="post"', 'div id="story"', 'section class="article-body"', "div", "div", 'div class="row"'])
        before = "".join(shell(k) for k in rng.choices(["nav", "head", "ad", "notice", "side", "form"], k=rng.randint(0, 4)))
        after = "".join(shell(k) for k in rng.choices(["foot", "foot", "side", "comments", "share", "ad", "nav", "form"], k=rng.randint(0, 4)))
        inside = shell("comments") if rng.random() < 0.1 else ""
        out.append((f"<html><head><title>{phrase(2, 6)}</title></head><body>{before}<{main}>{markup}{inside}</{main.split()[0]}>{after}</body></html>", "\n".join(blocks)))
    return out


def label_blocks(blocks: list[Block], main: str) -> list[int]:
    """1 for the blocks that make up the main text, taken in order."""
    want, k, out = main.split("\n"), 0, []
    for b in blocks:
        hit = k < len(want) and b.text == " ".join(want[k].split())
        k += hit
        out.append(int(hit))
    return out


_TRAINED: dict[str, Crf] = {}


def trained_crf() -> Crf:
    """The model of the made pages; the same wherever it is trained."""
    if "crf" not in _TRAINED:
        data = []
        for page, main in labelled_pages():
            blocks = leaf_blocks(page)
            if blocks:
                data.append((features(blocks), label_blocks(blocks, main)))
        _TRAINED["crf"] = train_crf(data)
    return _TRAINED["crf"]


def main_text(page: str | None, crf: Crf) -> str:
    """The main text of a page: its blocks of label 1, joined by line ends."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(features(blocks)), strict=True) if y)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crf: Crf | None = None) -> DataFrame:
    """``id, url, text, n_chars`` of every page.

    The page is cut into leaf blocks (block elements; inline ones and line
    breaks stay inside), each described by its ancestors' tags and names and by
    its text, and the chain of blocks is labelled by the conditional random
    field. Scripts, styles, comments and titles are no text.

    Defined results: a null or empty page, or one without main text, has the
    empty text. Unclosed and stray tags, quotes and entities are read as a
    browser would, roughly, and never fail. Repeated rows are treated one by
    one; an empty table gives no rows; other columns are ignored whatever their
    names. Pages are read whole; the work is linear in a page's length, however
    deep its elements nest.
    """
    bound_batches(pages.sparkSession)
    model = crf or trained_crf()
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b["_html"]]
            yield pd.DataFrame({id_col: b["_id"], url_col: b["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).mapInPandas(run, schema)
