"""Benchmark decontamination by canonical templates and consistent slots."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, materialize, packed_row, unpacked_row

#: Words of a template window; a shorter item is one window.
WINDOW = 8
#: Words of a window that must not be placeholders for it to match as a template.
LITERALS = 4
#: So many words in a row, or this share of an item, make a leak.
RUN, SHARE = 13, 0.6
#: Items of fewer words match only where they stand between marks or line ends.
SHORT = 5
#: Bits of the filter of window hashes: so many for each window, within these powers of two (128 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 30
#: Texts known to leak that are broadcast at most (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Unit words that are placeholders after a number.
UNITS = set("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents meter meters metre metres mile miles gram grams liter liters litre litres percent degree degrees watt watts volt volts".split())
_MARKS = ".!?:;\"\n()[]“”„«»…"
#: Kinds of characters: parts of numbers, marks and parts of words, and what a token is that begins with them.
_DIGIT, _MARK, _LETTER, _NUM, _CAP, _PUNCT = 1, 2, 4, 8, 16, 32
#: Characters that are read in one go (a longer text is read whole).
TOGETHER = 1 << 18
_SLOTS = np.array([xxhash.xxh64_intdigest(s) for s in ("<num>", "<name>", "<unit>")], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PROBES = tuple(np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point, and its hash without regard to case."""
    kind, low = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(1, sys.maxunicode + 2, dtype=np.uint64)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isdecimal():
            kind[c] = _DIGIT | _NUM
        elif s.isalnum():
            small = s.lower()
            kind[c] = _LETTER | (_NUM if s.isdigit() else _PUNCT if not s.isalpha() else _CAP * (s != small[0]))
            if len(small) == 1:
                low[c] = ord(small) + 1
        elif s in _MARKS:
            kind[c] = _MARK | _PUNCT
    return kind, _mixed(low * _BASE)


_LETTERS = re.compile(r"[^\W\d_]+")


def _small_sigma(word: re.Match) -> str:
    return "".join(s if c == "Σ" else c for c, s in zip(word[0], word[0].replace("İ", "I").lower(), strict=True)) if "Σ" in word[0] else word[0]


@functools.cache
def _units() -> np.ndarray:
    return np.sort(Words([*UNITS], units=False).raw)


class Words:
    """The words of texts as hashes, one text after the other; ``text`` tells the place of a word's text.

    Tokens are numbers, runs of letters and marks; all texts are cut at once, by
    the kinds of their characters. ``raw``: words as they stand, without regard to
    case. ``shape``: with placeholders for numbers, for capitals inside a sentence
    (names) and for units after a number; ``open_shape``: with capitals at the
    beginning of sentences as names too, for a name may stand there. ``slot``:
    placeholders of ``shape``. ``starts``: words that follow a mark or line end or
    begin a text.
    """

    def __init__(self, texts: list[str], units: bool = True) -> None:
        kinds, hashes = _characters()
        whole = "\0".join(texts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        kind = kinds[points]
        part = kind & (_DIGIT | _MARK | _LETTER)
        inner = np.flatnonzero((points[1:-1] == ord(".")) | (points[1:-1] == ord(","))) + 1
        part[inner[(kind[inner - 1] & kind[inner + 1] & _DIGIT) > 0]] = _DIGIT
        cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (part[1:] == _MARK))))
        ends = np.append(cuts[1:], len(points))
        cuts, ends = cuts[part[cuts] > 0], ends[part[cuts] > 0]
        text, first = np.searchsorted(begins, cuts, "right") - 1, kind[cuts]
        word = (first & _PUNCT) == 0
        starts = np.concatenate(([True], ~word[:-1] | (text[1:] != text[:-1])))[: len(word)]
        cuts, ends, first, self.text, self.starts = cuts[word], ends[word], first[word], text[word], starts[word]
        if "Σ" in whole:  # the one letter whose small form depends on its place
            points = np.frombuffer(_LETTERS.sub(_small_sigma, whole).encode("utf-32-le"), np.uint32)
        up, down = _POWERS.upto(len(points))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[points] * up[: len(points)], dtype=np.uint64)))
        self.raw = _mixed((sums[ends] - sums[cuts]) * down[cuts])
        num, cap = (first & _NUM) > 0, ((first & _CAP) > 0) & (ends - cuts > 1)
        name, unit = cap & ~self.starts, np.zeros(len(num), bool)
        if units:
            after = np.flatnonzero(num[:-1] & (self.text[1:] == self.text[:-1])) + 1
            unit[after] = np.isin(self.raw[after], _units())
        self.shape = self.raw.copy()
        for s, which in zip(_SLOTS, (num, name, unit), strict=True):
            self.shape[which] = s
        self.open_shape = np.where(cap, _SLOTS[1], self.shape)
        self.slot, self.open_slot = num | name | unit, num | cap | unit

    def __len__(self) -> int:
        return len(self.raw)

    def keys(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the windows of ``size`` words of a text: as they stand, and as both templates.

        Templates need enough literal words; windows of fewer than ``SHORT`` words
        stand between marks.
        """
        n = len(self) - size + 1
        if n <= 0:
            return
        raw, inside = windows(self.raw, size) ^ np.uint64(size), self.text[:n] == self.text[size - 1 :]
        if size < SHORT:
            ends = np.append(self.starts[1:], True)
            at = np.flatnonzero(inside & self.starts[:n] & ends[size - 1 :])
            yield at, raw[at]
            return
        at = np.flatnonzero(inside)
        yield at, raw[at]
        for shape, slot in ((self.shape, self.slot), (self.open_shape, self.open_slot)):
            literal = np.concatenate(([0], np.cumsum(~slot)))
            at = inside & (literal[size:] - literal[:-size] >= LITERALS)
            if shape is self.open_shape:  # only windows in which it is another template
                other = np.concatenate(([0], np.cumsum(slot != self.slot)))
                at &= other[size:] > other[:-size]
            at = np.flatnonzero(at)
            yield at, windows(shape, size)[at] ^ np.uint64(size << 8)


class _Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(int(_BASE), -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` ids, as differences of prefix sums."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(len(ids))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * up[: len(ids)], dtype=np.uint64)))
    return _mixed((sums[size:] - sums[:n]) * down[:n])


def _hashed(df: DataFrame, text_col: str, a: str, b: str) -> DataFrame:
    """``df`` with the 128-bit key of a text in two columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(1), text))


def _whole() -> Column:
    return F.coalesce(F.col("_text"), F.lit("")).alias("_text")


def _together(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``rows`` in parts of about ``TOGETHER`` characters of text."""
    part = np.cumsum(rows["_text"].str.len().to_numpy(np.int64)) // TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield rows.iloc[a:b]


def item_windows(items: DataFrame) -> DataFrame:
    """A row for each window and template of ``i1, i2, _text``: ``key, i1, i2, n, q, own, slot``.

    ``q`` is the window's place among the item's ``n`` words; ``own`` are its
    words, ``slot`` which of them are placeholders.
    """

    def run(batches):
        for b in batches:
            out = []
            for i1, i2, text in zip(b["i1"], b["i2"], b["_text"], strict=True):
                words = Words([text])
                size = min(WINDOW, len(words))
                if size:
                    found = {(int(k), int(q)) for at, keys in words.keys(size) for q, k in zip(at, keys.view(np.int64), strict=True)}
                    out += [(k, i1, i2, len(words), q, words.raw[q : q + size].view(np.int64), words.slot[q : q + size]) for k, q in sorted(found)]
            yield pd.DataFrame(out, columns=["key", "i1", "i2", "n", "q", "own", "slot"])

    return items.select("i1", "i2", _whole()).mapInPandas(run, "key long, i1 long, i2 long, n int, q int, own array<long>, slot array<boolean>")


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in a filter of 2**bits bits, a row for each probe."""
    return np.stack([(keys * p) >> np.uint64(64 - bits) for p in _PROBES])


def key_filter(found: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the ``key`` column: its power of two and its bits.

    Executors put it together in words of 64 bits; however many windows there
    are, it has 2**MOST_BITS bits at most, and what a full one lets through
    costs time but changes no result.
    """
    n = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n * BITS_EACH))))))

    def spots(batches):
        for b in batches:
            yield pd.DataFrame({"spot": np.unique(_probes(b["key"].to_numpy().view(np.uint64), bits)).astype(np.int64)})

    words = found.select("key").mapInPandas(spots, "spot long").groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits, out.view(np.uint8)


def _text_windows(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``k1, k2, key, p, other``: windows of ``k1, k2, _text`` that may be among those found in items."""
    sizes = [r[0] for r in found.select(F.size("own").alias("s")).distinct().collect()]  # at most WINDOW rows
    shared = texts.sparkSession.sparkContext.broadcast(key_filter(found))

    def run(batches):
        bits, flags = shared.value
        for b in batches:
            for rows in _together(b):
                words = Words(rows["_text"].tolist())
                begins = np.searchsorted(words.text, np.arange(len(rows)))
                for size in sizes:
                    for at, keys in words.keys(size):
                        for p in _PROBES:  # most keys fall out at the first probe
                            spot = (keys * p) >> np.uint64(64 - bits)
                            there = np.flatnonzero((flags[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                            at, keys = at[there], keys[there]
                            if not len(keys):
                                break
                        else:
                            text = words.text[at]
                            other = words.raw.view(np.int64)[at[:, None] + np.arange(size)]
                            yield pd.DataFrame({"k1": rows["k1"].to_numpy()[text], "k2": rows["k2"].to_numpy()[text], "key": keys.view(np.int64), "p": at - begins[text], "other": list(other)})

    return texts.select("k1", "k2", _whole()).mapInPandas(run, "k1 long, k2 long, key long, p int, other array<long>")


def _consistent(own: np.ndarray, other: np.ndarray, slot: np.ndarray) -> bool:
    """A value of the item always became the same value, and two never became one."""
    to: dict[int, int] = {}
    for a, b, s in zip(own.tolist(), other.tolist(), slot.tolist(), strict=True):
        if (s or a != b) and to.setdefault(a, b) != b:
            return False
    return len(set(to.values())) == len(to)


def _verbatim(where: np.ndarray, same: np.ndarray, size: int) -> np.ndarray:
    """The places, in order, that lie in runs of at least ``size`` equal words."""
    places = where[same]
    runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
    return np.concatenate([r for r in runs if len(r) >= size] or [places[:0]])


def judge_alignment(n: int, places: list) -> tuple[list[int], int, int] | None:
    """(places covered, longest run, slots changed) of the windows of one alignment, or None.

    ``places`` are (q, own, other, slot) of its windows. Slots must be
    consistent; if they are not, only long runs that stand word for word count.
    """
    at: dict[int, tuple[int, int, bool]] = {}
    for q, own, other, slot in places:
        at.update({q + k: (int(a), int(b), bool(s)) for k, (a, b, s) in enumerate(zip(own, other, slot, strict=True))})
    where = np.array(sorted(at))
    own, other, slot = (np.array([at[int(p)][k] for p in where]) for k in range(3))
    if not _consistent(own, other, slot):
        kept = _verbatim(where, own == other, min(RUN, n))
        if not len(kept):
            return None
        inside = np.isin(where, kept)
        where, own, other = where[inside], own[inside], other[inside]
    gaps = np.flatnonzero(np.diff(where) > 1)
    run = int(np.diff(np.concatenate(([-1], gaps, [len(where) - 1]))).max())
    return where.tolist(), run, int((own != other).sum())


def leaked_texts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``k1, k2, i1, i2, share, run, changed``: which texts leak which items.

    ``texts`` has ``k1, k2, _text``, ``items`` ``i1, i2, _text``. Windows of the
    texts that pass the filter of the items' windows, a small part, are joined
    with them on their hash; a frequent window is split by skew-join handling.
    Matches are put together by alignment, whose size the item bounds, and the
    places covered are counted by aggregates.
    """
    distinct = items.groupBy("i1", "i2").agg(F.first("_text").alias("_text"))
    found = materialize(item_windows(distinct), "item-windows")
    met = _text_windows(texts, found).groupBy("k1", "k2", "key", "p").agg(F.first("other").alias("other"))  # copies of a text once
    joined = met.join(found, "key").where(F.size("own") == F.size("other"))
    aligned = joined.groupBy("k1", "k2", "i1", "i2", "n", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_list(F.struct("q", "own", "other", "slot")).alias("places"))

    def run(batches):
        for b in batches:
            out = []
            for *key, n, places in zip(b["k1"], b["k2"], b["i1"], b["i2"], b["n"], b["places"], strict=True):
                if hit := judge_alignment(n, [(x["q"], x["own"], x["other"], x["slot"]) for x in places]):
                    out.append((*key, n, *hit))
            yield pd.DataFrame(out, columns=["k1", "k2", "i1", "i2", "n", "covered", "run", "changed"])

    keys = ["k1", "k2", "i1", "i2", "n"]
    judged = aligned.select(*keys, "places").mapInPandas(run, "k1 long, k2 long, i1 long, i2 long, n int, covered array<int>, run long, changed long")
    each = judged.select(*keys, "run", "changed", F.explode("covered").alias("q")).groupBy(*keys, "q").agg(F.max("run").alias("run"), F.max("changed").alias("changed"))
    all_ = each.groupBy(*keys).agg(F.count("*").alias("covered"), F.max("run").alias("run"), F.max("changed").alias("changed"))
    leaks = all_.where((F.col("run") >= F.least(F.lit(RUN), F.col("n"))) | (F.col("covered") >= F.lit(SHARE) * F.col("n")))
    return materialize(leaks.select("k1", "k2", "i1", "i2", (F.col("covered") / F.col("n")).alias("share"), "run", "changed"), "leaks")


def _sides(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    bound_batches(docs.sparkSession)
    texts = _hashed(docs.select(F.col(text_col).alias("_text")), "_text", "k1", "k2")
    return texts, _hashed(benchmark.select(F.col(item_text_col).alias("_text")), "_text", "i1", "i2")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item, as ``find_leaks`` defines it; all columns stay, whatever their names."""
    gone = leaked_texts(*_sides(docs, benchmark, text_col, item_text_col)).select(F.col("k1").alias("_quarry_k1"), F.col("k2").alias("_quarry_k2")).distinct()
    few = gone.count() <= BROADCAST_KEYS
    packed = docs.select(packed_row(docs), F.col(f"`{text_col}`").alias("_text"))  # out of the way of the keys' names
    keyed = _hashed(packed, "_text", "_quarry_k1", "_quarry_k2")
    return unpacked_row(keyed.join(F.broadcast(gone) if few else gone, ["_quarry_k1", "_quarry_k2"], "left_anti"), docs.columns)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, item, share, run, changed``: a row per document and item it leaks.

    Numbers, names (capitals) and units after a number become typed
    placeholders. Windows of ``WINDOW`` words, as templates and as they stand,
    are joined on their hash with those of the items; matches of one alignment
    count together if their slots are consistent: equal values of the item became
    equal values, unequal ones unequal. Of an alignment that is not, only runs of
    ``RUN`` words that are the same word for word count. A run of ``RUN`` words (or
    the whole shorter item) or ``SHARE`` of the item's words is a leak.
    ``share``: of the item's words found; ``run``: most in a row; ``changed``:
    slots whose value differs.

    Both sides are tables: the benchmark is not collected, and documents are
    read in one pass whatever its size. Each distinct text is judged once.

    Defined results: null and empty texts leak nothing and are leaked by
    nothing; an item of fewer than ``SHORT`` words is leaked where it stands
    between marks or line ends, as it is. Repeated documents and repeated items each
    give their rows; ids may be null and of any type. Empty tables give no rows.
    Other columns are ignored whatever their names; long texts are read whole.
    """
    texts, items = _sides(docs, benchmark, text_col, item_text_col)
    leaks = leaked_texts(texts, items)
    few = leaks.count() <= BROADCAST_KEYS
    ids = _hashed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "k1", "k2").drop("_text")
    names = _hashed(benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")), "_text", "i1", "i2").drop("_text")
    out = ids.join(F.broadcast(leaks) if few else leaks, ["k1", "k2"]).join(names, ["i1", "i2"])
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "share", "run", "changed")
