"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that starts at two
places at least. Suffixes are sampled: each window of ``LENGTH`` bytes names one
anchor, the place of its least K-gram hash (the last of equals), from its own
bytes alone, so equal windows name anchors at the same offset, and only suffixes
at anchors (one of about 185 bytes) need an entry. All windows of one anchor
start in a row; the bytes they cover are the anchor's context.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, discard, materialize

LENGTH, K = 400, 32
#: Bytes of text of a batch, and the least and most batches that one table is taken in: each
#: is scanned against all before it, so beyond 4 GB batches grow instead of their number.
BATCH_BYTES, FEWEST, MOST = 2**29, 4, 8
#: Contexts of one anchor string beyond which its windows are counted one by one in the plan.
HOT_CONTEXTS = 4_000
#: Keys (16 bytes each) that may be broadcast to thin out texts before their shuffle.
BROADCAST_KEYS = 1_000_000
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE2 = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63)) * 2 + 1
_R = int(_RNG.integers(0, 2**62)) * 4 + 3
_POS, _CHUNK = np.uint64(2**24 - 1), 2**22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up))
            step = np.full(size, _R, np.uint64)
            back = np.full(size, pow(_R, -1, 2**64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums by which the hash of any substring is had at once."""
    up, _ = _POWERS.upto(len(codes) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE2[codes] * up[: len(codes)], dtype=np.uint64)))


def _span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = _POWERS.upto(len(prefix))
    return _mix((prefix[hi] - prefix[lo]) * down[lo])


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """(place, first start, last start, head, gram hash, context hash) of the anchors of a text.

    The head is the first eight bytes as a number of the same order.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(3))
    codes = np.frombuffer(data, np.uint8)
    parts = [_anchors(codes[i : i + _CHUNK + LENGTH - 1], i) for i in range(0, n - LENGTH + 1, _CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(codes: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    x, width, power = _BYTE[codes], 1, _BASE
    while width < K:
        x = x[: len(x) - width] * np.uint64(power) + x[width:]
        width, power = width * 2, power * power & (2**64 - 1)
    h = _mix(x)
    low = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
    w, width = LENGTH - K + 1, 1
    while width * 2 <= w:
        low, width = np.minimum(low[: len(low) - width], low[width:]), width * 2
    low = np.minimum(low[: len(h) - w + 1], low[w - width : len(h) - width + 1])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.concatenate((first[1:], [len(low)])) - 1
    at = (_POS - (low[first] & _POS)).astype(np.int64)
    prefix = _prefix(codes)
    shape = ((at - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    context = _mix(_span_hash(prefix, first, last + LENGTH) ^ _mix(shape))
    head = np.lib.stride_tricks.sliding_window_view(codes, 8)[at].copy().view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(2**63)
    return at + base, first + base, last + base, head, h[at], context


def window_keys(gram: int, offset: int, starts: int, data: bytes) -> np.ndarray:
    """Keys of a context's windows: equal for equal windows only."""
    prefix = _prefix(np.frombuffer(data, np.uint8))
    i = np.arange(starts)
    place = _mix((offset - i).astype(np.uint64) ^ np.uint64(gram & (2**64 - 1)))
    return _mix(_span_hash(prefix, i, i + LENGTH) ^ place)


def _runs(flags: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Byte spans [begin, end) that the flagged window starts cover."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(first + int(a), first + int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def merge_spans(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of overlapping or touching spans (begin << 32 | end)."""
    spans = np.sort(spans)
    begin, end = spans >> 32, np.maximum.accumulate(spans & (2**32 - 1))
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new].astype(np.int32), end[np.concatenate((new[1:], [len(spans)])) - 1].astype(np.int32)


_ENTRY = "k1 long, k2 long, at int, first int, last int, head long, gram long, context long"


def suffix_entries(texts: DataFrame) -> DataFrame:
    """An entry for each sampled suffix of ``k1, k2, _text``."""

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, t in zip(b["k1"], b["k2"], b["_text"], strict=True):
                if t and (len(t) * 4 >= LENGTH):
                    at, lo, hi, *marks = anchors(t.encode("utf-8", "surrogatepass"))
                    if len(at):
                        out.append((np.full(len(at), k1), np.full(len(at), k2), at, lo, hi, *(m.view(np.int64) for m in marks)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 8
            yield pd.DataFrame(dict(zip(("k1", "k2", "at", "first", "last", "head", "gram", "context"), cols, strict=True)))

    return texts.select("k1", "k2", "_text").mapInPandas(run, _ENTRY)


class SuffixFamily:
    """Levels of sparse suffix arrays; a new batch is scanned against them, equal-sized ones merge.

    An array has a row for each distinct context of the anchored suffixes, with
    how often it occurs and one place. It is in the order of suffixes to a depth
    of eight bytes (``head``), and below that in the order of the hashes of the
    first ``K`` bytes (``gram``) and of the whole context, so that suffixes with
    ``K`` bytes in common, and those with a context in common, follow each other,
    which is all that a scan asks of the order. Level i holds the suffixes of
    2**i batches, so a suffix is merged a logarithmic number of times.

    Runs are found by aggregates on keys with map-side combining, so a run of
    any length is split over tasks.
    """

    def __init__(self, levels: list[DataFrame | None] | None = None) -> None:
        self.levels = list(levels or [])
        self.crossed: list[tuple[DataFrame, DataFrame]] = []

    @classmethod
    def load(cls, spark: SparkSession, folder: str, count: int) -> SuffixFamily:
        """The family of ``count`` batches that ``save`` has written."""
        return cls([spark.read.parquet(f"{folder}/level-{i}") if count >> i & 1 else None for i in range(count.bit_length())])

    def save(self, folder: str) -> int:
        """Writes the levels into a new folder; returns how many batches they hold."""
        for i, level in enumerate(self.levels):
            if level is not None:
                level.write.parquet(f"{folder}/level-{i}")
        return sum(1 << i for i, level in enumerate(self.levels) if level is not None)

    @staticmethod
    def _array(parts: DataFrame) -> DataFrame:
        """The array of rows ``head, gram, context, n, place``, equal contexts put together."""
        return parts.groupBy("gram", "context").agg(F.min("head").alias("head"), F.sum("n").alias("n"), F.min("place").alias("place")).sortWithinPartitions("head", "gram", "context")

    def add(self, entries: DataFrame) -> None:
        """Takes in a batch: its array is scanned against every level it is not merged with.

        What one level has twice can be read from it (``repeated``, ``mixed``).
        """
        place = F.struct("k1", "k2", "at", "first", "last")
        new = materialize(self._array(entries.select("head", "gram", "context", F.lit(1).cast("long").alias("n"), place.alias("place"))), "batch")
        full = next((i for i, level in enumerate([*self.levels, None]) if level is None))
        for level in self.levels[full + 1 :]:
            if level is not None:
                self.crossed.append(self._merge_scan(level, new))
        old = self.levels[:full]
        if old:
            merged = materialize(self._array(reduce(DataFrame.unionByName, [*old, new])), f"level-{full}")
            discard(*old, new)
            new = merged
        self.levels = [None] * full + [new] + self.levels[full + 1 :]

    @staticmethod
    def _merge_scan(level: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Contexts that both arrays have, and grams that both have with more than one context."""
        both = level.select("gram", "context", F.lit(1).alias("side")).unionByName(new.select("gram", "context", F.lit(2).alias("side")))
        met = both.groupBy("gram", "context").agg(F.bit_or("side").alias("side"))
        runs = met.groupBy("gram").agg(F.bit_or("side").alias("side"), F.count("*").alias("kinds")).where("side = 3 AND kinds > 1")
        return materialize(met.where("side = 3").select("gram", "context"), "crossed"), materialize(runs.select("gram"), "crossed-runs")

    def contexts(self) -> DataFrame:
        """All levels, one after the other."""
        return reduce(DataFrame.unionByName, [x for x in self.levels if x is not None])

    def repeated(self) -> DataFrame:
        """``gram, context`` of the contexts that occur twice at least."""
        parts = [x.where("n > 1").select("gram", "context") for x in self.levels if x is not None]
        return reduce(DataFrame.unionByName, parts + [w for w, _ in self.crossed])

    def mixed(self) -> DataFrame:
        """``gram`` of the runs with more than one context."""
        parts = [x.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram") for x in self.levels if x is not None]
        return reduce(DataFrame.unionByName, parts + [g for _, g in self.crossed])


def _thinned(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row ``k1, k2, _text`` for each of ``keys``.

    Where there are few enough keys they are broadcast, so that other texts are
    not shuffled; copies are put together before the shuffle either way.
    """
    few = keys.count() <= BROADCAST_KEYS
    found = texts.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "left_semi")
    return found.groupBy("k1", "k2").agg(F.first("_text").alias("_text"))


_SPANS = "k1 long, k2 long, begin int, end int"


def _resolve(contexts: DataFrame) -> DataFrame:
    """Spans of the repeated windows of contexts that occur once."""

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        keys = [window_keys(g, o, s, d) for g, o, s, d in zip(b["gram"], b["offset"], b["starts"], b["bytes"], strict=True)]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        out, at = [], 0
        for k, (k1, k2, first, n) in enumerate(zip(b["k1"], b["k2"], b["first"], b["n"], strict=True)):
            flags = twice[at : at + len(keys[k])]
            at += len(keys[k])
            if n == 1 and flags.any():
                out += [(k1, k2, x, y) for x, y in _runs(flags, first)]
        return pd.DataFrame(out, columns=["k1", "k2", "begin", "end"]).astype({"k1": "int64", "k2": "int64", "begin": "int32", "end": "int32"})

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            grams = b["gram"].to_numpy()
            cut = int(np.flatnonzero(grams != grams[-1])[-1] + 1) if (grams != grams[-1]).any() else 0
            if cut:
                held.append(b.iloc[:cut])
                yield settle(pd.concat(held, ignore_index=True))
                held = []
            elif held and held[-1]["gram"].iloc[-1] != grams[-1]:
                yield settle(pd.concat(held, ignore_index=True))
                held = []
            held.append(b.iloc[cut:])
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, _SPANS)


def _resolve_hot(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted as rows."""

    def windows(batches):
        for b in batches:
            for g, o, s, d, k1, k2, first, n in zip(b["gram"], b["offset"], b["starts"], b["bytes"], b["k1"], b["k2"], b["first"], b["n"], strict=True):
                yield pd.DataFrame({"key": window_keys(g, o, s, d).view(np.int64), "k1": k1, "k2": k2, "begin": np.arange(first, first + s, dtype=np.int32), "n": n})

    rows = contexts.mapInPandas(windows, "key long, k1 long, k2 long, begin int, n long")
    # written, so that the join reads plain shuffles: only then are the rows of one window split over tasks
    twice = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "windows")
    return rows.where("n = 1").join(twice, "key").select("k1", "k2", "begin", (F.col("begin") + LENGTH).alias("end"))


def repeated_spans(texts: DataFrame, batches: int = 2) -> DataFrame:
    """``k1, k2, begin, end``: spans of repeated strings in texts of key (k1, k2), with overlaps.

    ``texts`` has a row per document (``k1, k2, _text``, the keys hashing the
    text). A context that occurs twice repeats whole, without a look at its
    bytes. Only contexts that occur once, beside others of the same anchor
    string, are sent with their bytes, one of each other kind with them, and
    compared window by window.
    """
    family, entries = SuffixFamily(), []
    for i in range(batches):
        entries.append(materialize(suffix_entries(texts.where(F.pmod("k1", F.lit(batches)) == i)), "suffixes"))
        family.add(entries[-1])
    whole = family.repeated()
    spans = reduce(DataFrame.unionByName, entries).join(whole, ["gram", "context"], "left_semi").select("k1", "k2", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end"))
    places = family.contexts().join(family.mixed(), "gram", "left_semi").groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    places = materialize(places, "runs")
    kinds = places.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1").select("gram", "kinds")
    places = materialize(places.join(kinds, "gram").select("gram", "n", "kinds", "place.*"), "mixed")
    wanted = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "n", "kinds", "at", "first", "last")).alias("places"))
    found = _thinned(texts, places.select("k1", "k2").distinct()).join(wanted, ["k1", "k2"])

    def cut(batches):
        for b in batches:
            out = []
            for k1, k2, t, ps in zip(b["k1"], b["k2"], b["_text"], b["places"], strict=True):
                data = t.encode("utf-8", "surrogatepass")
                out += [(p["gram"], p["n"], p["kinds"], k1, k2, p["first"], p["at"] - p["first"], p["last"] - p["first"] + 1, data[p["first"] : p["last"] + LENGTH]) for p in ps]
            yield pd.DataFrame(out, columns=["gram", "n", "kinds", "k1", "k2", "first", "offset", "starts", "bytes"])

    contexts = found.mapInPandas(cut, "gram long, n long, kinds long, k1 long, k2 long, first int, offset int, starts int, bytes binary")
    hot = places.where(F.col("kinds") > HOT_CONTEXTS)
    if hot.isEmpty():
        once = _resolve(contexts)
    else:
        contexts = materialize(contexts, "contexts")
        once = _resolve(contexts.where(F.col("kinds") <= HOT_CONTEXTS)).unionByName(_resolve_hot(contexts.where(F.col("kinds") > HOT_CONTEXTS)))
    return spans.unionByName(once)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, with_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept_sha256`` of every row, and ``kept`` if asked for.

    Texts are bytes of UTF-8; a byte covered by ``LENGTH`` bytes that also start
    anywhere else, in any row, is removed, judged on the input. ``spans`` are
    the maximal removed runs [begin, end); ``kept`` (binary) has the bytes that
    remain. Copies of a text of that length go whole; each distinct text is
    treated once, and rows get its result by their text's 128-bit key. The
    table comes in ``batches`` by the key, as many as its bytes ask for if none
    are given; their number changes no result.

    Defined results: null is the empty text: no bytes, no spans, the digest of
    nothing. Shorter texts lose nothing. Repeated rows count as places of their
    own. An empty table gives no rows; ids may be null or repeat; other columns
    are ignored. Texts may be as long as a row may be: they are looked at in
    pieces of ``_CHUNK`` bytes.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumns({"k1": F.xxhash64("_text"), "k2": F.xxhash64(F.lit(1), "_text")})
    rows = materialize(keyed.select("_id", "k1", "k2", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), "rows")
    copied = rows.groupBy("k1", "k2").agg(F.first("n_bytes").alias("n_bytes"))
    if batches is None:
        size = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        batches = min(MOST, max(FEWEST, -(-size // BATCH_BYTES)))
    texts = keyed.select("k1", "k2", "_text")
    span = F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    spans = repeated_spans(texts, batches).groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))

    def join(batches):
        for b in batches:
            merged = [merge_spans(np.asarray(x)) for x in b["spans"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "begins": [x for x, _ in merged], "ends": [y for _, y in merged], "n_removed": [int((y.astype(np.int64) - x).sum()) for x, y in merged]})

    kind = "k1 long, k2 long, begins array<int>, ends array<int>, n_removed long"
    merged = materialize(spans.mapInPandas(join, kind), "spans")
    judged = merged.join(copied, ["k1", "k2"])
    partial = judged.where("n_removed < n_bytes").select("k1", "k2", "begins", "ends", "n_removed")

    def cut(batches):
        for b in batches:
            kept = []
            for t, begins, ends in zip(b["_text"], b["begins"], b["ends"], strict=True):
                data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
                    parts.append(data[at:lo])
                    at = hi
                kept.append(b"".join([*parts, data[at:]]))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield b.drop(columns="_text").assign(**{"_kept": kept} if with_text else {}, _cut=digests)

    shape = f"{kind}{', _kept binary' * with_text}, _cut string"
    found = _thinned(texts, partial.select("k1", "k2")).join(partial, ["k1", "k2"])
    rest = found.select("k1", "k2", "begins", "ends", "n_removed", "_text").mapInPandas(cut, shape)
    none = F.lit(b"").alias("_kept")
    gone = judged.where("n_removed >= n_bytes").select("k1", "k2", "begins", "ends", "n_removed", *[none] * with_text, F.lit(hashlib.sha256(b"").hexdigest()).alias("_cut"))
    results = materialize(rest.unionByName(gone), "results")
    out = (keyed.select("_id", "k1", "k2", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), F.col("_text").cast("binary").alias("_own")) if with_text else rows).join(results, ["k1", "k2"], "left")
    kept = [F.coalesce("_kept", "_own").alias("kept")] * with_text
    return out.select(F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")), F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"), F.coalesce("_cut", "_sha").alias("kept_sha256"), *kept)
