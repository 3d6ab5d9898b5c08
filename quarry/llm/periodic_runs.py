"""Periodic runs of words: Lyndon roots from the suffix order, extended by LCP and range minima.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends keeping that period. By the runs theorem every run of
exponent 2 or more holds a Lyndon word of length ``q`` that is the longest Lyndon
word from its position under one of the two orders of the alphabet. Those words
end at the next smaller, or for the opposite order the next greater, value of the
inverse suffix array, so all runs come from two candidates a position.

All steps work on the words of many texts at once, as numpy arrays: each text is
closed by a word of its own, smaller than its others, and words of different texts
differ, so nothing is found across texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import bound_batches

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words taken together; one longer text is taken alone.
WORDS_AT_ONCE = 400_000


def least_repeat(min_length: int, min_exponent: int) -> int:
    """Words that some position of a run shares with the one a period on, whatever the period.

    The first Lyndon root of a run of length n begins in its first q words, so it
    agrees with its repetition for n - 2q + 1 words or more.
    """
    bound = lambda q: max(min_length - 2 * q + 1, (min_exponent - 2) * q + 1)
    return max(1, min(bound(q) for q in range(1, min_length + 2)))


def texts_with_repeats(ids: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> np.ndarray:
    """Which texts may hold ``width`` words twice (by hash: none is missed, a few too many may be named)."""
    if len(ids) < width:
        return np.zeros(n_texts, bool)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n, h = len(ids) - width + 1, np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    h ^= h >> np.uint64(31)
    inside = text[:n] == text[width - 1 :]
    bits = np.uint64(max(1, int(n_texts).bit_length()))
    keys = np.sort((h[inside] << bits) | text[:n][inside].astype(np.uint64))
    again = keys[1:][keys[1:] == keys[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))
    out = np.zeros(n_texts, bool)
    out[again.astype(np.int64)] = True
    return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP array (of neighbours; 0 at the first) by prefix doubling.

    A rank is the place of the first suffix with that prefix, so a round sorts only
    suffixes that are not told apart yet. The last element must differ from all others.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    last = np.concatenate((first[1:], [True]))
    places = np.flatnonzero(~(first & last))  # places of groups of two or more
    width = 1
    while len(places):
        at = order[places]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[places] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        levels.append(rank.astype(np.int32))
        places = places[~(new & np.concatenate((new[1:], [True])))]
        width *= 2
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        lcp[1:] += step.astype(np.int32)
    return order, rank, lcp


def minima(values: np.ndarray) -> list[np.ndarray]:
    """The sparse table of range minima: level k has the minimum of 2^k values from each place."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, low = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(low[:-half], low[half:]))
    return table


def range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima over [lo, hi), each of one value at least."""
    out, level = np.empty(len(lo), table[0].dtype), np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << k)])
    return out


def next_smaller(table: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length where there is none."""
    n, value, pos = len(table[0]), table[0][at], at + 1
    for k in range(len(table) - 1, -1, -1):
        fits = pos + (1 << k) <= n
        skip = fits & (table[k][np.where(fits, pos, 0)] > value)
        pos = pos + (skip.astype(np.int64) << k)
    return pos


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period), sorted, of all runs of a closed sequence of word numbers.

    ``ids`` may hold several texts, each closed by a number of its own that is
    smaller than its others; numbers of different texts differ.
    """
    _, rank, lcp = suffix_order(ids)
    n, least = len(ids), least_repeat(min_length, min_exponent)
    common = minima(lcp)

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from i and j have in common."""
        a, b = rank[i], rank[j]
        return range_min(common, np.minimum(a, b) + 1, np.maximum(a, b) + 1)

    shared = np.maximum(lcp, np.concatenate((lcp[1:], [0])))[rank]
    at = np.flatnonzero(shared >= least)
    found = []
    for order in (rank, -rank):
        end = next_smaller(minima(order.astype(np.int32)), at)
        i, j = at[end < n], end[end < n]
        p = j - i
        ahead = agree(i, j).astype(np.int64)
        keep = ahead >= np.maximum(1, np.maximum(min_length - 2 * p + 1, (min_exponent - 2) * p + 1))
        i, j, p, ahead = i[keep], j[keep], p[keep], ahead[keep]
        # backwards: the greatest t up to p with t words before i and j alike
        low, high = np.zeros(len(i), np.int64), np.minimum(p, i)
        while (low < high).any():
            mid = (low + high + 1) // 2
            t = np.maximum(mid, 1)
            alike = (agree(np.maximum(i - t, 0), np.maximum(j - t, 1)) >= mid) | (mid == 0)
            low, high = np.where(alike, mid, low), np.where(alike, high, mid - 1)
        length = p + ahead + low
        keep = (low < p) & (length >= np.maximum(min_length, min_exponent * p))
        found.append(np.stack((i[keep] - low[keep], length[keep], p[keep]), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _runs_of_texts(words: list[list[bytes]], min_length: int, min_exponent: int) -> list[np.ndarray]:
    """The runs of each of several texts."""
    sizes = np.array([len(w) for w in words])
    out = [np.empty((0, 3), np.int64)] * len(words)
    if not sizes.sum():
        return out
    flat = np.empty(sizes.sum(), object)
    flat[:] = [w for ws in words for w in ws]
    ids, text = pd.factorize(flat)[0], np.repeat(np.arange(len(words)), sizes)
    some = texts_with_repeats(ids, text, len(words), least_repeat(min_length, min_exponent))
    if not some.any():
        return out
    keep, base, values = some[text], np.int64(ids.max()) + 2, np.flatnonzero(some)
    kept, place = sizes[values], np.cumsum(sizes[values] + 1)
    closed = np.empty(kept.sum() + len(values), np.int64)
    ends = place - 1
    body = np.ones(len(closed), bool)
    body[ends] = False
    closed[body] = text[keep] * base + ids[keep] + 1
    closed[ends] = values * base
    found = runs_of(closed, min_length, min_exponent)
    owner = np.searchsorted(ends, found[:, 0])
    begin = place - kept - 1
    for k, v in enumerate(values):
        mine = found[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
        out[v] = mine - np.array([begin[k], 0, 0])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: ``id, n_words, runs, collapsed``.

    ``runs`` holds (start, length, period), in word numbers from 0, of every run of
    at least ``min_length`` words and ``min_exponent`` periods, by start, then
    period. ``collapsed`` is the text's words, joined by one space, without those
    that a run contains after its first period.

    Rows never leave their partition. A task takes texts of ``WORDS_AT_ONCE`` words
    together, a longer text alone, at some 250 bytes a word of texts in which words
    repeat at all. Defined results: a null or empty text, or one of white space, has
    no words, no runs and an empty ``collapsed``; ids of any type, null ones too, and
    repeated rows have a row each; an empty table gives no rows. Other columns are
    ignored.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    bound_batches(docs.sparkSession)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def groups(texts):
        """The words of stretches of rows with a bounded number of words."""
        size, words = 0, []
        for text in texts:
            cut = (text.as_py() or b"").split()  # at the six ASCII white-space bytes
            if words and size + len(cut) > WORDS_AT_ONCE:
                yield words
                size, words = 0, []
            words.append(cut)
            size += len(cut)
        if words:
            yield words

    def work(batches):
        for b in batches:
            begin, listed = 0, schema_arrow.field("runs").type
            for words in groups(b.column("_text")):
                found = _runs_of_texts(words, min_length, min_exponent)
                left = [ws if not len(r) else [ws[i] for i in np.flatnonzero(kept_words(len(ws), r))] for ws, r in zip(words, found, strict=True)]
                runs = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r.tolist()] for r in found], listed)
                collapsed = pa.array([b" ".join(ws) for ws in left], pa.binary()).cast(pa.string())
                ids = b.column("_id").slice(begin, len(words)).cast(schema_arrow.field("_id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(ws) for ws in words], pa.int64()), runs, collapsed], schema=schema_arrow)
                begin += len(words)

    schema_arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text``: a tenth of the texts, by a hash of the id, repeat a stretch of their words to the end.

    With h the CRC-32 of the decimal id and g = h div 10, where h is divisible by
    10 and the text has n > 0 words, words from a = g mod n on are the p = 1 + (n - a)
    div (3 + g mod 8) words from a, again and again. Rows with a null id stay as they are.
    """
    word = r"[^\\x20\\x09-\\x0D]+"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("_h"))
    rows = rows.withColumn("_words", F.expr(f"if(_h % 10 = 0, regexp_extract_all(_text, '{word}', 0), null)"))
    rows = rows.withColumn("_n", F.coalesce(F.size("_words"), F.lit(-1))).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.expr("if(_n > 0, cast(_g % _n as int), 0)"))
    rows = rows.withColumn("_p", F.expr("if(_n > 0, cast(1 + (_n - _a) div (3 + _g % 8) as int), 1)"))
    tail = "slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast((_n - _a) div _p as int) + 1)), 1, _n - _a)"
    edited = F.expr(f"if(_n > 0, concat_ws(' ', slice(_words, 1, _a), {tail}), _text)")
    return rows.select(F.col("_id").alias(id_col), edited.alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of runs, the run of the greatest exponent, and digests of runs and kept words."""
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    out = found.withColumn("_best", F.expr(best))
    return out.select(id_col, F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"), F.sha2(F.expr(lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
