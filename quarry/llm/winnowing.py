"""Winnowing: position-keeping document fingerprints with match guarantees."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches, materialize, ranked

#: Noise threshold: matches shorter than K code points are never seen.
K = 24
#: Window of k-grams: every shared passage of K + W - 1 code points is seen.
W = 40
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xBF58476D1CE4E5B9
#: Rows of a range of ids, and how many ranges there are at most: their first rows (some 30 bytes
#: each) are broadcast. Ranges are read as a stream, so longer ones need no more memory.
RANGE_ROWS, MAX_RANGES = 500, 500_000
#: The longest piece looked at in one go.
_CHUNK = 2**22
#: A mark of a fingerprint: position and hash, the most significant byte first.
_MARK = np.dtype([("position", ">u4"), ("hash", ">u8")])


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Rolling hashes of all k-grams of code points; one of the whole where it is shorter."""
    if not len(codes):
        return np.empty(0, np.uint64)
    k = min(k, len(codes))
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    x ^= x >> np.uint64(29)
    out, width, base, parts = None, 1, _BASE, k
    # hash of 2m grams = hash(m) * base^m + shifted hash(m); the binary digits of k say which to join
    done = 0
    while parts:
        if parts & 1:
            piece = x[done : len(codes) - k + 1 + done]
            out = piece.copy() if out is None else out * np.uint64(base) + piece
            done += width
        parts >>= 1
        if parts:
            x = x[: len(x) - width] * np.uint64(base) + x[width:]
            base, width = base * base & (2**64 - 1), width * 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MIX)
    return out ^ (out >> np.uint64(29))


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected grams: the minimum of every window, the rightmost of equals."""
    h = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), h
    w = min(w, n)
    found = [_select(h[i : i + _CHUNK + w - 1], w) + i for i in range(0, n - w + 1, _CHUNK)]
    picked = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return picked, h[picked]


def _select(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the window minima of a piece, the rightmost of equal hashes."""
    low, at, width = h, np.arange(len(h)), 1

    def joined(low: np.ndarray, at: np.ndarray, by: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        later = low[by : by + n] <= low[:n]
        return np.where(later, low[by : by + n], low[:n]), np.where(later, at[by : by + n], at[:n])

    while width * 2 <= w:
        low, at = joined(low, at, width, len(low) - width)
        width *= 2
    if w > width:
        _, at = joined(low, at, w - width, len(h) - w + 1)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprint(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Positions and hashes as text (base64 of 12 bytes a mark); the empty fingerprint is the empty string."""
    marks = np.empty(len(hashes), _MARK)
    marks["position"], marks["hash"] = positions, hashes
    return base64.b64encode(marks.tobytes()).decode()


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The positions and hashes of a fingerprint."""
    marks = np.frombuffer(base64.b64decode(text), _MARK)
    return marks["position"].astype(np.int64), marks["hash"].astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def winnow_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per selected gram: ``id, position, hash``; ``position`` counts code points.

    Texts that share a passage of ``k + w - 1`` code points share a hash taken
    from it. A null or empty text has no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("position", T.LongType()), T.StructField("hash", T.LongType())])

    def run(batches):
        for b in batches:
            for i, text in zip(b["_id"], b["_text"], strict=True):
                at, h = winnow(text or "", k, w)
                yield pd.DataFrame({id_col: [i] * len(at), "position": at, "hash": h.view(np.int64)})

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def with_successors(docs: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``_part, _id, _text, _tie, _ghost`` such that each part, sorted, holds every row's successor.

    Descending id, null ids last, XXH64 of the text breaks ties. The narrow table
    of ids and ties is ranked; every ``range_rows``-th row opens a range. A row
    finds its range by binary search among these heads, which are broadcast, and
    the first row of a range is also sent, as a ghost, to the range before its
    own, the very first to the last range. Texts are read and shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("_id").desc_nulls_last(), F.col("_tie")]
    keys = materialize(ranked(rows.select("_id", "_tie"), order, "_rank"), "ranks")
    every = max(range_rows, -(-keys.count() // MAX_RANGES))
    heads = keys.where(F.col("_rank") % every == 0).select("_rank", "_id", "_tie")
    found = heads.agg(F.array_sort(F.collect_list(F.struct("_rank", "_id", "_tie"))).alias("_heads"))
    placed = rows.crossJoin(F.broadcast(found))  # one row
    # whether a head is at or before the row, for ids of any type that has an order
    before = "(isnull(element_at(_heads, MID)._id) = isnull(_id) AND (element_at(_heads, MID)._id > _id OR (element_at(_heads, MID)._id <=> _id AND element_at(_heads, MID)._tie <= _tie))) OR (isnull(_id) AND isnotnull(element_at(_heads, MID)._id))"
    mid = "(x.lo + cast(ceil((x.hi - x.lo) / 2) as int))"
    goes = f"if({before.replace('MID', mid)}, named_struct('lo', {mid}, 'hi', x.hi), named_struct('lo', x.lo, 'hi', {mid} - 1))"
    steps = "sequence(1, 1 + cast(ceil(log2(size(_heads) + 1)) as int))"
    placed = placed.withColumn("_part", F.expr(f"aggregate({steps}, named_struct('lo', 0, 'hi', size(_heads)), (x, i) -> if(x.lo >= x.hi, x, {goes})).lo"))
    is_head = F.expr("element_at(_heads, _part)._id <=> _id AND element_at(_heads, _part)._tie = _tie")
    last = F.size("_heads")
    own = F.struct(F.col("_part").alias("p"), F.lit(False).alias("g"))
    ghost = F.struct(F.when(F.col("_part") > 1, F.col("_part") - 1).otherwise(last).alias("p"), F.lit(True).alias("g"))
    sent = placed.withColumn("_to", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))
    return sent.select(F.col("_to.p").alias("_part"), "_id", "_text", "_tie", F.col("_to.g").alias("_ghost"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text has its last floor(n / 3) code points replaced by the first
    as many of the next document, in descending id (after the last: the first).
    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_marks``.

    Defined results: null is the empty text, whose fingerprint is the empty
    string; two empty fingerprints have likeness 1. Of rows with the same id,
    those with the smaller XXH64 of the text come first; null ids come last. A
    single document is its own successor. An empty table gives no rows. Ids may be of
    any type that has an order; other columns are ignored; a very long text is
    looked at in pieces of ``_CHUNK`` grams.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("n_marks", T.LongType())])

    def run(batches):
        held = None
        for b in batches:
            out = []
            for part, i, text, ghost in zip(b["_part"], b["_id"], b["_text"], b["_ghost"], strict=True):
                text = text or ""
                marks = winnow(text, k, w)
                if held and held[0] == part:
                    _, own, was, (at, h) = held
                    cut = len(was) // 3
                    edited = was[: len(was) - cut] + text[:cut]
                    to, eh = winnow(edited, k, w)
                    out.append((own, len(was), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(at, h), fingerprint(to, eh), likeness(h, eh), likeness(h, marks[1]), len(at)))
                held = None if ghost else (part, i, text, marks)
            frame = pd.DataFrame(out, columns=schema.names)
            frame[id_col] = pd.Series([row[0] for row in out], dtype=b["_id"].dtype)
            yield frame

    rows = with_successors(docs, id_col, text_col).repartition("_part")
    rows = rows.sortWithinPartitions("_part", "_ghost", F.col("_id").desc_nulls_last(), "_tie", "_text")
    return rows.select("_part", "_id", "_text", "_ghost").mapInPandas(run, schema)
