"""Runs of samples that satisfy a rule, on a stream, with late rows put in order and state that is cleared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Waiting rows and open stretches of the keys of a bucket; a waiting row is a stretch of one.
_STATE = "keys array<string>, times array<long>, ends array<long>, orders array<long>, counts array<long>, totals array<double>, hits array<boolean>, open array<boolean>"
_TYPES = (object, np.int64, np.int64, np.int64, np.int64, np.float64, bool, bool)


def threshold_runs(samples: DataFrame, hit: Column, key: str, order: str, value: str, time: str = "ts", min_len: int = 3, idle: str = "1 day", late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """``key, start, end, n, total``: stretches of at least ``min_len`` samples of a key, in time, that satisfy ``hit``.

    The same rows as gaps and islands over the whole table: a stretch ends at the
    first sample that does not satisfy the rule (a null counts as that), or, where
    ``idle`` passes after it without a sample of the key, by a timer. ``time`` is a
    timestamp; of equal times ``order`` (a whole number) tells which sample comes first.

    Rows wait, per key, until the watermark (``late`` behind the greatest time) has
    passed them, and are then taken in order, so the result does not depend on how the
    stream was cut into batches; rows that come later than that are left out. Of a key
    its waiting rows and the counts of one open stretch are held, never the stretch, and
    nothing when it has neither. Keys are dealt into ``buckets`` that share a state, for a
    call of Python for each key costs far more than its rows; a bucket without any key is
    removed. Timers are set for the first waiting row or the end of idleness of a bucket's
    keys, so a key without new rows is finished as well. ``key`` is of a type that casts to
    a string and back (numbers, strings, dates, times); a checkpoint keeps its ``buckets``.
    """
    wait = pd.Timedelta(idle).value // 1_000_000  # milliseconds
    kind = samples.schema[key].dataType
    out = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        parts = [[np.array(c, t) for c, t in zip(state.get, _TYPES, strict=True)]] if state.exists else []
        for f in frames:
            us, ones, no = f["_us"].to_numpy(np.int64), np.ones(len(f), np.int64), np.zeros(len(f), bool)
            parts.append([f["_key"].to_numpy(object), us, us, f["_order"].to_numpy(np.int64), ones, f["_value"].to_numpy(np.float64), f["_hit"].to_numpy(bool), no])
        keys, starts, ends, orders, counts, totals, hits, opened = (np.concatenate(c) for c in zip(*parts, strict=True))
        keys[pd.isna(keys)] = None
        code = pd.factorize(keys, use_na_sentinel=False)[0]
        at = np.lexsort((orders, starts, ~opened, code))  # what is open comes before the rows of its key
        code, keys, starts, ends, orders, counts, totals, hits, opened = (c[at] for c in (code, keys, starts, ends, orders, counts, totals, hits, opened))
        taken = opened | (starts // 1000 < mark)
        waiting = np.flatnonzero(~taken)
        t = np.flatnonzero(taken)
        same = code[t[1:]] == code[t[:-1]]
        near = same & (starts[t[1:]] // 1000 - ends[t[:-1]] // 1000 <= wait)
        new = hits[t] & ~np.concatenate(([False], near & hits[t[:-1]]))[: len(t)]
        inside = np.flatnonzero(hits[t])  # places among those taken
        run = np.cumsum(new)[inside] - 1
        heads = np.flatnonzero(new)
        tails = inside[np.flatnonzero(np.diff(run, append=-1))]
        # sums are made in order, one after the other, however the stream is cut
        n, total = np.bincount(run, counts[t[inside]], len(heads)).astype(np.int64), np.bincount(run, totals[t[inside]], len(heads))
        who, first, last = t[heads], starts[t[heads]], ends[t[tails]]
        followed = np.concatenate((same, [False]))[: len(t)][tails]
        ahead = np.append(t[tails] + 1, len(code))[: len(tails)]  # a waiting row of the key, if it has one
        there = np.minimum(ahead, len(code) - 1)
        soon = (ahead < len(code)) & (code[there] == code[who]) & (starts[there] // 1000 - last // 1000 <= wait)
        closed = followed | ((last // 1000 + wait < mark) & ~soon)
        left = who[~closed]
        if len(waiting) or len(left):
            rest = [np.concatenate(c) for c in zip([c[waiting] for c in (keys, starts, ends, orders, counts, totals, hits, opened)], [keys[left], first[~closed], last[~closed], np.zeros(len(left), np.int64), n[~closed], total[~closed], np.ones(len(left), bool), np.ones(len(left), bool)], strict=True)]
            state.update(tuple(c.tolist() for c in rest))
            due = int(np.concatenate((starts[waiting] // 1000, last[~closed] // 1000 + wait)).min())
            state.setTimeoutTimestamp(max(due, mark, 1))
        elif state.exists:
            state.remove()
        done = closed & (n >= min_len)
        if done.any():
            yield pd.DataFrame({"_key": keys[who[done]], "_start": first[done], "_end": last[done], "n": n[done], "total": total[done]})

    at = F.col(time)
    narrow = samples.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.col(key).cast("string").alias("_key"), at.alias("_time"), F.unix_micros(at).alias("_us"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("_order"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"), F.coalesce(hit, F.lit(False)).alias("_hit"))
    found = narrow.where("_time IS NOT NULL").withWatermark("_time", late).groupBy("_bucket").applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("_key").cast(kind).alias(key), F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "n", "total")
