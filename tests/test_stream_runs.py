"""Runs on a stream against gaps and islands over the whole table."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarry.streaming.runs import threshold_runs

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "well long, ts timestamp, seq long, x double"


def brute(rows, mark, idle, min_len=3):
    """Runs that are known to have ended once all rows before ``mark`` are final."""
    out, wells = [], defaultdict(list)
    for w, t, q, x in rows:
        if t is not None and t < mark:
            wells[w].append((t, q, x))
    for w, s in wells.items():
        run = []
        for t, q, x in [*sorted(s, key=lambda r: r[:2]), (None, 0, None)]:
            end = t is None
            if run and ((end and run[-1][0] + idle < mark) or (not end and (t - run[-1][0] > idle or not (x is not None and x >= 5)))):
                if len(run) >= min_len:
                    out.append((w, run[0][0], run[-1][0], len(run), round(sum(r[2] for r in run), 6)))
                run = []
            if not end and x is not None and x >= 5:
                run.append((t, q, x))
    return sorted(out, key=str)


def streamed(spark, tmp_path, name, batches, **more):
    """The rows of a stream over files that come one by one."""
    at = f"{tmp_path}/{name}"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        runs = threshold_runs(src, F.col("x") >= 5, "well", "seq", "x", **more)
        q = runs.writeStream.option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    got = spark.read.parquet(f"{at}/out").collect()
    as_utc = lambda t: t.astimezone(timezone.utc)
    return sorted(((r["well"], as_utc(r["start"]), as_utc(r["end"]), r["n"], round(r["total"], 6)) for r in got), key=str)


def samples(rng, n, start=0):
    rows = []
    for i in range(n):
        t = ZERO + timedelta(minutes=(start + i) * 7 + rng.randrange(5))
        rows.append((rng.randrange(3), t, i % 4, rng.choice([None, 1.0, 6.0, 7.5, 8.0, 9.0, 9.5])))
    return rows


@pytest.mark.parametrize("cuts", [1, 3])
def test_rows_of_the_whole_table(spark, tmp_path, cuts):
    """Rows come out of order within the hour, in one batch or in three; a last row moves the watermark over all."""
    rng = random.Random(1)
    rows = samples(rng, 160)
    last = [(9, ZERO + timedelta(days=60), 0, 1.0)]
    parts = [rows[i * len(rows) // cuts : (i + 1) * len(rows) // cuts] for i in range(cuts)]
    for p in parts:
        rng.shuffle(p)
    got = streamed(spark, tmp_path, "a", [*parts, last], late="3 hours", idle="1 day")
    want = brute(rows + last, ZERO + timedelta(days=60) - timedelta(hours=3), timedelta(days=1))
    assert got == want and len(want) > 5


def test_late_rows_and_idle_keys(spark, tmp_path):
    t = lambda m: ZERO + timedelta(minutes=m)
    first = [(1, t(k), 0, 6.0) for k in (0, 1, 2, 3)] + [(2, t(k), 0, 6.0) for k in (0, 1)] + [(None, t(k), 0, 6.0) for k in range(3)] + [(1, None, 0, 6.0)]
    # well 2 goes on and is broken by a null; a row from before the watermark comes too late; 3 is still open at the end
    second = [(3, t(600), 0, 9.0)]
    third = [(2, t(2), 0, 6.0), (3, t(601), 0, 9.0), (3, t(602), 0, 9.0)]
    got = streamed(spark, tmp_path, "b", [first, second, third, [(4, t(700), 0, 1.0)]], late="1 hour", idle="2 hours")
    assert [(r[0], r[3]) for r in got] == [(1, 4), (None, 3)]


def test_state_is_cleared(spark, tmp_path):
    at = f"{tmp_path}/c"
    rows = [(k, ZERO + timedelta(minutes=m), 0, 6.0) for k in range(5) for m in range(4)]
    q = None
    for part in (rows, [(99, ZERO + timedelta(days=9), 0, 1.0)], [(99, ZERO + timedelta(days=30), 0, 1.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        runs = threshold_runs(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), F.col("x") >= 5, "well", "seq", "x")
        q = runs.writeStream.option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    assert spark.read.parquet(f"{at}/out").count() == 5
    assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) <= 1  # the last row's own key


def test_keys_share_calls_and_state(spark, tmp_path):
    """4,000 keys are held in at most 64 rows of state, in three batches, with the rows of the whole table; keys keep their type."""
    rng = random.Random(6)
    rows = [(k if k else None, ZERO + timedelta(minutes=10 * i + rng.randrange(9)), i, rng.choice([None, 1.0, 6.1, 7.7, 8.3])) for k in range(4000) for i in range(6)]
    rng.shuffle(rows)
    last = [(2**60 + 1, ZERO + timedelta(minutes=110), 0, 1.0)]
    at = f"{tmp_path}/d"
    q = None
    for part in (rows[:9000], rows[9000:], last):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        runs = threshold_runs(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), F.col("x") >= 5, "well", "seq", "x", buckets=64)
        q = runs.writeStream.option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
        assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) <= 64
    out = spark.read.parquet(f"{at}/out")
    assert out.schema["well"].dataType.simpleString() == "bigint"
    got = sorted(((r["well"], r["start"].astimezone(timezone.utc), r["end"].astimezone(timezone.utc), r["n"], round(r["total"], 6)) for r in out.collect()), key=str)
    want = brute(rows + last, ZERO + timedelta(minutes=50), timedelta(days=1))
    assert got == want and len(want) > 50
