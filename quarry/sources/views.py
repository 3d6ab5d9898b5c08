"""Curves, sections and detections as views over the star-schema tables.

The tables hold no logs or seismics; these views give every operator data of
the right shape, with total orders so that results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP_M, TOP_M = 0.1524, 1000.0
#: Samples of a task, about, where tables are dealt out by wells; a well is never cut.
ROWS_EACH = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A stream of what is new in Parquet files of one schema: a folder that grows, or one file.

    The path is given as a pattern, for a stream takes a folder or a pattern, but not the path of a single file.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema if columns is None else spark.read.parquet(path).select(*columns).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def by_wells(df: DataFrame) -> DataFrame:
    """``df`` dealt out by its wells to as many tasks as its rows need, few rows as Spark deals them."""
    tasks = -(-df.count() // ROWS_EACH)
    return df if tasks <= 1 else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), "well")


def with_depth(df: DataFrame, well: str, order: list[str]) -> DataFrame:
    """Adds ``well, idx, depth``: the 0-based sample number under ``order`` and its depth.

    Samples are numbered by ``well`` itself, so windows and groups of wells that follow move no row again.
    """
    w = Window.partitionBy("well").orderBy(*order)
    return by_wells(df.withColumn("well", F.col(well))).withColumn("idx", F.row_number().over(w) - 1).withColumn("depth", F.lit(TOP_M) + F.lit(STEP_M) * F.col("idx"))


def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``well, idx, depth, x``: the values of each user's events in time."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"))
    return with_depth(ev, "user_id", ["ts", "event_id"]).select("well", "idx", "depth", "x")


def line_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``well, idx, depth, gr, rt, den, cnl``: a log per supplier, a sample per line item."""
    q = F.col("l_quantity")
    gr = F.lit(150.0) * q * q * q * q * q * q / F.lit(15625000000.0)
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", gr.alias("gr"), (F.col("l_extendedprice") / 4000.0).alias("rt"), (F.lit(2.0) + F.lit(8.0) * F.col("l_discount")).alias("den"), (F.lit(5.0) * F.col("l_tax")).alias("cnl"))
    return with_depth(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).select("well", "idx", "depth", "gr", "rt", "den", "cnl")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``il, trace, samples``: one row per trace, a section per embedding label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("il"), (F.row_number().over(w) - 1).alias("trace"), F.col("embedding").cast("array<double>").alias("samples"))


def correlated_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``il, trace, samples``: each section's first trace, a sample lower every twenty traces, with half of each one's own added."""
    w = Window.partitionBy("il").orderBy("trace")
    both = traces(spark, sf_dir).withColumn("base", F.first("samples").over(w))
    mixed = "transform(sequence(0, size(samples) - 1), i -> base[cast(pmod(i - trace div 20, size(samples)) as int)] + 0.5D * samples[i])"
    return both.select("il", "trace", F.expr(mixed).alias("samples"))


def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``il, trace, s, amp``: the long form of the traces."""
    return traces(spark, sf_dir).select("il", "trace", F.posexplode("samples").alias("s", "amp"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with class and confidence, one per embedding."""
    e = lambda i: F.col("embedding")[i - 1].cast("double")
    corner = lambda i: F.least(F.greatest(F.lit(0.35) + F.lit(1.5) * e(i), F.lit(0.0)), F.lit(0.7))
    box = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("image"), F.pmod("vec_id", F.lit(4)).cast("int").alias("class_id"), corner(1).alias("x1"), corner(2).alias("y1"), (F.lit(0.15) + F.abs(e(3))).alias("bw"), (F.lit(0.15) + F.abs(e(4))).alias("bh"), F.least(F.lit(1.0), F.lit(3.0) * F.abs(e(5))).alias("confidence"), F.abs(e(6)).alias("e6"))
    return box.select(F.col("vec_id").alias("det_id"), "image", "class_id", "x1", "y1", (F.col("x1") + F.col("bw")).alias("x2"), (F.col("y1") + F.col("bh")).alias("y2"), "confidence", "e6")


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per detection: some by id, some by a slightly moved box alone."""
    d = detections(spark, sf_dir)
    lost = F.pmod("det_id", F.lit(5)) == 0
    moved = lambda c: F.when(lost, F.col(c) + F.lit(0.01)).otherwise(F.col(c)).alias(c)
    return d.select(F.col("det_id").alias("ver_id"), F.when(~lost, F.col("det_id")).alias("result_id"), "image", "class_id", *[moved(c) for c in ("x1", "y1", "x2", "y2")], (F.pmod("det_id", F.lit(3)) != 0).alias("is_real"), F.when(F.pmod("det_id", F.lit(7)) != 0, F.least(F.lit(1.0), F.lit(4.0) * F.col("e6"))).alias("confidence"))


def ground_truth(spark: SparkSession) -> DataFrame:
    """The sand intervals that segmentations are scored against."""
    rows = [("s1", 1200.0, 1255.0), ("s2", 1400.0, 1435.0), ("s3", 1550.0, 1625.0), ("s4", 1750.0, 1805.0), ("t1", 1010.0, 1022.0), ("t2", 1050.0, 1061.0)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("gt_id"), F.lit(t).alias("gt_top"), F.lit(b).alias("gt_bottom")) for a, t, b in rows])))


#: The same views for the DuckDB side, as common table expressions.
SQL = {
    "curve_ev": "curve_ev AS (SELECT user_id AS well, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 1000e0 + 0.1524e0 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS depth, value AS x FROM events)",
    "curve_li": "curve_li AS (SELECT l_suppkey AS well, rn - 1 AS idx, 1000e0 + 0.1524e0 * (rn - 1) AS depth, 150e0 * q * q * q * q * q * q / 15625000000e0 AS gr, l_extendedprice / 4000e0 AS rt, 2e0 + 8e0 * l_discount AS den, 5e0 * l_tax AS cnl FROM (SELECT *, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem))",
    "section": "tr AS (SELECT label AS il, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS trace, embedding::DOUBLE[] AS samples FROM embeddings), section AS (SELECT il, trace, generate_subscripts(samples, 1) - 1 AS s, unnest(samples) AS amp FROM tr)",
    "correlated": "plain AS (SELECT label AS il, row_number() OVER w - 1 AS trace, embedding::DOUBLE[] AS own, (first_value(embedding) OVER w)::DOUBLE[] AS base FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)), tr AS (SELECT il, trace, list_transform(range(0, len(own)), lambda i: base[((i - trace // 20) % len(own) + len(own)) % len(own) + 1] + 0.5e0 * own[i + 1]) AS samples FROM plain)",
    "det": "det AS (SELECT vec_id AS det_id, label AS image, (vec_id % 4)::INT AS class_id, x1, y1, x1 + (0.15e0 + abs(e[3])) AS x2, y1 + (0.15e0 + abs(e[4])) AS y2, least(1e0, 3e0 * abs(e[5])) AS confidence, abs(e[6]) AS e6 FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, least(greatest(0.35e0 + 1.5e0 * embedding[1]::DOUBLE, 0e0), 0.7e0) AS x1, least(greatest(0.35e0 + 1.5e0 * embedding[2]::DOUBLE, 0e0), 0.7e0) AS y1 FROM embeddings))",
    "ver": "ver AS (SELECT det_id AS ver_id, CASE WHEN det_id % 5 <> 0 THEN det_id END AS result_id, image, class_id, CASE WHEN det_id % 5 = 0 THEN x1 + 0.01e0 ELSE x1 END AS x1, CASE WHEN det_id % 5 = 0 THEN y1 + 0.01e0 ELSE y1 END AS y1, CASE WHEN det_id % 5 = 0 THEN x2 + 0.01e0 ELSE x2 END AS x2, CASE WHEN det_id % 5 = 0 THEN y2 + 0.01e0 ELSE y2 END AS y2, det_id % 3 <> 0 AS is_real, CASE WHEN det_id % 7 <> 0 THEN least(1e0, 4e0 * e6) END AS confidence FROM det)",
    "gt": "gt(gt_id, gt_top, gt_bottom) AS (VALUES ('s1', 1200e0, 1255e0), ('s2', 1400e0, 1435e0), ('s3', 1550e0, 1625e0), ('s4', 1750e0, 1805e0), ('t1', 1010e0, 1022e0), ('t2', 1050e0, 1061e0))",
}


def with_views(names: str, body: str) -> str:
    """``body`` after the named views, as one statement."""
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE", "").strip()
    parts = ", ".join(SQL[n] for n in names.split())
    return f"WITH {recursive}{parts}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
