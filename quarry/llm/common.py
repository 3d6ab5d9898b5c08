"""What the training-data operators share: shared tables, exact helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset a temporary folder
    stands in, which is only right where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here.

    A lost executor costs a re-read of that table, never a recomputation, and
    what depends on the order of tasks (partition ids) is fixed once.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"quarry-{uuid.uuid4().hex[:12]}-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    _written(spark).append(path)
    return out


def _written(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialize`` has written and nobody has removed."""
    context = spark.sparkContext
    if not hasattr(context, "_quarry_tables"):
        context._quarry_tables = []
    return context._quarry_tables


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, known = spark.sparkContext._jvm, _written(spark)
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        known.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for t in tables:
        if (path := getattr(t, "_quarry_path", None)) in _written(t.sparkSession):
            _remove(t.sparkSession, [path])


def tables_so_far(spark: SparkSession) -> set[str]:
    """A mark for ``discard_since``."""
    return set(_written(spark))


def discard_since(spark: SparkSession, mark: set[str], keep: DataFrame) -> None:
    """Removes all tables written since the mark but ``keep``, which must be a written one."""
    _remove(spark, [p for p in _written(spark) if p not in mark and p != keep._quarry_path])


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on, unless they are smaller already.

    Workers hold a batch of whole texts and what is made of it, so this bounds
    their memory; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def packed_row(df: DataFrame) -> Column:
    """All columns of a table as one struct ``_row``, so that helper columns beside it clash with none of their names."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_row")


def unpacked_row(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns that ``packed_row`` put into ``_row``, under their names; ``instead`` replaces some of them."""
    return df.select(*[instead.get(c, F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(names)])


def parts_for(rows: int, each: int) -> int:
    """How many partitions of about ``each`` rows hold ``rows``; 1 at least."""
    return max(1, -(-rows // each))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_key(col: Column) -> Column:
    """A string key under which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def ranked(df: DataFrame, order: list[Column], rank: str, rows_per_part: int = 200_000) -> DataFrame:
    """``df`` with its 0-based position under ``order``, without a single-task sort.

    Rows are range-partitioned, written with their partition's number, numbered
    within each partition and moved on by the rows of those before.
    """
    cols = df.columns
    fixed = materialize(df, "rank-in")
    parts = parts_for(fixed.count(), rows_per_part)
    ranged = materialize(fixed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "_part").select(*cols, (F.row_number().over(inside) - 1 + F.col("_before")).alias(rank))
