"""A written inverted index of texts that grows by batches: postings by term, changes of term counts.

Three tables lie under one folder. ``documents`` has the documents of each batch,
``postings`` their terms, ``changes`` by how much a batch changes the document
frequency of terms. Each batch is a partition of its own and is written by dynamic
overwrite, so a batch that is written again replaces itself. A document that comes
again is taken as a new version: earlier postings stay but no longer count.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieval import term_frequencies, tokens

BUCKETS = 16
#: Rows of ids or terms that are sent to every task.
FEW = 200_000


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    """The bucket, a folder of the index, that a term's postings lie in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def broadcast_few(df: DataFrame) -> DataFrame:
    """``df``, marked to be broadcast where it has ``FEW`` rows or fewer, which are counted."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _schemas(kind: T.DataType) -> dict[str, T.StructType]:
    f = T.StructField
    return {
        "documents": T.StructType([f("id", kind), f("n_tokens", T.LongType()), f("batch", T.LongType())]),
        "postings": T.StructType([f("id", kind), f("term", T.StringType()), f("n", T.LongType()), f("n_tokens", T.LongType()), f("batch", T.LongType()), f("bucket", T.IntegerType())]),
        "changes": T.StructType([f("term", T.StringType()), f("df", T.LongType()), f("cf", T.LongType()), f("docs", T.LongType()), f("batch", T.LongType()), f("bucket", T.IntegerType())]),
    }


def _table(spark: SparkSession, path: str, name: str, kind: T.DataType) -> DataFrame:
    """A table of the index; without rows where nothing has been written yet."""
    schema = _schemas(kind)[name]
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, name: str, *parts: str) -> None:
    # rebalancing splits a bucket that a frequent term makes large
    df.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")


def add_batch(docs: DataFrame, path: str, batch: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Adds the documents of one batch to the index.

    Rows with a null id are left out, of rows with one id the one with the greatest
    text counts, and a null text has no tokens. Written again, a batch replaces
    itself; batches must come in the order of their numbers.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    one = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(text_col).alias("_text"))
    cut = one.select("id", F.coalesce(tokens(F.col("_text")), F.array().cast("array<string>")).alias("_t")).persist()
    try:
        number = F.lit(batch).cast("long").alias("batch")
        _write(cut.select("id", F.size("_t").cast("long").alias("n_tokens"), number), path, "documents", "batch")
        terms = cut.select("id", F.size("_t").cast("long").alias("n_tokens"), F.explode("_t").alias("term"))
        counted = terms.groupBy("id", "term", "n_tokens").agg(F.count("*").alias("n"))
        _write(counted.select("id", "term", "n", "n_tokens", number, bucket_of(F.col("term"), buckets).alias("bucket")), path, "postings", "batch", "bucket")
    finally:
        cut.unpersist()
    mine, before = F.col("batch") == batch, F.col("batch") < batch
    seen, posted = _table(spark, path, "documents", kind), _table(spark, path, "postings", kind)
    # versions that this batch replaces: the last one before it of each of its documents
    old = seen.where(before).join(seen.where(mine).select("id"), "id", "left_semi").groupBy("id").agg(F.max("batch").alias("batch"))
    more = posted.where(mine).select("term", "bucket", "n", F.lit(1).alias("sign"))
    less = posted.where(before).join(old, ["id", "batch"]).select("term", "bucket", "n", F.lit(-1).alias("sign"))
    by_term = more.unionByName(less).groupBy("term", "bucket").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("n")).alias("cf"), F.lit(0).cast("long").alias("docs"))
    grown = seen.where(mine).select("id").join(seen.where(before).select("id"), "id", "left_anti").agg(F.count("*").alias("docs"))
    # the number of documents is the change of no term
    whole = grown.select(F.lit(None).cast("string").alias("term"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("cf"), "docs")
    _write(by_term.unionByName(whole).select("term", "df", "cf", "docs", number, "bucket"), path, "changes", "batch", "bucket")


def live_postings(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """``id, term, n, n_tokens, bucket`` of the last version of every document."""
    held = _table(spark, path, "documents", kind).groupBy("id").agg(F.max("batch").alias("_last"), F.collect_list("batch").alias("_all")).where("size(_all) > 1")
    # versions that later ones replace, few as a rule: postings are not moved for them
    old = held.select("id", "_last", F.explode("_all").alias("batch")).where("batch < _last").drop("_last")
    return _table(spark, path, "postings", kind).join(broadcast_few(old), ["id", "batch"], "left_anti").drop("batch")


def term_counts(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """``term, bucket, df, cf``: in how many documents a term is, and how often."""
    return _table(spark, path, "changes", kind).where("term IS NOT NULL").groupBy("term", "bucket").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


def document_count(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """``N``, one row: how many documents the index holds."""
    return _table(spark, path, "changes", kind).where("term IS NULL").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("N"))


def search(queries: DataFrame, path: str, kind: T.DataType, buckets: int = BUCKETS) -> DataFrame:
    """``query_id, id, score`` above 0 as ``retrieval.tfidf_scores`` gives them, from the index alone.

    ``queries`` (query_id, query) are the stated few: their terms are collected to
    name the buckets to read, so postings of other buckets are not opened, nor is any
    text; and only their terms' counts are summed.
    """
    spark = queries.sparkSession
    q = term_frequencies(queries, "query_id", "query").withColumnRenamed("tf", "qtf").withColumn("bucket", bucket_of(F.col("term"), buckets))
    asked = sorted({r["bucket"] for r in q.select("bucket").distinct().collect()})
    df = term_counts(spark, path, kind).where(F.col("bucket").isin(asked)).join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    idf = df.crossJoin(F.broadcast(document_count(spark, path, kind))).select("term", (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = F.broadcast(q.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    posted = live_postings(spark, path, kind).where(F.col("bucket").isin(asked))
    hits = posted.join(weighed, "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("n") / F.col("n_tokens")).alias("score"))
    return hits.where("score > 0")
