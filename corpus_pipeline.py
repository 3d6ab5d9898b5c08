"""A training corpus from raw documents: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the
next one works on all of them. Side tables (labels, benchmark) are read from
``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import secrets, toxicity
from quarry.llm.common import bound_batches, discard_since, materialize, tables_so_far
from quarry.llm.decontaminate import drop_leaks
from quarry.llm.mixing import mix_sources
from quarry.llm.simhash import keep_one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, by a model of the labels, is under the threshold.

    A null or empty text has the score of the bias and stays; repeated rows have
    equal scores. All columns are kept whatever their names.
    """
    bound_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 of their five-word shingles.

    Texts without words are one group; of equal rows one stays (see
    ``keep_one_of_each``). All columns are kept whatever their names.
    """
    return keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts stay, as do all columns."""
    bound_batches(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and ``n_chars`` counted again where that changed a text.

    Null and empty texts stay as they are; no row is dropped, and all columns are kept
    whatever their names.
    """
    return secrets.redact_secrets(docs, secrets.train_forest(secrets.labelled_findings(spark)), chars_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many it takes (repeats counted).

    A null source is a source; texts without words are not taken. Of the input's
    columns, those of ``COLUMNS`` that it has are returned.
    """
    keep = tuple(c for c in COLUMNS if c in docs.columns and c != "doc_id")
    return mix_sources(docs, keep=keep).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scan", mask_secrets),
    ("source mixing", mix),
]

#: Factorization machine, forest and hashing are beyond SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = tables_so_far(spark)
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard_since(spark, before, docs)  # what the stage had written for itself
    return STAGES[-1][1](spark, docs, sf_dir)
