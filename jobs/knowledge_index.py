"""Keeps a knowledge index up to date: takes the texts that are new and adds them to an inverted index.

    spark-submit jobs/knowledge_index.py --config jobs/knowledge_index.json \
        [--documents PATH] [--output PATH] [--checkpoint PATH] [--ask "words of a question"]

A file stream reads what is new under ``documents`` (Parquet files of one schema: a
folder that grows, or one file) and ends when that is taken. The stream's checkpoint is the mark
of what has been read. Each of its batches is written as a partition of its own, by
dynamic overwrite, so a batch that is taken again after a failure replaces itself,
and a run without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import index, retrieval  # noqa: E402
from quarry.session import session, ship_package  # noqa: E402
from quarry.sources import views  # noqa: E402

log = logging.getLogger("knowledge_index")


def run(spark: SparkSession, conf: dict) -> dict:
    """Takes what is new and returns what was done: batches, rows read, documents and terms held.

    ``conf``: ``documents``, ``output``, ``checkpoint`` (paths), ``id``, ``text``
    (columns), ``buckets`` and ``files_per_batch``.
    """
    id_col, text_col = conf.get("id", "doc_id"), conf.get("text", "text")
    buckets, path = int(conf.get("buckets", index.BUCKETS)), conf["output"]
    taken: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        index.add_batch(batch, path, number, id_col, text_col, buckets)
        taken.append(batch.count())  # of files: from their footers
        log.info("batch %d of %d rows is in %s", number, taken[-1], path)

    stream = views.stream(spark, conf["documents"], [id_col, text_col], maxFilesPerTrigger=str(conf.get("files_per_batch", 64)))
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", conf["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(taken)
    log.info("read %d new rows of %s in %d batches", read, conf["documents"], len(taken))
    kind = stream.schema[id_col].dataType
    held = {"documents": index.document_count(spark, path, kind).first()["N"], "terms": index.term_counts(spark, path, kind).count()}
    log.info("%s holds %d documents and %d terms", path, held["documents"], held["terms"])
    return {"batches": len(taken), "rows": read, **held}


def contents(spark: SparkSession, conf: dict) -> DataFrame:
    """The whole index: ``doc_id, term, n, n_tokens, df`` of every term of every document as it is now."""
    kind = spark.read.parquet(conf["documents"]).schema[conf.get("id", "doc_id")].dataType
    terms = index.term_counts(spark, conf["output"], kind).select("term", "df")
    return index.live_postings(spark, conf["output"], kind).join(index.broadcast_few(terms), "term").select(F.col("id").alias("doc_id"), "term", "n", "n_tokens", "df")


def ask(spark: SparkSession, conf: dict, question: str, k: int = 3) -> DataFrame:
    """The ``k`` best documents for a question, from the index alone."""
    kind = spark.read.parquet(conf["documents"]).schema[conf.get("id", "doc_id")].dataType
    asked = spark.range(1).select(F.lit(1).alias("query_id"), F.lit(question).alias("query"))
    return retrieval.top_k(index.search(asked, conf["output"], kind, int(conf.get("buckets", index.BUCKETS))), "id", k)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", required=True, help="JSON file of settings")
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", help=f"in place of the setting {name}")
    p.add_argument("--ask", help="print the best documents for these words")
    given = vars(p.parse_args())
    conf = json.loads(Path(given["config"]).read_text()) | {k: v for k, v in given.items() if v and k in ("documents", "output", "checkpoint")}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session()
    try:
        ship_package(spark)
        run(spark, conf)
        if given["ask"]:
            ask(spark, conf, given["ask"]).show(truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
