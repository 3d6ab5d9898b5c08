"""Chooses KEEP and REPEATS of the toxicity model by folds inside its training rows; run by hand.

    python tests/llm/choose_toxicity.py [/root/testdata/sf0.1]

Held-out rows (crc32 of the id mod 3 is 1) are never read. Terms are chosen, and the
machine is fitted, on three of four folds of distinct texts; the fourth is scored.
"""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import toxicity  # noqa: E402
from quarry.session import session  # noqa: E402

FOLDS = 4
KEEPS = (None, 0.15, 0.3, 0.5, 0.7)


def scores(found, keep):
    """Hits, misses, false alarms and log loss at the threshold over all folds."""
    hits = missed = false = 0
    loss = n = 0.0
    for k in range(FOLDS):
        fold = F.pmod(F.xxhash64("_h", F.lit(5)), F.lit(FOLDS)) == k
        picked, rows, y = toxicity.chosen_terms(found.where(~fold))
        model = toxicity.fit(*(toxicity.with_thinned(rows, y, keep) if keep else (rows, y)), picked)
        place = {int(t): i for i, t in enumerate(picked)}
        for r in found.where(fold).select("_y", "_terms").collect():
            at = [place[t] for t in r["_terms"] if t in place]
            v = model.factors[at]
            z = model.bias + (model.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()) if at else 0.0)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yes = p >= toxicity.THRESHOLD
            hits, missed, false = hits + (yes and r["_y"] == 1), missed + (not yes and r["_y"] == 1), false + (yes and r["_y"] == 0)
            loss -= np.log(np.clip(p if r["_y"] else 1 - p, 1e-9, 1))
            n += 1
    return int(hits), int(missed), int(false), round(float(loss / n), 4)


def with_terms(texts, repeats):
    """Training rows whose terms have other ``REPEATS``; workers have the module's own, so they are told."""

    def terms(batches):
        toxicity.REPEATS = repeats or (10**9,)
        for b in batches:
            yield b[["_id", "_y", "_h"]].assign(_terms=[sorted(toxicity.terms_of_text(x)) for x in b["text"]])

    return toxicity.materialize(texts.mapInPandas(terms, "_id long, _y int, _h long, _terms array<int>"), "other-terms")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = session("local[2]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for keep in KEEPS:
        print("keep", keep, "hits, missed, false alarms, log loss:", *scores(found, keep), flush=True)
    texts = found.drop("_terms").join(docs.select(F.col("doc_id").alias("_id"), "text"), "_id")
    for repeats in ((2,), (2, 3, 4, 6), ()):
        print("repeats", repeats, "hits, missed, false alarms, log loss:", *scores(with_terms(texts, repeats), toxicity.KEEP), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
