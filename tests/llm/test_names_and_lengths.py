"""Columns of any name through the stages, and private keys of any length."""

import random
import string

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarry.llm.queries")

from quarry.llm import decontaminate, secrets  # noqa: E402

NAMES = ("_quarry_gone", "_quarry_found", "_quarry_has", "_quarry_cut", "_quarry_k1", "_quarry_k2", "_quarry_before", "_row", "_text", "_masked", "_path", "a.b")


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train_forest(secrets.labelled_findings(spark))


def with_names(df):
    for c in NAMES:
        df = df.withColumn(c, F.lit(c))
    return df


def test_columns_of_any_name_stay(spark, forest):
    docs = with_names(spark.createDataFrame([(1, "password = 'x8Kq02mZpT41'", 25), (2, None, None), (3, "nothing here", 12)], "doc_id long, text string, n_chars long"))
    got = {r["doc_id"]: r for r in secrets.redact_secrets(docs, forest, chars_col="n_chars").collect()}
    assert secrets.redact_secrets(docs, forest).columns == docs.columns
    assert got[1]["text"] == "password = '[SECRET]'" and got[1]["n_chars"] == 21
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"], got[3]["n_chars"]) == (None, None, "nothing here", 12)
    assert all(got[i][c] == c for i in got for c in NAMES)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = with_names(spark.createDataFrame([(1, f"before it {item} and after"), (2, "other words"), (3, None)], "doc_id long, text string"))
    kept = decontaminate.drop_leaks(texts, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == texts.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert all(r[c] == c for r in kept.collect() for c in NAMES)


def test_a_private_key_without_an_end_is_taken_whole(spark, forest):
    rng = random.Random(6)
    line = lambda: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64))
    for lines in (450, 5000):
        text = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(f"Header-{'abcdefghi'[k]}: x" for k in range(9)) + "\n" + "\n".join(line() for _ in range(lines))
        df = spark.createDataFrame([(1, "see " + text)], "doc_id long, text string")
        found = secrets.find_secrets(df, forest).collect()
        assert [(r["start"], r["length"]) for r in found] == [(5, len(text))]
        assert secrets.redact_secrets(df, forest).first()["text"] == "see [SECRET]"


def test_a_private_key_with_many_dashes(spark, forest):
    text = "-----BEGIN PRIVATE KEY-----\n" + "ab-c--d---" * 300 + "\n-----END PRIVATE KEY-----"
    df = spark.createDataFrame([(1, text + " x")], "doc_id long, text string")
    assert secrets.redact_secrets(df, forest).first()["text"] == "[SECRET] x"
