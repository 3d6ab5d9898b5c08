"""Personal data: base spans against a brute force, added spans on plain and disguised forms."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarry.llm.queries")

from quarry.llm import pii  # noqa: E402
from quarry.llm.queries import op11_pii  # noqa: E402

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text, kinds=tuple(PATTERNS)):
    return [(kind, m.start(), m.end()) for kind, rx in PATTERNS.items() if kind in kinds for m in re.finditer(rx, text or "") if valid(kind, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def spans_of(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in pii.find_pii(docs, model).collect()}


def test_base_spans_of_random_strings(spark, model):
    rng = random.Random(11)
    pieces = ["a@b.c", "a@b", "%d@e.f", "..", "1.2.3.4", "300.1.1.1", "001.0255.3.4", ".5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "12  34", "+1 (843) 555-7672", "+", "++44 20", " 170.106.47.218", "é", "👍", "\n", " ", "-", "7", "0000000000000000", "x9", "@", "_", "+12345678", "5 5"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    got = spans_of(spark, model, texts)
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[3]] == brute_base(t), t


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(map(lambda b: joined([b]), base)) <= set(r["spans"].split(",")) | {""}
        starts = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts)
    assert any(r["spans"] for r in got)


def test_added_spans(spark, model):
    texts = [
        "mail to anna [at] example [dot] com please",
        "call +1 (843) 555-7672 170.106.47.218 now",
        "cards 4556737586899855 4929421234600821 here",
        "phone: (843) 555-7672",
        "look at home. Then we met at the river",
        "release version 12.4.17.3000 is out",
        "order 4556737586899856 was sent",
        "in 1999-2003 and 2024-01-15",
    ]
    got = spans_of(spark, model, texts)
    found = lambda i: {(k, texts[i][a:b]) for k, a, b, _ in got[i]}
    assert found(0) == {("email", "anna [at] example [dot] com")}
    assert found(1) == {("ip", "170.106.47.218"), ("phone", "+1 (843) 555-7672")}
    assert found(2) == {("card", "4556737586899855"), ("card", "4929421234600821")}
    assert found(3) == {("phone", "(843) 555-7672")}
    assert not any(got[i] for i in (4, 5, 6, 7))


def test_held_out_findings(spark, model):
    """Made findings that were not fitted on: precision and recall at the calibrated thresholds."""
    rows = pii.made_proposals(pii.made_findings(spark, 3000, 50_000))
    at = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {t!r}D" for k, t in model.thresholds.items()) + " END"
    n = {(r["label"], r["yes"]): r["count"] for r in rows.selectExpr("label", f"{model.score} >= {at} AS yes").groupBy("label", "yes").count().collect()}
    right, wrong, missed = n[1.0, True], n.get((0.0, True), 0), n.get((1.0, False), 0)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.85


def test_equal_tables_give_equal_models(spark, model):
    assert pii.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "text")) == model


def test_awkward_rows(spark, model):
    long = ("a" * 50_000 + " ") * 3 + "1." * 40_000 + " " + "4 " * 40_000 + "+1" * 20_000 + " me@host.org"
    many = " ".join(f"u{i}@mail.example.com 10.0.{i % 256}.{i % 250}" for i in range(4000))
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (5, "x@y.zz"), (5, "x@y.zz"), (6, long), (7, many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "_text", "_t", "_w", "_spans", "_props", "_more", "spans", "kind", "_b_ip", "_c_ip", "_row", "_done"):
        docs = docs.withColumn(c, F.lit("x"))
    # a plain search for addresses would need the square of the long text's runs
    of_long = [("email", len(long) - 11, len(long)), *brute_base(long, ("ip", "card", "phone"))]
    began = time.time()
    got = pii.find_pii(docs, model).collect()
    assert time.time() - began < 60
    assert sorted((str(r["doc_id"]), joined((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"])) for r in got) == sorted((str(i), joined(brute_base(t) if i != 6 else of_long)) for i, t in rows)
    assert pii.find_pii(docs.limit(0), model).count() == 0
    assert pii.train(docs.limit(0)).thresholds.keys() == set(pii.KINDS)


def test_redaction_keeps_rows_and_columns(spark, model):
    docs = spark.createDataFrame([(1, "to x@y.zz or +1 (843) 555-7672 170.106.47.218.", "k"), (2, None, None), (3, "", "e"), (4, "clean é 👍", "")], "doc_id long, text string, _t string")
    got = {r["doc_id"]: r for r in pii.redact_pii(docs, model).collect()}
    assert pii.redact_pii(docs, model).columns == docs.columns
    assert got[1]["text"] == "to [EMAIL] or [PHONE] [IP]." and got[1]["_t"] == "k"
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "clean é 👍"


def test_no_python_in_the_plan(spark, model):
    plan = pii.find_pii(spark.read.parquet(f"{SF}/documents.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_every_document_is_labelled(spark):
    """More documents than a sample would hold, one rare form in each of a few of them."""
    docs = spark.range(45_000).selectExpr("id AS doc_id", "if(id % 15000 = 7, concat('server ', id % 256, '.1.2.3 is up'), 'nothing here') AS text")
    found = pii.labelled_proposals(docs).collect()
    assert [(r["label"], r["is_ip"]) for r in found] == [(1.0, 1.0)] * 3


def test_findings_dealt_over_partitions(spark, model, monkeypatch):
    """As many partitions as the different findings need; thresholds and scores stay usable."""
    monkeypatch.setattr(pii, "FIT_ROWS", 300)
    dealt = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert dealt.thresholds.keys() == model.thresholds.keys() and all(t <= 1 for t in dealt.thresholds.values())


def test_gates_lose_no_proposal(spark, monkeypatch):
    """What the generators propose in a text is the same when every pattern is tried on every text."""
    rng = random.Random(5)
    pieces = ["anna", " at ", " AT\n", "\tat ", "b.de", "acme", ".", " . ", " dot ", " [dot] ", " [at] ", "{ at }", "<@>", " @ ", "@", "x_y", "4111 1111 1111 1111", "10.0.0.1", "fe80::1", "a:b:c:d:e:f:a:b", "(843) 555-7672", "+12345678", " ", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 10))) for _ in range(2000)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, "write to anna at example.com today"), (-2, "anna at example . com")], "id long, _t string")
    props = lambda: {r["id"]: [(p["kind"], p["start"], p["end"]) for p in r["p"]] for r in pii._with_proposals(docs, "_t").selectExpr("id", "transform(_props, p -> struct(p.kind, p.start, p.end)) AS p").collect()}
    gated = props()
    assert gated[-1] == [("email", 9, 28)] and gated[-2] == [("email", 0, 21)]
    monkeypatch.setattr(pii, "_GATE", dict.fromkeys(pii.KINDS, ""))
    assert gated == props()


def test_plain_at_before_an_address(spark, model):
    """A plain "at" before a disguised address is no part of it, and one that marks an address is found without other marks."""
    texts = ["mail me at john.smith [at] example [dot] com now", "write to anna at example.com today", "mail us at info_x.y @ acme.org", "look at house.Then we"]
    got = spans_of(spark, model, texts)
    assert [[(k, texts[i][a:b]) for k, a, b, _ in got[i]] for i in range(4)] == [[("email", "john.smith [at] example [dot] com")], [("email", "anna at example.com")], [("email", "info_x.y @ acme.org")], []]


def test_long_texts_of_marks(spark, model):
    """Time stays linear where marks of addresses repeat."""
    n = 20_000
    texts = ["x at " * n, "x at " + "a dot " * n, "x at " + "a dot " * n + "b@c.dd", "a at b.c " * n, "x at a.b_ " * n, "x at a.b" + "_%" * n, "a at b.c [at] " * n, "at dot " * n]
    began = time.time()
    assert len(spans_of(spark, model, texts)) == len(texts)
    assert time.time() - began < 60
