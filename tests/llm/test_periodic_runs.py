"""Periodic runs against a brute force that tries every period of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarry.llm.queries")

from quarry.llm import periodic_runs as pr  # noqa: E402
from quarry.llm.queries import op12_periodic_runs  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_length=24, min_exponent=3):
    """Every maximal stretch alike to itself a period on, kept where no smaller period covers it."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            if length >= max(min_length, min_exponent * q) and not any((i, length, d) in found for d in range(1, q)):
                found[i, length, q] = True
            i = k + 1
    return sorted(found)


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(doc_id, text):
    words = edited(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def closed(words):
    ids = {w: k + 1 for k, w in enumerate(sorted(set(words)))}
    return np.array([ids[w] for w in words] + [0])


def test_suffix_order_and_minima():
    rng = random.Random(3)
    for _ in range(40):
        s = closed([rng.choice("ab") for _ in range(rng.randrange(1, 60))])
        order, rank, lcp = pr.suffix_order(s)
        want = sorted(range(len(s)), key=lambda i: list(s[i:]))
        assert order.tolist() == want and rank[order].tolist() == list(range(len(s)))
        for k in range(1, len(s)):
            a, b, n = want[k - 1], want[k], 0
            while s[a + n] == s[b + n]:
                n += 1
            assert lcp[k] == n
        nxt = pr.next_smaller(pr.minima(rank.astype(np.int32)), np.arange(len(s)))
        for i in range(len(s)):
            assert nxt[i] == next((j for j in range(i + 1, len(s)) if rank[j] < rank[i]), len(s))


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (1, 2), (9, 3), (12, 4)])
def test_runs_of_random_words(least):
    rng = random.Random(5)
    for trial in range(150):
        words = [rng.choice("ab" if trial % 2 else "abcd") for _ in range(rng.randrange(1, 40))]
        if trial % 3 == 0:
            p = rng.randrange(1, 12)
            at = rng.randrange(len(words))
            words[at:at] = [words[k % len(words) % p] for k in range(rng.randrange(20, 90))]
        assert [tuple(r) for r in pr.runs_of(closed(words), *least).tolist()] == brute_runs(words, *least)


def test_texts_taken_together_do_not_meet():
    words = [[b"a", b"b"] * 6, [b"a", b"b"] * 7, [], [b"x"] * 30, [b"y"], [b"a", b"b"] * 12]
    found = pr._runs_of_texts(words, 24, 3)
    assert [x.tolist() for x in found] == [[], [], [], [[0, 30, 1]], [], [[0, 24, 2]]]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(pr, "WORDS_AT_ONCE", 50)
    long = " ".join(["tick tock"] * 30_000)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, long), (5, "la " * 24), (5, "la " * 24), (6, "la " * 23), (None, "ha " * 40), (None, None), (7, "ñ x y " * 30), (8, "a b\x1ca b\x1c " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "_text", "_words", "_n", "_a", "_p", "_g", "_h", "runs", "n_words", "collapsed", "_best", "start"):
        docs = docs.withColumn(c, F.lit("x"))
    got = pr.run_digests(pr.find_runs(pr.with_periodic_tails(docs))).collect()
    quick = lambda i, t: expected(i, t) if t is not long else None
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, (tuple(r) for r in got if r["doc_id"] != 4))) == sorted(key(quick(i, t)) for i, t in rows if i != 4)
    whole = next(r for r in got if r["doc_id"] == 4)
    assert (whole["start"], whole["length"], whole["period"], whole["n_runs"]) == (0, 60_000, 2, 1) and whole["collapsed_sha256"] == digest("tick tock")
    assert pr.run_digests(pr.find_runs(pr.with_periodic_tails(docs.limit(0)))).count() == 0


def test_spans_and_text_of_the_operator(spark):
    docs = spark.createDataFrame([("k", "so " + "one two three " * 9 + "end")], "name string, body string")
    row = pr.find_runs(docs, "name", "body").first()
    assert row["n_words"] == 29 and [tuple(r) for r in row["runs"]] == [(1, 27, 3)] and row["collapsed"] == "so one two three end"
    with pytest.raises(ValueError):
        pr.find_runs(docs, "name", "body", min_exponent=1)
