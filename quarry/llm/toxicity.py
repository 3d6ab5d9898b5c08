"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, materialize

#: Labelled documents that the model is fitted on at most: those of smallest hash.
MAX_TRAIN = 16_000
#: Hash buckets of terms, and how many of them the model has weights for.
BUCKETS, MAX_TERMS = 1 << 20, 2048
#: Beginnings of words that are terms besides the words: they carry over to inflected forms.
PREFIXES = (4, 5, 6)
#: Further terms stand for so many different words of one beginning: an insult and its forms.
REPEATS = (2, 3, 4)
#: Each training row is also seen once with this share of its terms, so that one
#: term alone is worth a score and not only the company it was seen in.
KEEP = 0.3
FACTORS = 8
#: Penalties of weights and factors, and the share of rounds that leaves the factors alone.
PENALTY, ALONE = (0.05, 1.0), 0.5
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    h = xxhash.xxh32_intdigest
    return [h(f"w{word}") % BUCKETS, *[h(f"p{word[:k]}") % BUCKETS for k in PREFIXES if len(word) >= k]]


def repeat_terms(beginning: str) -> list[int]:
    """Buckets for ``REPEATS`` different words with a beginning."""
    return [xxhash.xxh32_intdigest(f"{n}{beginning}") % BUCKETS for n in REPEATS]


def terms_of_text(text: str | None) -> set[int]:
    """Buckets of all terms of a whole text."""
    words = words_of(text)
    found = {t for w in words for t in terms_of(w)}
    counts = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    for beginning, n in counts.items():
        if n >= REPEATS[0]:
            found.update(t for least, t in zip(REPEATS, repeat_terms(beginning), strict=True) if n >= least)
    return found


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, lower-cased; runs of letters."""
    return set(_WORD.findall((text or "").lower()))


@dataclass
class FactorizationMachine:
    """bias + sum of weights + half of (square of sums - sum of squares) of the factors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self):
        """A function from texts to scores; words seen are remembered, within bounds."""
        place = {int(t): i for i, t in enumerate(self.terms)}
        memo: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}
        watched: dict[str, bool] = {}

        def is_watched(beginning: str) -> bool:
            """Whether the model has a term for repeats of a beginning."""
            got = watched.get(beginning)
            if got is None:
                got = watched[beginning] = any(t in place for t in repeat_terms(beginning))
            return got

        def look(w: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
            """Places of a word's terms, and its watched beginnings."""
            own = tuple(place[t] for t in terms_of(w) if t in place)
            return own, tuple(w[:k] for k in PREFIXES if len(w) >= k and is_watched(w[:k]))

        def score(text: str | None) -> float:
            if len(memo) > 300_000:
                memo.clear()
                watched.clear()
            active: set[int] = set()
            counts: Counter[str] = Counter()
            for w in words_of(text):
                own, beginnings = memo.get(w) or memo.setdefault(w, look(w))
                if own:
                    active.update(own)
                if beginnings:
                    counts.update(beginnings)
            for beginning, n in counts.items():
                active.update(place[t] for least, t in zip(REPEATS, repeat_terms(beginning), strict=True) if n >= least and t in place)
            z = self.bias
            if active:
                at = sorted(active)
                v = self.factors[at]
                z += self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, rounds: int = 400, rate: float = 0.05, penalty: tuple[float, float] = PENALTY, alone: float = ALONE) -> FactorizationMachine:
    """Full-batch Adam on the logistic loss over sparse rows of term places.

    Rows without terms count through the bias alone, so the two kinds of them
    are kept as numbers. ``penalty`` is that of the weights and of the factors,
    divided by the number of rows with the term: what many rows share explains
    a label before words that a few copies of one text have. The first half of the rounds leaves the
    factors alone: a term that tells by itself gets a weight, and interactions
    only what is left, else single terms would be explained by pairs.
    """
    rng = np.random.default_rng(7)
    full = np.array([len(r) > 0 for r in rows], bool)
    n, bare = len(rows), np.array([(~full & (y == 0)).sum(), (~full & (y == 1)).sum()])
    rows, y = [r for r in rows if len(r)], y[full]
    at = np.concatenate(rows) if rows else np.empty(0, int)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))[:-1].astype(int)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    by_term = np.argsort(at, kind="stable")
    heads = np.searchsorted(at[by_term], np.arange(len(terms)))
    rarity = 1 / np.maximum(np.bincount(at, minlength=len(terms)), 1)
    p = {"b": np.array(-2.0), "w": np.zeros(len(terms)), "v": rng.normal(0, 0.01, (len(terms), FACTORS))}
    first, second = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        blank = squash(p["b"])
        grad = {"b": bare[0] * blank + bare[1] * (blank - 1), "w": penalty[0] * rarity * p["w"], "v": penalty[1] * rarity[:, None] * p["v"]}
        if len(rows):
            s = np.add.reduceat(p["v"][at], starts)
            linear = np.add.reduceat((p["w"] - 0.5 * (p["v"] ** 2).sum(axis=1))[at], starts)
            e = squash(p["b"] + linear + 0.5 * (s * s).sum(axis=1)) - y
            sums = np.add.reduceat(e[doc][by_term], heads)
            cross = np.add.reduceat((e[:, None] * s)[doc][by_term], heads)
            grad = {"b": grad["b"] + e.sum(), "w": grad["w"] + sums, "v": grad["v"] + cross - sums[:, None] * p["v"]}
        for k, g in grad.items():
            if k == "v" and t <= rounds * alone:
                continue
            g = g / n
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return FactorizationMachine(terms, float(p["b"]), p["w"], p["v"])


def with_thinned(rows: list[np.ndarray], y: np.ndarray, keep: float = KEEP) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows and labels, followed by rows of several terms once more with a share ``keep`` of them, one at least."""
    rng, more = np.random.default_rng(3), []
    again = [k for k, r in enumerate(rows) if len(r) > 1]
    for k in again:
        stays = rng.random(len(rows[k])) < keep
        stays[rng.integers(len(stays))] |= not stays.any()
        more.append(rows[k][stays])
    return rows + more, np.concatenate((y, y[again]))


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """``_id, _y, _h, _terms``: labelled documents that are not held out, with all their terms, written.

    At most ``max_train`` labelled ids are used, those of smallest hash. Labels of
    one id are joined by their maximum; null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h")).join(F.broadcast(sample), "_id")

    def terms(batches):
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "_h": b["_h"], "_terms": [sorted(terms_of_text(x)) for x in b["_text"]]})

    return materialize(rows.mapInPandas(terms, f"_id {rows.schema['_id'].dataType.simpleString()}, _y int, _h long, _terms array<int>"), "training-terms")


def chosen_terms(found: DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The terms that tell of the label, and places of each training row's terms and its label.

    Terms are chosen by the likelihood ratio of their presence, more strictly the
    more terms there are, whichever label they speak for and however mostly
    clean they are: terms that are toxic together only stand out by it too.
    Copies of a text count once, so their words gain nothing by being repeated.
    """
    once = found.groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_y").alias("_toxic"))  # copies of a text count once
    n1, n = (int(v or 0) for v in once.agg(F.sum("_toxic"), F.count("*")).first())
    if not n:
        return np.empty(0, int), [], np.empty(0)
    rate = min(max(n1 / n, 1e-6), 1 - 1e-6)
    counts = found.join(F.broadcast(once), ["_id", "_h"]).select("_toxic", F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.sum("_toxic").alias("df1"))
    own = F.col("df1") / F.col("df")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    gain = 2 * F.col("df") * (part(own, F.lit(rate)) + part(1 - own, F.lit(1 - rate)))
    counts = materialize(counts.withColumn("gain", gain), "term-counts")
    best = counts.where("df >= 3").where(F.col("gain") > 1.3 * float(np.log(max(counts.count(), 2))))
    picked = np.array(sorted(r["t"] for r in best.orderBy(F.col("gain").desc(), "t").limit(MAX_TERMS).collect()), int)
    kept = F.array_sort(F.array_intersect("_terms", F.array(*[F.lit(int(t)) for t in picked]))) if len(picked) else F.array().cast("array<int>")
    data = found.select("_id", "_y", kept.alias("_terms")).orderBy("_id").collect()
    return picked, [np.searchsorted(picked, np.array(r["_terms"], int)) for r in data], np.array([r["_y"] for r in data], float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fits the model on labelled documents that are not held out (see ``training_rows``).

    Only counts of terms and the chosen terms of each training document reach
    the driver. Without training rows or chosen terms the score is one constant.
    """
    picked, rows, y = chosen_terms(training_rows(docs, labels, id_col, text_col, label_col, max_train))
    if not len(y):
        return FactorizationMachine(np.empty(0, int), -3.0, np.empty(0), np.empty((0, FACTORS)))
    return fit(*with_thinned(rows, y), picked)


def score_column(model: FactorizationMachine, text: Column) -> Column:
    """The score of each whole text, as an Arrow-batched column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` of every row.

    Defined results: null and empty texts have no terms and get the score of the
    bias. Repeated rows get the same score. A null id is not held out. An empty
    table gives no rows. Only the text, whole however long, is an input of the
    score; other columns are ignored whatever their names, and ids may be of any type.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
