"""Quantiles by refined histograms against numpy, and the mask that uses them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import sections
from quarry.operators.quantiles import group_quantile


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.951, 1.0])
def test_quantiles_of_awkward_groups(spark, share):
    rng = random.Random(3)
    groups = {
        1: [rng.gauss(0, 1) for _ in range(501)],
        2: [5.0] * 40,
        3: [7.25],
        4: [rng.choice([0.0, 1.0, 1e-300, -1e-300]) for _ in range(100)],
        5: [1e308, -1e308, 0.0, 3.0],
        6: [1.0 + k * 2.0**-52 for k in range(50)] + [1e6] * 3,
        7: [float(10**k) for k in range(-20, 20)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(8, None), (1, None)]
    rng.shuffle(rows)
    got = {r["g"]: r["quantile"] for r in group_quantile(spark.createDataFrame(rows, "g int, v double"), "g", "v", share, bins=16).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s, at = sorted(vs), share * (len(vs) - 1)
        lo, hi, part = s[int(np.floor(at))], s[int(np.ceil(at))], at - np.floor(at)
        assert got[g] == pytest.approx((1 - part) * lo + part * hi, rel=1e-12), g


def test_masks_are_equal_either_way(spark):
    prob = spark.range(3000).select((F.col("id") % 3).cast("int").alias("il"), F.col("id").alias("trace"), F.lit(0).alias("s"), ((F.col("id") * 7919) % 1009 / 1009).alias("p")).where("il < 2 OR trace < 600")
    want = sorted(map(tuple, sections.probability_mask(prob, 95.0).collect()))
    assert sorted(map(tuple, sections.probability_mask(prob, 95.0, held=500).collect())) == want
    assert sorted(map(tuple, sections.probability_mask(prob, 95.0, held=0).collect())) == want and want
