"""Trace filters over batches of traces of unlike lengths agree with one trace at a time."""

import numpy as np

from quarry.operators import sections
from quarry.operators.kernels import analytic, band


def test_traces_of_unlike_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, [float(v) for v in rng.normal(size=64 if k % 3 else 51)]) for k in range(20)]
    df = spark.createDataFrame(rows, "il int, trace int, samples array<double>").repartition(2)
    got = {r["trace"]: r["samples"] for r in sections.spectral_band(df, 0.05, 0.2).collect()}
    env = {r["trace"]: r for r in sections.envelope(df).collect()}
    assert len(got) == len(env) == 20
    for _, k, x in rows:
        x = np.array(x)[:, None]
        assert np.allclose(got[k], band(x, 0.05, 0.2)[:, 0])
        z = analytic(x)[:, 0]
        steps = np.unwrap(np.angle(z))
        freq = np.abs(np.diff(steps, prepend=steps[:1])) / (2 * np.pi)
        assert np.allclose(env[k]["envelope"], np.abs(z)) and np.allclose(env[k]["frequency"], freq)
        assert np.allclose(env[k]["sweetness"], np.abs(z) / np.sqrt(freq + 1e-8)) and np.allclose(env[k]["phase"], np.angle(z))
