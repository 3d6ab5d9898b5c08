"""Kernels on sections: arrays of samples by traces, in grouped Arrow.

Edges are reflected with the edge sample repeated. A section is cut into tiles of
traces that overlap by what the maps reach, so memory is a few arrays of a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.quantiles import group_quantile
from quarry.session import written

Array = np.ndarray


def _slide(x: Array, weights: Array, axis: int, before: int | None = None) -> Array:
    """Weighted sums over a window that begins ``before`` samples ahead of each."""
    before = len(weights) // 2 if before is None else before
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before, len(weights) - 1 - before)
    wide = np.pad(x, pad, mode="symmetric")
    n = x.shape[axis]
    return sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def gaussian(x: Array, sigma: float) -> Array:
    """Gaussian smoothing along both axes, cut at four deviations."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    return _slide(_slide(x, w, 0), w, 1)


def sobel(x: Array, axis: int) -> Array:
    """Difference along an axis, smoothed by 1, 2, 1 along the other."""
    return _slide(_slide(x, np.array([-1.0, 0.0, 1.0]), axis), np.array([1.0, 2.0, 1.0]), 1 - axis)


def box_mean(x: Array, size: int, axes: tuple[int, ...] = (0, 1)) -> Array:
    for a in axes:
        x = _slide(x, np.full(size, 1.0 / size), a)
    return x


def analytic(x: Array) -> Array:
    """The analytic signal along time."""
    n = x.shape[0]
    gain = np.zeros(n)
    gain[0], gain[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=0) * gain[:, None], axis=0)


def frequency(x: Array) -> Array:
    """Cycles a sample from one sample to the next; the first sample is 0."""
    phase = np.unwrap(np.angle(analytic(x)), axis=0)
    return np.abs(np.diff(phase, axis=0, prepend=phase[:1])) / (2 * np.pi)


def phase_step(x: Array) -> Array:
    """Size of the step of the unwrapped phase to the next sample, at most 50; the last is repeated."""
    step = np.diff(np.unwrap(np.angle(analytic(x)), axis=0), axis=0)
    return np.clip(np.abs(np.vstack([step, step[-1:]])), 0, 50)


def variance(x: Array, size: int) -> Array:
    return np.maximum(box_mean(x * x, size) - box_mean(x, size) ** 2, 0)


def unit(x: Array) -> Array:
    return x / (x.max() + 1e-8)


def gradient_excess(x: Array, sigma: float = 3.0) -> Array:
    """What the vertical gradient exceeds half of the horizontal one by, smoothed."""
    return gaussian(np.maximum(np.abs(sobel(x, 0)) - 0.5 * np.abs(sobel(x, 1)), 0), sigma)


def gradient_fault(x: Array, sigma: float = 3.0) -> Array:
    """The excess of the vertical gradient over its maximum."""
    return unit(gradient_excess(x, sigma))


def eigenvalue_gap(x: Array, sigma: float = 2.0) -> Array:
    """The difference of the eigenvalues of the smoothed gradient tensor."""
    gx, gy = sobel(x, 1), sobel(x, 0)
    xx, yy, xy = gaussian(gx * gx, sigma), gaussian(gy * gy, sigma), gaussian(gx * gy, sigma)
    return np.sqrt(np.maximum((xx + yy) ** 2 - 4 * (xx * yy - xy * xy), 0))


def structure_tensor(x: Array, sigma: float = 2.0) -> Array:
    """1 less the difference of eigenvalues over its maximum."""
    return 1 - unit(eigenvalue_gap(x, sigma))


def entropy(x: Array, half: int = 5, bins: int = 8) -> Array:
    """Entropy of the histogram of the square of 2 * ``half`` around each sample, 0 near the edges."""
    x, out = gaussian(x, 1.5), np.zeros(x.shape)
    if min(x.shape) <= 2 * half:
        return out
    near = np.lib.stride_tricks.sliding_window_view(x, (2 * half, 2 * half))[:-1, :-1]
    lo, hi = near.min(axis=(2, 3), keepdims=True), near.max(axis=(2, 3), keepdims=True)
    flat = hi == lo  # a flat square lies in the middle of a range of one
    at = np.clip(((near - np.where(flat, lo - 0.5, lo)) / np.where(flat, 1.0, hi - lo) * bins).astype(int), 0, bins - 1)
    total = 0.0
    for b in range(bins):
        p = (at == b).sum(axis=(2, 3)) / (4.0 * half * half + 1e-8)
        total = total - p * np.log(p + 1e-8)
    out[half : x.shape[0] - half, half : x.shape[1] - half] = total
    return out


def dip(x: Array) -> Array:
    """Angle of the gradient of the instantaneous phase."""
    along, across = np.gradient(np.angle(analytic(x)))
    return np.arctan2(across, along)


def coherence(x: Array, win: int = 9) -> Array:
    """Smallest running correlation of a trace with its neighbours, in [0, 1]."""
    width = x.shape[0] // 2 if win >= x.shape[0] else win
    a = box_mean(x, 3, (0,))
    left, right = a[:, :-1], a[:, 1:]
    mean = lambda v: box_mean(v, width, (0,))
    sim = np.clip(mean(left * right) / (np.sqrt(mean(left * left) * mean(right * right)) + 1e-8), 0, 1)
    out = np.ones(x.shape)
    out[:, :-1] = np.minimum(out[:, :-1], sim)
    out[:, 1:] = np.minimum(out[:, 1:], sim)
    return out


def butterworth(order: int, low: float | None, high: float | None) -> tuple[Array, Array]:
    """(b, a) of a digital Butterworth filter; edges are shares of the Nyquist frequency.

    Without ``low`` a low pass, without ``high`` a high pass, else a band pass:
    the analog prototype's poles are moved to the warped edges, then mapped by
    the bilinear transform.
    """
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    warp = lambda f: 4 * np.tan(np.pi * f / 2)
    if low is None:
        poles, zeros, gain = poles * warp(high), np.empty(0), warp(high) ** order
    elif high is None:
        poles, zeros, gain = warp(low) / poles, np.zeros(order), 1.0
    else:
        width, centre = warp(high) - warp(low), warp(high) * warp(low)
        half = poles * width / 2
        root = np.sqrt(half * half - centre)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order), width**order
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.concatenate(((4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))))
    return np.real(gain * np.poly(zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def _run(b: Array, a: Array, x: Array, state: Array) -> Array:
    out = np.empty_like(x)
    for k in range(len(x)):
        y = b[0] * x[k] + state[0]
        state = np.vstack([state[1:], np.zeros_like(state[:1])]) + b[1:, None] * x[k] - a[1:, None] * y
        out[k] = y
    return out


def zero_phase(b: Array, a: Array, x: Array) -> Array:
    """A filter run forward and backward along time, over ends turned about their last samples."""
    n, size = 3 * max(len(a), len(b)), len(a) - 1
    if len(x) <= n:
        raise ValueError(f"a trace must have more than {n} samples")
    wide = np.concatenate((2 * x[:1] - x[n:0:-1], x, 2 * x[-1:] - x[-2 : -n - 2 : -1]))
    step = np.zeros((size, size))
    step[:, 0], step[np.arange(size - 1), np.arange(1, size)] = -a[1:], 1
    rest = np.linalg.solve(np.eye(size) - step, b[1:] - a[1:] * b[0])[:, None]
    once = _run(b, a, wide, rest * wide[:1])
    return _run(b, a, once[::-1], rest * once[-1:])[::-1][n:-n]


def band(x: Array, low: float, high: float, nyquist: float = 0.5) -> Array:
    """Zero-phase Butterworth band of order 4 between frequencies."""
    edges = (None, high / nyquist) if low <= 0 else (low / nyquist, None) if high >= 0.99 * nyquist else (low / nyquist, high / nyquist)
    return zero_phase(*butterworth(4, *edges), x)


#: Maps of a section by name.
MAPS = {
    "amplitude": lambda x: x,
    "envelope": lambda x: np.abs(analytic(x)),
    "phase": lambda x: np.angle(analytic(x)),
    "frequency": frequency,
    "phase_step": phase_step,
    "rms_amplitude": lambda x: np.sqrt(box_mean(x * x, 15, (0,))),
    "sweetness": lambda x: np.abs(analytic(x)) / np.sqrt(frequency(x) + 1e-8),
    "gradient_magnitude": lambda x: np.hypot(sobel(x, 0), sobel(x, 1)),
    "local_variance": lambda x: variance(x, 9),
    "local_entropy": entropy,
    "dip": dip,
    "gradient_fault": gradient_fault,
    "structure_tensor": structure_tensor,
    "variance_fault": lambda x: unit(variance(x, 15)),
    "coherence_fault": lambda x: 1 - coherence(x, max(3, min(9, x.shape[0] // 4))),
}

#: Maps that are a share of a section's maximum: what that is of, and whether 1 less the share is meant.
SHARES = {"gradient_fault": (gradient_excess, False), "structure_tensor": (eigenvalue_gap, True), "variance_fault": (lambda x: variance(x, 15), False)}
#: How many traces to each side a map of a trace depends on, where it does.
REACH = {"gradient_magnitude": 1, "local_variance": 4, "local_entropy": 11, "dip": 1, "gradient_fault": 13, "structure_tensor": 9, "variance_fault": 7, "coherence_fault": 1}
#: Traces of a tile, without those it shares with its neighbours.
TILE = 512


def box_of(roi: list[float] | None, rows: int, cols: int) -> tuple[int, int, int, int]:
    """First and last trace and sample of a normalised box, clipped and truncated; the whole without one."""
    if roi is None:
        return 0, 0, cols - 1, rows - 1
    at = lambda v, n: int(min(max(v * n, 0), n - 1))
    return at(roi[0], cols), at(roi[1], rows), at(roi[2], cols), at(roi[3], rows)


def section_maps(traces: DataFrame, names: list[str], roi: list[float] | None = None, bands: dict[str, tuple[float, float]] | None = None, clip: bool = False, least: tuple[int, int] = (0, 0), tile: int = TILE) -> DataFrame:
    """``il, trace, s`` and a column for each map of ``names`` and each of ``bands``.

    Maps are computed on the box ``roi`` (normalised) of each section alone;
    boxes of fewer than ``least`` traces and samples beyond the first give
    nothing. ``clip``: the section is first divided by the 99th percentile of its
    magnitude and cut to [-1, 1].

    A section is dealt out in tiles of ``tile`` traces and those that their maps reach to
    both sides. Where a map is a share of the section's maximum, tiles are written
    and the maximum is taken from there. The result does not depend on ``tile``.
    """
    bands = bands or {}
    reach = max([REACH.get(n, 0) for n in names], default=0)
    maps = {n: SHARES[n][0] if n in SHARES else MAPS[n] for n in names}
    shape = ["il", "trace", "s", *names, *bands]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_at")
        x = np.stack(rows["samples"].to_numpy()).astype(float).T
        if clip:
            x = np.clip(x / (rows["_lim"].iloc[0] or 1.0), -1, 1)
        _, y1, _, y2 = box_of(roi, len(x), 1)
        if y2 - y1 < least[1]:
            return pd.DataFrame(columns=shape)
        x = x[y1 : y2 + 1]
        own = (rows["_at"] // tile == rows["_tile"]).to_numpy()
        found = {n: f(x) for n, f in maps.items()} | {n: band(x, *lim) for n, lim in bands.items()}
        at = rows["trace"].to_numpy()[own]
        out = {"il": rows["il"].iloc[0], "trace": np.repeat(at, x.shape[0]), "s": np.tile(np.arange(y1, y2 + 1), len(at))}
        return pd.DataFrame(out | {n: m[:, own].T.ravel() for n, m in found.items()})

    section = Window.partitionBy("il")
    placed = traces.select("il", "trace", "samples", (F.row_number().over(section.orderBy("trace")) - 1).alias("_at"), F.count("*").over(section).alias("_n"))
    if roi is not None:
        edge = lambda v: F.least(F.greatest(F.lit(float(v)) * F.col("_n"), F.lit(0.0)), F.col("_n") - 1).cast("int")
        placed = placed.withColumns({"_x1": edge(roi[0]), "_x2": edge(roi[2])}).where(F.col("_at").between(F.col("_x1"), F.col("_x2")))
        placed = placed.withColumns({"_at": F.col("_at") - F.col("_x1"), "_n": F.col("_x2") - F.col("_x1") + 1})
    placed = placed.where(F.col("_n") > least[0])
    tiles = F.sequence(F.floor(F.greatest(F.col("_at") - reach, F.lit(0)) / tile), F.floor(F.least(F.col("_at") + reach, F.col("_n") - 1) / tile))
    dealt = placed.select("il", "trace", "samples", "_at", F.explode(tiles).alias("_tile"))
    if clip:
        # a struct, for it is never null
        sizes = traces.select(F.struct("il").alias("_key"), F.explode("samples").alias("_v")).withColumn("_v", F.abs("_v"))
        lim = group_quantile(sizes, "_key", "_v", 0.99).select(F.col("_key"), F.col("quantile").alias("_lim"))
        dealt = dealt.withColumn("_key", F.struct("il")).join(F.broadcast(lim), "_key").drop("_key")
    kinds = dict(traces.dtypes)
    out = dealt.groupBy("il", "_tile").applyInPandas(run, f"il {kinds['il']}, trace {kinds['trace']}, s int, " + ", ".join(f"`{n}` double" for n in [*names, *bands]))
    shares = [n for n in names if n in SHARES]
    if not shares:
        return out
    out = written(out, "section-maps")
    most = out.groupBy(F.col("il").alias("_il")).agg(*[F.max(n).alias(f"_max_{n}") for n in shares])
    part = {n: F.col(n) / (F.col(f"_max_{n}") + F.lit(1e-8)) for n in shares}
    whole = out.join(F.broadcast(most), F.col("il").eqNullSafe(F.col("_il")))
    return whole.withColumns({n: 1 - c if SHARES[n][1] else c for n, c in part.items()}).select(*shape)
