"""Operators on sections: attributes, stencils, textures, regions, horizons.

A section has ``il`` (the partition), ``trace``, ``s`` and ``amp``. Edges are
reflected with the edge sample repeated, by mirrored rows around the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarry.operators.components import label_cells
from quarry.operators.quantiles import group_quantile


def by_trace() -> WindowSpec:
    """Samples of a trace in order."""
    return Window.partitionBy("il", "trace").orderBy("s")


def mirrored(section: DataFrame, n: int, before: int, after: int, axis: str = "s") -> DataFrame:
    """Adds reflected samples ``before`` the first and ``after`` the last of ``n``; ``real`` tells which are own."""
    at = F.col(axis)
    copies = F.array_compact(F.array(F.struct(at.alias("at"), F.lit(True).alias("real")), F.when(at < before, F.struct((-1 - at).alias("at"), F.lit(False).alias("real"))), F.when(at >= n - after, F.struct((2 * n - 1 - at).alias("at"), F.lit(False).alias("real")))))
    return section.withColumn("_m", F.explode(copies)).withColumn(axis, F.col("_m.at")).withColumn("real", F.col("_m.real")).drop("_m")


def moving_mean(col: Column, width: int, partition: list[str], axis: str = "s") -> Column:
    """Mean over ``width`` samples, an even width one sample to the left."""
    return F.avg(col).over(Window.partitionBy(*partition).orderBy(axis).rowsBetween(-(width // 2), width - width // 2 - 1))


def moving_rms(section: DataFrame, n: int, width: int = 15) -> DataFrame:
    wide = mirrored(section, n, width // 2, width - width // 2 - 1)
    return wide.withColumn("rms", F.sqrt(moving_mean(F.col("amp") * F.col("amp"), width, ["il", "trace"]))).where("real").drop("real")


def coherence(section: DataFrame, n: int, win: int = 9) -> DataFrame:
    """Smallest running correlation of a trace with its two neighbours, clipped to [0, 1]."""
    width = n // 2 if win >= n else win
    smooth = mirrored(section, n, 1, 1).withColumn("a", moving_mean(F.col("amp"), 3, ["il", "trace"])).where("real").select("il", "trace", "s", "a")
    nxt = smooth.select("il", (F.col("trace") - 1).alias("trace"), "s", F.col("a").alias("b"))
    pair = mirrored(smooth.join(nxt, ["il", "trace", "s"]), n, width // 2, width - width // 2 - 1)
    mean = lambda x: moving_mean(x, width, ["il", "trace"])
    sim = mean(F.col("a") * F.col("b")) / (F.sqrt(mean(F.col("a") * F.col("a")) * mean(F.col("b") * F.col("b"))) + F.lit(1e-8))
    sims = pair.withColumn("sim", F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim))).where("real").select("il", "trace", "s", "sim")
    both = sims.unionByName(sims.withColumn("trace", F.col("trace") + 1)).unionByName(smooth.select("il", "trace", "s", F.lit(1.0).alias("sim")))
    return both.groupBy("il", "trace", "s").agg(F.min("sim").alias("coherence"))


def local_variance(section: DataFrame, n: int, width: int = 9) -> DataFrame:
    """mean(x^2) - mean(x)^2 over a square, 0 at least; the two axes one after the other."""
    half, rest = width // 2, width - width // 2 - 1
    col = mirrored(section.withColumn("sq", F.col("amp") * F.col("amp")), n, half, rest).withColumn("m", moving_mean(F.col("amp"), width, ["il", "trace"])).withColumn("q", moving_mean(F.col("sq"), width, ["il", "trace"])).where("real").drop("real")
    # traces differ in number by section: mirrored by their own count
    size = section.groupBy("il").agg((F.max("trace") + 1).alias("nt"))
    at = F.col("trace")
    copies = F.array_compact(F.array(F.struct(at.alias("at"), F.lit(True).alias("real")), F.when(at < half, F.struct((-1 - at).alias("at"), F.lit(False).alias("real"))), F.when(at >= F.col("nt") - rest, F.struct((2 * F.col("nt") - 1 - at).alias("at"), F.lit(False).alias("real")))))
    wide = col.join(size, "il").withColumn("_m", F.explode(copies)).withColumn("trace", F.col("_m.at"))
    mean = lambda c: moving_mean(F.col(c), width, ["il", "s"], "trace")
    out = wide.withColumn("mm", mean("m")).withColumn("qq", mean("q")).where("_m.real")
    return out.select("il", "trace", "s", F.greatest(F.lit(0.0), F.col("qq") - F.col("mm") * F.col("mm")).alias("variance"))


def gradient_magnitude(section: DataFrame) -> DataFrame:
    """3x3 Sobel magnitude; neighbours beyond an edge are those of the edge."""
    x = F.col("amp")
    up, down = F.coalesce(F.lag(x).over(by_trace()), x), F.coalesce(F.lead(x).over(by_trace()), x)
    col = section.withColumn("smooth", up + 2 * x + down).withColumn("diff", down - up)
    across = Window.partitionBy("il", "s").orderBy("trace")
    near = lambda c, f: F.coalesce(f(c).over(across), F.col(c))
    gx = near("smooth", F.lead) - near("smooth", F.lag)
    gy = near("diff", F.lag) + 2 * F.col("diff") + near("diff", F.lead)
    return col.select("il", "trace", "s", F.sqrt(gx * gx + gy * gy).alias("gradient"))


def attribute_stats(section: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the finite samples of each section."""
    ok = ~F.isnan("amp") & (F.abs("amp") < float("inf"))
    return section.where(ok).groupBy("il").agg(F.count("*").alias("n"), F.min("amp").alias("lo"), F.max("amp").alias("hi"), F.avg("amp").alias("mean"), F.stddev_pop("amp").alias("std"))


def region(section: DataFrame, n: int, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """The samples in a normalised box, ends included, by each section's number of traces."""
    nt = section.groupBy("il").agg((F.max("trace") + 1).alias("nt"))
    at = lambda b, size: F.least(F.greatest(F.lit(b) * size, F.lit(0.0)), size - 1).cast("int")
    return section.join(nt, "il").where(F.col("trace").between(at(x1, F.col("nt")), at(x2, F.col("nt"))) & F.col("s").between(at(y1, F.lit(n)), at(y2, F.lit(n)))).drop("nt")


def normalize(section: DataFrame) -> DataFrame:
    """Clipped at two deviations around the mean, then scaled to [-1, 1]; flat sections are 0."""
    st = section.groupBy("il").agg(F.avg("amp").alias("mu"), F.stddev_pop("amp").alias("sd"), F.min("amp").alias("lo"), F.max("amp").alias("hi"))
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    low, high = F.greatest(F.col("mu") - 2 * sd, F.col("lo")), F.least(F.col("mu") + 2 * sd, F.col("hi"))
    clipped = F.least(F.greatest(F.col("amp"), low), high)
    return section.join(st, "il").select("il", "trace", "s", F.when(high > low, 2 * (clipped - low) / (high - low) - 1).otherwise(0.0).alias("value"))


def gradient_density(section: DataFrame, jump: float) -> DataFrame:
    """Mean of the shares of jumps along and across traces, and whether it is above 0.02."""
    along = F.abs(F.col("amp") - F.lag("amp").over(by_trace())) > jump
    across = F.abs(F.col("amp") - F.lag("amp").over(Window.partitionBy("il", "s").orderBy("trace"))) > jump
    d = section.select("il", along.cast("int").alias("v"), across.cast("int").alias("h")).groupBy("il").agg(((F.avg("v") + F.avg("h")) / 2).alias("density"))
    return d.withColumn("natural_image", F.col("density") > 0.02)


def glcm(section: DataFrame, levels: int = 16, offsets: tuple = ((1, 0), (2, 0), (1, 1), (2, 2), (0, 1), (0, 2), (-1, 1), (-2, 2))) -> DataFrame:
    """Energy, contrast, homogeneity and correlation of grey-level co-occurrence, averaged over offsets.

    Each sample meets the one at each offset (trace, sample), both ways round;
    the pairs are an equi-join on the shifted place, counted by levels.
    """
    lim = section.groupBy("il").agg(F.min("amp").alias("lo"), F.max("amp").alias("hi"))
    q = F.when(F.col("hi") - F.col("lo") < 1e-8, 0).otherwise(((F.col("amp") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).cast("int"))
    grey = section.join(lim, "il").select("il", "trace", "s", q.alias("q"))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)])
    moved = grey.withColumn("o", F.explode(places)).select("il", (F.col("trace") + F.col("o.dx")).alias("trace"), (F.col("s") + F.col("o.dy")).alias("s"), F.col("o.k").alias("k"), F.col("q").alias("p"))
    pairs = moved.join(grey, ["il", "trace", "s"]).select("il", "k", F.explode(F.array(F.struct(F.col("p").alias("i"), F.col("q").alias("j")), F.struct(F.col("q").alias("i"), F.col("p").alias("j")))).alias("c"))
    counts = pairs.groupBy("il", "k", "c.i", "c.j").agg(F.count("*").alias("n"))
    total = counts.groupBy("il", "k").agg(F.sum("n").alias("t"))
    p = counts.join(total, ["il", "k"]).withColumn("p", F.col("n") / F.col("t"))
    i, j, w = F.col("i"), F.col("j"), F.col("p")
    one = p.groupBy("il", "k").agg(F.sqrt(F.sum(w * w)).alias("energy"), F.sum(w * (i - j) * (i - j)).alias("contrast"), F.sum(w / (1 + (i - j) * (i - j))).alias("homogeneity"), F.sum(w * i).alias("mi"), F.sum(w * i * i).alias("mii"), F.sum(w * i * j).alias("mij"))
    var = F.col("mii") - F.col("mi") * F.col("mi")
    corr = F.when(var < 1e-15, 1.0).otherwise((F.col("mij") - F.col("mi") * F.col("mi")) / var)
    return one.withColumn("correlation", corr).groupBy("il").agg(*[F.avg(c).alias(c) for c in ("energy", "contrast", "homogeneity", "correlation")])


#: Sections of up to so many cells have their percentile from one aggregate, larger ones from refined histograms.
HELD_CELLS = 1_000_000


def probability_mask(prob: DataFrame, threshold: float, value: str = "p", held: int = HELD_CELLS) -> DataFrame:
    """Cells at or above a threshold: none up to 0, absolute under 1, else a percentile in [1, 99.5] of the section.

    The percentile is exact either way; no more than ``held`` values are held together.
    """
    if threshold <= 0:
        return prob.where(F.col(value) >= 0)
    if threshold < 1:
        return prob.where(F.col(value) >= threshold)
    share = max(1.0, min(99.5, threshold)) / 100
    large = prob.groupBy("il").agg(F.count("*").alias("_n")).where(F.col("_n") > held).select("il")
    if large.isEmpty():
        cut = prob.groupBy("il").agg(F.percentile(value, F.lit(share)).alias("_cut"))
    else:
        cut = prob.join(large, "il", "left_anti").groupBy("il").agg(F.percentile(value, F.lit(share)).alias("_cut"))
        cut = cut.unionByName(group_quantile(prob.join(large, "il", "left_semi"), "il", value, share).withColumnRenamed("quantile", "_cut"))
    return prob.join(cut, "il").where(F.col(value) >= F.col("_cut")).drop("_cut")


def label_regions(mask: DataFrame, value: str = "p") -> DataFrame:
    """``il, trace, s, value, region``: 4-neighbour components of each section's cells, ``region`` their first cell."""
    return label_cells(mask, value)


def region_stats(labelled: DataFrame, min_area: int, value: str = "p") -> DataFrame:
    """Area, hull, aspect and confidence (mean value by shape: long ones count full) of regions."""
    r = labelled.groupBy("il", "region").agg(F.count("*").alias("area"), F.min("trace").alias("x1"), F.max("trace").alias("x2"), F.min("s").alias("y1"), F.max("s").alias("y2"), F.avg(value).alias("mean_value")).where(F.col("area") >= min_area)
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    shape = F.when((h > 3 * w) | (w > 3 * h), 1.0).when((h > 2 * w) | (w > 2 * h), 0.8).otherwise(0.5)
    return r.withColumn("aspect", F.greatest(w, h) / (F.least(w, h) + 1)).withColumn("confidence", F.col("mean_value") * shape)


def mask_stats(section: DataFrame) -> DataFrame:
    """Area, hull and centroid of the samples above mean + half a deviation; flat sections count whole."""
    st = section.groupBy("il").agg(F.avg("amp").alias("mu"), F.stddev_pop("amp").alias("sd"))
    inside = section.join(st, "il").where((F.col("sd") < 1e-8) | (F.col("amp") > F.col("mu") + 0.5 * F.col("sd")))
    return inside.groupBy("il").agg(F.count("*").alias("area"), F.min("trace").alias("x1"), F.max("trace").alias("x2"), F.min("s").alias("y1"), F.max("s").alias("y2"), F.avg("trace").alias("cx"), F.avg("s").alias("cy"))


def flood_fill(section: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """The component of each section's seed among samples within ``tolerance`` of its value."""
    at = seeds.select("il", F.col("trace").alias("st"), F.col("s").alias("ss"))
    seed = section.join(at, "il").where("trace = st AND s = ss").select("il", F.col("amp").alias("v"), "st", "ss")
    close = section.join(seed, "il").where(F.abs(F.col("amp") - F.col("v")) <= tolerance).select("il", "trace", "s", F.col("amp").alias("p"))
    labelled = label_regions(close)
    own = labelled.join(at, "il").where("trace = st AND s = ss").select("il", "region")
    inside = labelled.join(own, ["il", "region"])
    return inside.groupBy("il").agg(F.count("*").alias("area"), F.min("trace").alias("x1"), F.max("trace").alias("x2"), F.min("s").alias("y1"), F.max("s").alias("y2"), F.avg("trace").alias("cx"), F.avg("s").alias("cy"))


def pick_seed(section: DataFrame, centre: int, half: int, mode: str) -> DataFrame:
    """The sample of each trace picked near ``centre``: peak, trough or largest magnitude, first of equals.

    ``zero_crossing_pos2neg`` and ``zero_crossing_neg2pos``: the first crossing of
    that direction from the middle of the window on, or the middle.
    """
    near = section.where(F.col("s").between(centre - half, centre + half))
    if "zero_crossing" in mode:
        nxt = F.lead("amp").over(by_trace())
        down, up = (F.col("amp") >= 0) & (nxt < 0), (F.col("amp") <= 0) & (nxt > 0)
        hit = down if mode.endswith("pos2neg") else up if mode.endswith("neg2pos") else F.lit(False)
        first = F.min("s").over(Window.partitionBy("il", "trace"))
        mid = first + F.floor(F.count("*").over(Window.partitionBy("il", "trace")) / 2).cast("int")
        marked = near.withColumn("hit", hit).withColumn("mid", mid)
        return marked.groupBy("il", "trace").agg(F.coalesce(F.min(F.when(F.col("hit") & (F.col("s") >= F.col("mid")), F.col("s"))), F.min("mid")).alias("seed"))
    key = {"peak": F.col("amp"), "trough": -F.col("amp")}.get(mode, F.abs("amp"))
    return near.groupBy("il", "trace").agg(F.min_by("s", F.struct(-key, F.col("s"))).alias("seed"))


def snap(column: np.ndarray, at: int, mode: str, half: int = 4) -> int:
    """The sample near ``at`` that a mode picks on one trace (see ``pick_seed``)."""
    lo = max(0, at - half)
    x = column[lo : at + half + 1]
    if mode == "peak":
        return lo + int(np.argmax(x))
    if mode == "trough":
        return lo + int(np.argmin(x))
    if "zero_crossing" in mode:
        mid = len(x) // 2
        a, b = x[mid:-1], x[mid + 1 :]
        hit = (a >= 0) & (b < 0) if mode.endswith("pos2neg") else (a <= 0) & (b > 0) if mode.endswith("neg2pos") else np.zeros(len(a), bool)
        return lo + mid + (int(np.argmax(hit)) if hit.any() else 0)
    return at


def follow(wave: np.ndarray, start: int, at: int, half: int, search: int, least: float) -> list[tuple[int, int, float]]:
    """(trace, sample, confidence) of a horizon through sample ``at`` of trace ``start``; ``wave`` is traces by samples.

    To the left, then to the right, both from the seed: on each trace the best
    normalised correlation with the waveform around the seed near the pick before;
    flat traces are skipped, a fit under ``least`` ends the way.
    """
    ns = wave.shape[1]
    form = wave[start, max(0, at - half) : min(ns, at + half)]
    if form.std() < 1e-8:
        return [(start, at, 0.0)]
    form = (form - form.mean()) / (form.std() + 1e-8)
    out, seed = [(start, at, 1.0)], at
    for step in (-1, 1):
        at, t = seed, start + step
        while 0 <= t < len(wave):
            lo, hi = max(0, at - search - half), min(ns, at + search + half)
            if hi - lo < len(form) + 4:
                break
            part = wave[t, lo:hi]
            if part.std() >= 1e-8:
                fit = np.correlate((part - part.mean()) / (part.std() + 1e-8), form, mode="valid")
                k = int(np.argmax(fit))
                score = min(float(fit[k]) / len(form), 1.0)
                if score < least:
                    break
                at = max(0, min(ns - 1, lo + k + len(form) // 2))
                out.append((t, at, score))
            t += step
    return sorted(out)


def track_seeds(traces: DataFrame, seeds: list[dict], mode: str = "correlation", search: int = 10, time_axis: list[float] | None = None, half: int = 25, least: float = 0.4) -> DataFrame:
    """``il, seed, seed_trace, seed_sample, trace, s, confidence`` of horizons from seeds, on every section.

    Each pick starts from the one before, so a seed on a section is one sequence;
    sections are tracked independently, in grouped Arrow. A seed has
    ``trace_idx`` or ``cdp`` and ``sample_idx`` or ``time_ms`` (read against the
    time axis, the middle without one); both are clipped to the section.
    """

    def place(seed: dict, ns: int) -> int:
        if "time_ms" in seed and time_axis is not None:
            return int(np.argmin(np.abs(np.asarray(time_axis) - float(seed["time_ms"]))))
        return int(seed.get("sample_idx", ns // 2))

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("trace")
        wave, numbers = np.stack(rows["samples"].to_numpy()).astype(float), rows["trace"].to_numpy()
        out = []
        for k, seed in enumerate(seeds):
            start = max(0, min(len(wave) - 1, int(seed.get("trace_idx", seed.get("cdp", 0)))))
            at = snap(wave[start], max(0, min(wave.shape[1] - 1, place(seed, wave.shape[1]))), mode)
            out += [(k, int(numbers[start]), at, int(numbers[t]), s, c) for t, s, c in follow(wave, start, at, half, search, least)]
        return pd.DataFrame(out, columns=["seed", "seed_trace", "seed_sample", "trace", "s", "confidence"]).assign(il=rows["il"].iloc[0])

    return traces.select("il", "trace", "samples").groupBy("il").applyInPandas(track, f"il {traces.schema['il'].dataType.simpleString()}, seed int, seed_trace int, seed_sample int, trace int, s int, confidence double")


def track_horizon(traces: DataFrame, seed_sample: int, half: int = 25, search: int = 15, least: float = 0.4) -> DataFrame:
    """Horizon picks ``il, trace, s, confidence`` from a sample of trace 0 of each section."""
    return track_seeds(traces, [{"trace_idx": 0, "sample_idx": seed_sample}], "correlation", search, None, half, least).select("il", "trace", "s", "confidence")


def horizon_quality(points: DataFrame) -> DataFrame:
    """Number of picks, continuity (1 / (1 + share of gaps)) and mean confidence per section."""
    gap = (F.col("trace") - F.lag("trace").over(Window.partitionBy("il").orderBy("trace")) > 1).cast("int")
    g = points.withColumn("gap", gap).groupBy("il").agg(F.count("*").alias("n_points"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("share"), F.avg("confidence").alias("confidence"))
    return g.select("il", "n_points", (1 / (1 + F.col("share"))).alias("continuity"), "confidence")


def _by_length(samples: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The traces of a batch, those of one length together: their places and a matrix of samples by traces."""
    lengths = samples.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([np.asarray(samples.iloc[k], float) for k in at], axis=1)


def _place(out: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
    """Puts the columns of a matrix at their traces' places."""
    for k, column in zip(at, found.T, strict=True):
        out[k] = column


def envelope(traces: DataFrame) -> DataFrame:
    """Trace attributes of the analytic signal: envelope, phase, frequency, sweetness (Arrow, by FFT of many traces at once)."""
    from quarry.operators.kernels import analytic

    names = ("envelope", "phase", "frequency", "sweetness")

    def run(batches):
        for b in batches:
            out = {n: np.empty(len(b), object) for n in names}
            for at, x in _by_length(b["samples"]):
                z = analytic(x)
                phase = np.angle(z)
                steps = np.unwrap(phase, axis=0)
                freq = np.abs(np.diff(steps, axis=0, prepend=steps[:1])) / (2 * np.pi)
                for n, v in zip(names, (np.abs(z), phase, freq, np.abs(z) / np.sqrt(freq + 1e-8)), strict=True):
                    _place(out[n], at, v)
            yield pd.DataFrame({"il": b["il"], "trace": b["trace"], **out})

    return traces.mapInPandas(run, "il int, trace int, envelope array<double>, phase array<double>, frequency array<double>, sweetness array<double>")


def spectral_band(traces: DataFrame, low: float, high: float) -> DataFrame:
    """Traces through a zero-phase Butterworth band of order 4, in cycles a sample; those of one length in a batch together."""
    from quarry.operators.kernels import band

    def run(batches):
        for b in batches:
            out = np.empty(len(b), object)
            for at, x in _by_length(b["samples"]):
                _place(out, at, band(x, low, high))
            yield b.assign(samples=out)

    return traces.mapInPandas(run, traces.schema)


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation plus 1e-8: one aggregate, one row."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return df.crossJoin(F.broadcast(st)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(1e-8)) for c in columns}).drop(*st.columns)
