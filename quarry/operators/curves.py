"""Operators on curves: islands, change points, ordered merges, windows.

A curve has ``well`` (the partition), ``idx`` (0-based sample), ``depth`` and
value columns. All windows are partitioned by well.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.geometry import settled
from quarry.operators.overlaps import overlap_join



def by_well() -> WindowSpec:
    """Samples of a well in order."""
    return Window.partitionBy("well").orderBy("idx")


def up_to_here() -> WindowSpec:
    return by_well().rowsBetween(Window.unboundedPreceding, 0)


def threshold_segments(curve: DataFrame, value: str, op: str, threshold: float, min_len: int = 3, top: float | None = None, bottom: float | None = None) -> DataFrame:
    """Runs of at least ``min_len`` consecutive samples that satisfy the rule.

    Only hits are kept before the window, so the sort sees them alone.
    """
    hit = rules.compare(F.col(value), op, threshold)
    if top is not None and bottom is not None:
        hit = hit & F.col("depth").between(top, bottom)
    hits = curve.where(hit).withColumn("island", F.col("idx") - F.row_number().over(by_well()))
    runs = hits.groupBy("well", "island").agg(F.min("depth").alias("depth_top"), F.max("depth").alias("depth_bottom"), F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return runs.where(F.col("n") >= min_len).select("well", "depth_top", "depth_bottom", (F.col("depth_bottom") - F.col("depth_top")).alias("thickness"), "n", "mean_value")


def crossings(curve: DataFrame, value: str, threshold: float) -> DataFrame:
    """Samples where the curve crosses the threshold, with the direction."""
    prev = F.lag(value).over(by_well())
    down, up = (prev >= threshold) & (F.col(value) < threshold), (prev < threshold) & (F.col(value) >= threshold)
    return curve.withColumn("direction", F.when(down, "down").when(up, "up")).where("direction IS NOT NULL").select("well", "idx", "depth", "direction")


def crossing_intervals(curve: DataFrame, value: str, threshold: float, min_thickness: float = 10.0) -> DataFrame:
    """Intervals from a downward crossing to the next upward one, or to the last sample."""
    prev = F.lag(value).over(by_well())
    marks = curve.select("well", "idx", "depth", ((prev >= threshold) & (F.col(value) < threshold)).alias("down"), ((prev < threshold) & (F.col(value) >= threshold)).alias("up"))
    grouped = marks.withColumn("k", F.sum(F.coalesce(F.col("down"), F.lit(False)).cast("int")).over(up_to_here())).where("k > 0")
    spans = grouped.groupBy("well", "k").agg(F.min("depth").alias("depth_top"), F.coalesce(F.min(F.when(F.col("up"), F.col("depth"))), F.max("depth")).alias("depth_bottom"))
    return spans.where(F.col("depth_bottom") - F.col("depth_top") > min_thickness).select("well", "depth_top", "depth_bottom")


def gradient(value: str) -> Column:
    """Central differences, one-sided at the ends of a well."""
    x, ahead, behind = F.col(value), F.lead(value).over(by_well()), F.lag(value).over(by_well())
    return F.coalesce((ahead - behind) / 2, ahead - x, x - behind, F.lit(0.0))


def gradient_z(curve: DataFrame, value: str) -> DataFrame:
    """z-scores of the absolute gradient within a well (population deviation)."""
    w = Window.partitionBy("well")
    steep = curve.withColumn("g", F.abs(gradient(value)))
    return steep.withColumn("z", (F.col("g") - F.avg("g").over(w)) / (F.stddev_pop("g").over(w) + F.lit(1e-8)))


def change_points(curve: DataFrame, value: str, threshold_z: float = 3.0, join_gap: int = 3) -> DataFrame:
    """``well, cp``: steep samples, those at most ``join_gap`` apart merged to their truncated mean."""
    peaks = gradient_z(curve, value).where(F.col("z") > threshold_z).select("well", "idx")
    breaks = (F.coalesce(F.col("idx") - F.lag("idx").over(by_well()), F.lit(join_gap + 1)) > join_gap).cast("int")
    groups = peaks.withColumn("brk", breaks).withColumn("k", F.sum("brk").over(up_to_here()))
    return groups.groupBy("well", "k").agg(F.floor(F.avg("idx")).cast("int").alias("cp")).select("well", "cp")


def change_point_segments(curve: DataFrame, value: str, threshold_z: float = 3.0, min_samples: int = 5, join_gap: int = 3) -> DataFrame:
    """``well, start_idx, end_idx`` (exclusive): [previous change point, this one] and the tail.

    Segments share the sample of a change point; short ones vanish; a well
    without segments is one whole segment. One sort of the samples of a well
    serves gradient, z-score and groups of steep samples; what is left per well
    are its few change points, which are cut into segments in the row.
    """
    whole_well = Window.partitionBy("well")
    steep = gradient_z(curve, value).select("well", "idx", "z", F.count("*").over(whole_well).cast("int").alias("n"))
    hit = F.col("z") > threshold_z
    before = F.max(F.when(hit, F.col("idx"))).over(by_well().rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.when(hit, (F.coalesce(F.col("idx") - before, F.lit(join_gap + 1)) > join_gap).cast("int"))
    marked = steep.withColumn("hit", hit).withColumn("brk", breaks).withColumn("k", F.sum("brk").over(up_to_here()))
    groups = marked.groupBy("well", "n", F.when(F.col("hit"), F.col("k")).alias("k")).agg(F.floor(F.avg(F.when(F.col("hit"), F.col("idx")))).cast("int").alias("cp"))
    cps = F.array_compact(F.array_sort(F.collect_list("cp")))
    per_well = groups.groupBy("well", "n").agg(cps.alias("cps"))
    segment = "named_struct('a', if(i = 0, 0, cps[i - 1]), 'b', least(c + 1, n))"
    inner = F.expr(f"transform(cps, (c, i) -> {segment})")
    tail = F.expr("if(size(cps) > 0, array(named_struct('a', element_at(cps, -1), 'b', n)), cast(array() as array<struct<a:int,b:int>>))")
    cut = per_well.withColumn("_all", F.filter(F.concat(inner, tail), lambda x: x["b"] - x["a"] >= min_samples))
    whole = F.expr("array(named_struct('a', 0, 'b', n))")
    return cut.select("well", F.explode(F.when(F.size("_all") > 0, F.col("_all")).otherwise(whole)).alias("x")).select("well", F.col("x.a").alias("start_idx"), F.col("x.b").alias("end_idx"))


def segment_means(curve: DataFrame, segments: DataFrame, values: list[str]) -> DataFrame:
    """Means of curves over [start_idx, end_idx), and the depths of the ends.

    Range join with the well as equality key: a hash join with a residual. Means
    are cut at nine digits, so that thresholds do not depend on the order of sums.
    """
    seg = segments.withColumnRenamed("well", "_w")
    inside = (F.col("well") == F.col("_w")) & (F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx"))
    return curve.join(seg, inside).groupBy("well", "start_idx", "end_idx").agg(F.min("depth").alias("depth_top"), F.max("depth").alias("depth_bottom"), *[F.round(F.avg(v), 9).alias(f"{v}_mean") for v in values])


def classified_segments(curve: DataFrame, threshold_z: float = 3.0) -> DataFrame:
    """Change-point segments of GR with their lithology."""
    means = segment_means(curve, change_point_segments(curve, "gr", threshold_z), ["gr", "den", "rt"])
    lith = rules.lithology(F.col("gr_mean"), F.col("den_mean"), F.col("rt_mean"))
    return means.withColumn("_l", lith).select(*means.columns, "_l.lithology", "_l.confidence")


def gap_islands(curve: DataFrame, hit: Column, max_gap: int = 3, min_span: int = 2) -> DataFrame:
    """``well, start_idx, end_idx`` (exclusive): hits at most ``max_gap`` samples apart, spanning ``min_span``."""
    hits = curve.where(hit).select("well", "idx")
    brk = (F.coalesce(F.col("idx") - F.lag("idx").over(by_well()), F.lit(max_gap + 1)) > max_gap).cast("int")
    runs = hits.withColumn("brk", brk).withColumn("k", F.sum("brk").over(up_to_here())).groupBy("well", "k").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"))
    return runs.where(F.col("end_idx") - 1 - F.col("start_idx") >= min_span).select("well", "start_idx", "end_idx")


def fluid_zones(curve: DataFrame, rt_above: float = 15.0) -> DataFrame:
    """Zones of high resistivity with their fluid and evidence; means over all samples between."""
    means = segment_means(curve, gap_islands(curve, F.col("rt") > rt_above), ["rt", "den", "cnl"])
    found = means.withColumn("_f", rules.fluid(F.col("rt_mean"), F.col("den_mean")))
    said = lambda c, digits: F.format_string(f"%.{digits}f", settled(F.col(c), digits))
    evidence = F.array(F.concat(F.lit("RT="), said("rt_mean", 1), F.lit("Ohm·m (>15=potential pay)")), F.concat(F.lit("DEN="), said("den_mean", 3), F.lit("g/cm³")), F.concat(F.lit("CNL="), said("cnl_mean", 3)))
    return found.select("well", "depth_top", "depth_bottom", "_f.fluid", "_f.confidence", "rt_mean", "den_mean", "cnl_mean", evidence.alias("evidence"))


def _joined(segments: DataFrame, order: WindowSpec, joined: Column) -> DataFrame:
    """``segments`` with ``_k``, the number of the run of segments that are joined to the one before."""
    new = (~F.coalesce(joined, F.lit(False))).cast("int")
    return segments.withColumn("_new", new).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_fold(segments: DataFrame, max_gap: float = 5.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adjacent segments of one lithology merged in order; means are averaged pair by pair.

    Whether a segment joins the one before depends on these two alone, so the
    runs are found by windows; the running mean depends on the order and is
    folded within a run. ``keep``: columns taken from a run's first segment.
    """
    order = Window.partitionBy("well").orderBy("depth_top", "depth_bottom", "lithology", "mean_value")
    same = F.col("lithology").eqNullSafe(F.lag("lithology").over(order)) & (F.col("depth_top") - F.lag("depth_bottom").over(order) <= max_gap)
    place = F.struct("depth_top", "depth_bottom", "lithology", "mean_value")
    runs = _joined(segments, order, same).groupBy("well", "_k", "lithology").agg(F.min("depth_top").alias("depth_top"), F.max_by("depth_bottom", place).alias("depth_bottom"), F.array_sort(F.collect_list(place)).alias("_s"), *[F.min_by(c, place).alias(c) for c in keep])
    mean = F.expr("aggregate(slice(_s, 2, size(_s) - 1), _s[0].mean_value, (acc, x) -> (acc + x.mean_value) / 2)")
    return runs.select("well", "depth_top", "depth_bottom", "lithology", mean.alias("mean_value"), *keep)


def merge_islands(segments: DataFrame, keys: list[str], max_gap: float = 3.0, first: str | None = None) -> DataFrame:
    """Adjacent segments with equal keys less than ``max_gap`` apart merged; confidence is the maximum.

    ``first``: a column taken from the first segment of each.
    """
    w = Window.partitionBy("well").orderBy("depth_top")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    grouped = _joined(segments, w, same & (F.col("depth_top") - F.lag("depth_bottom").over(w) < max_gap))
    more = [F.min_by(first, "depth_top").alias(first)] if first else []
    return grouped.groupBy("well", "_k", *keys).agg(F.min("depth_top").alias("depth_top"), F.max("depth_bottom").alias("depth_bottom"), F.max("confidence").alias("confidence"), F.count("*").alias("n_merged"), *more).drop("_k")


def sliding_features(curve: DataFrame, window: int = 20, step: int = 10, top: float | None = None, bottom: float | None = None) -> DataFrame:
    """Eight features per window of samples; a well of at most ``window`` samples has none.

    Samples are numbered without gaps. They are summed once, in blocks that windows
    are whole numbers of, and a window is a frame of blocks: no sample is repeated or
    sorted again. The gradient is one-sided at the ends of a window.
    """
    block = gcd(window, step)
    x, ahead, behind = F.col("gr"), F.lead("gr").over(by_well()), F.lag("gr").over(by_well())
    size = lambda *c: F.coalesce(F.abs(F.coalesce(*c)), F.lit(0.0))
    rows = curve.select("well", "idx", "depth", "gr", "rt", "den", "cnl", size((ahead - behind) / 2, ahead - x, x - behind).alias("g"), size(ahead - x).alias("_first"), size(x - behind).alias("_last"))
    sums = [f(c).alias(f"{c}_{k}") for c in ("gr", "rt", "den", "cnl") for k, f in (("sum", F.sum), ("n", F.count))]
    ends = [F.max(F.when(F.col("idx") % block == k, F.col(c) - F.col("g"))).alias(c) for k, c in ((0, "_first"), (block - 1, "_last"))]
    blocks = rows.groupBy("well", F.floor(F.col("idx") / block).alias("_b")).agg(F.min("depth").alias("_top"), F.max("depth").alias("_bottom"), F.sum("g").alias("g"), *ends, *sums, F.avg("gr").alias("_mean"), F.var_pop("gr").alias("_var"))
    here = Window.partitionBy("well").orderBy("_b")
    w = here.rowsBetween(0, window // block - 1)
    mean = {c: F.try_divide(F.sum(f"{c}_sum").over(w), F.sum(f"{c}_n").over(w)) for c in ("gr", "rt", "den", "cnl")}
    slope = (F.sum("g").over(w) + F.col("_first") + F.lead("_last", window // block - 1).over(here)) / window if window > 1 else F.lit(0.0)
    parts = F.collect_list(F.struct(F.col("gr_n").alias("n"), F.col("_mean").alias("mean"), F.col("_var").alias("var"))).over(w)
    each = blocks.select("well", (F.col("_b") * block).alias("start_idx"), F.min("_top").over(w).alias("depth_top"), F.max("_bottom").over(w).alias("depth_bottom"), mean["gr"].alias("_m"), parts.alias("_parts"), F.sum("gr_n").over(w).alias("_n"), *[F.round(mean[c], 9).alias(f"{c}_mean") for c in ("rt", "den", "cnl")], slope.alias("gr_slope"), F.lead("_b", window // block).over(here).alias("_next"))
    spread = F.expr("aggregate(filter(_parts, p -> p.n > 0), 0D, (a, p) -> a + p.n * (p.var + (p.mean - _m) * (p.mean - _m)))")
    out = each.where((F.col("start_idx") % step == 0) & F.col("_next").isNotNull()).select("well", "start_idx", "depth_top", "depth_bottom", F.round("_m", 9).alias("gr_mean"), F.sqrt(F.try_divide(spread, F.col("_n"))).alias("gr_std"), "rt_mean", "den_mean", "cnl_mean", "gr_slope")
    if top:
        out = out.where(F.col("depth_bottom") >= top)
    if bottom:
        out = out.where(F.col("depth_top") <= bottom)
    return out.withColumn("thickness", F.col("depth_bottom") - F.col("depth_top")).withColumn("rt_den", F.col("rt_mean") / F.greatest(F.col("den_mean"), F.lit(1e-8)))


def interval_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Truth intervals that each well overlaps, and whether one of its intervals holds the middle."""
    mid = (F.col("gt_top") + F.col("gt_bottom")) / 2
    inside = (F.col("depth_top") <= mid) & (mid <= F.col("depth_bottom"))
    pairs = overlap_join(found, truth, [("depth_top", "depth_bottom")], [("gt_top", "gt_bottom")])
    return pairs.groupBy("gt_id", "well").agg(F.max(inside.cast("int")).alias("holds_middle"))


def tolerance_match(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Pairs whose tops are less than ``tolerance`` apart, with the distance."""
    around = truth.withColumns({"_low": F.col("gt_top") - tolerance, "_high": F.col("gt_top") + tolerance})
    pairs = overlap_join(found, around, [("depth_top", "depth_top")], [("_low", "_high")])
    apart = F.abs(F.col("depth_top") - F.col("gt_top"))
    return pairs.where(apart < tolerance).select("well", "gt_id", "depth_top", apart.alias("off"))


def labelled_hits(truth: DataFrame, zones: DataFrame, label: str) -> DataFrame:
    """``gt_id, well, n``: how many zones of a well hold a truth's depth ``gt_depth`` and have its ``label``."""
    pairs = overlap_join(zones, truth, [("depth_top", "depth_bottom")], [("gt_depth", "gt_depth")], [label])
    return pairs.groupBy("gt_id", "well").agg(F.count("*").alias("n"))
