"""Exact quantiles of large groups by histograms that are refined until a bin holds one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written

#: Bins of a histogram.
BINS = 1024


def group_quantile(rows: DataFrame, key: str, value: str, share: float, bins: int = BINS) -> DataFrame:
    """``key, quantile``: the value at ``share`` of the sorted values of each group, interpolated as ``percentile`` does.

    The values on both sides of the place ``share * (n - 1)`` are looked for at once. A
    pass counts the values of a group in ``bins`` bins between two bounds, keeps
    the bin that holds the place and takes its least and greatest value as the next
    bounds, until they are equal: two or three passes as a rule, six or seven at most,
    since each tells doubles apart by ten bits more. What is held per group are the counts
    of one histogram, never its values. Nulls do not count; a group of nulls has no row.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    sizes = values.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = F.lit(share) * (F.col("_n") - 1)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("at")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("at")))
    state = sizes.select("_k", "_n", "_low", "_high", F.explode(sides).alias("_s")).select("_k", "_n", F.col("_s.side").alias("_side"), F.col("_s.at").alias("_at"), "_low", "_high")
    state = written(state, "quantile-bounds")
    while not (open_ := state.where("_low < _high")).isEmpty():
        met = values.join(open_, "_k").where("_v BETWEEN _low AND _high")
        # halves are subtracted, for the width of two far doubles may be beyond them
        part = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        binned = met.withColumn("_bin", F.least(F.floor(part * bins), F.lit(bins - 1)))
        counts = binned.groupBy("_k", "_n", "_side", "_at", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        w = Window.partitionBy("_k", "_side").orderBy("_bin")
        placed = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
        refined = placed.select("_k", "_n", "_side", (F.col("_at") - F.col("_before")).alias("_at"), "_low", "_high")
        state = written(state.where("NOT _low < _high").select(refined.columns).unionByName(refined), "quantile-bounds")
    place = F.lit(share) * (F.col("_n") - 1)
    lower, upper = F.max(F.when(F.col("_side") == 0, F.col("_low"))), F.max(F.when(F.col("_side") == 1, F.col("_low")))
    both = state.groupBy("_k", "_n").agg(lower.alias("_a"), upper.alias("_b"))
    part = place - F.floor(place)
    return both.select(F.col("_k").alias(key), ((1 - part) * F.col("_a") + part * F.col("_b")).alias("quantile"))
