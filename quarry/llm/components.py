"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` (long), root the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest neighbour, until the edges are stars; the number of rounds is
    logarithmic. Only aggregates and joins on nodes are used, so a hub's rows
    can be split by skew-join handling, and each round ends in a written table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = large.join(low, "a").select("a", F.col("m").alias("b"))
        last, edges = edges, materialize(small.unionByName(links).where("a <> b").distinct(), "small-star")
        discard(last, large)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 8)), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
