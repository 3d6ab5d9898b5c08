"""Connected components of large graphs and of cells of sections, without a group larger than a tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import written

#: Side of the squares of cells that are labelled at once.
TILE = 256
#: A cell's number in its section: its trace times this, and its sample.
SAMPLES = 1_000_000


def smallest_reachable(edges: DataFrame, on: list[str]) -> DataFrame:
    """``*on, node, root`` for the nodes of ``*on, a, b``: the smallest node reachable within equal ``on``.

    Large and small stars in turn: all larger neighbours, then all smaller ones, of a
    node are hung on its smallest neighbour until the edges are stars. Rounds grow with
    the logarithm of the nodes; each is made of aggregates and joins and ends in a
    written table.
    """
    edges = written(edges.where("a <> b").select(*on, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*on, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*on, "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = written(both.where("b > a").join(low, [*on, "a"]).select(*on, F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        low = large.groupBy(*on, "a").agg(F.min("b").alias("m"))
        near = large.join(low, [*on, "a"])
        small = near.select(*on, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, edges = edges, written(small, "small-stars")
        # stars: an unchanged set of edges
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            break
    return edges.select(*on, F.col("a").alias("node"), F.col("b").alias("root"))


def label_tile(trace: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each cell of a tile the number of the first cell of its component, 4 neighbours each.

    Cells of a trace without a gap are a run; runs of neighbouring traces that share a
    sample are joined by union-find.
    """
    trace, s = trace.astype(np.int64), s.astype(np.int64)
    order = np.lexsort((s, trace))
    t, v = trace[order], s[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1] + 1)))
    run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    cell = t * SAMPLES + v
    # the cell of the next trace at the same sample, where there is one
    beside = np.searchsorted(cell, cell + SAMPLES)
    beside[beside == len(cell)] = 0
    linked = cell[beside] == cell + SAMPLES
    pairs = np.unique(np.stack((run[linked], run[beside[linked]]), axis=1), axis=0)
    up = list(range(len(begin)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(begin))], np.int64)
    out = np.empty(len(cell), np.int64)
    out[order] = cell[begin[roots]][run]  # runs are in the order of their first cells
    return out


def label_cells(mask: DataFrame, value: str = "p", tile: int = TILE) -> DataFrame:
    """``il, trace, s, value, region``: 4-neighbour components of each section's cells, ``region`` their first cell.

    Squares of ``tile`` traces and samples are labelled each by itself; labels that meet
    at a border of squares are edges, whose components rename them. Sections of one
    square each have no borders and are not written.
    """
    kind = mask.schema["trace"].dataType.simpleString()
    schema = f"il {mask.schema['il'].dataType.simpleString()}, trace {kind}, s int, {value} double, region long"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop(columns=["_tt", "_ts"]).assign(region=label_tile(pdf["trace"].to_numpy(), pdf["s"].to_numpy()))

    cells = mask.select("il", "trace", F.col("s").cast("int").alias("s"), F.col(value).cast("double").alias(value))
    square = [F.floor(F.col(c) / tile).alias(n) for c, n in (("trace", "_tt"), ("s", "_ts"))]
    labelled = cells.select("*", *square).groupBy("il", "_tt", "_ts").applyInPandas(label, schema)
    widest = mask.agg(F.max(F.greatest(F.floor(F.col("trace") / tile), F.floor(F.col("s") / tile)))).first()[0]
    if not widest:
        return labelled
    labelled = written(labelled, "labelled-cells")
    edges = None
    for along, across in (("trace", "s"), ("s", "trace")):
        at = F.pmod(F.col(along), F.lit(tile))
        here = labelled.where(at == tile - 1).select("il", across, (F.col(along) + 1).alias("_next"), F.col("region").alias("a"))
        there = labelled.where(at == 0).select("il", across, F.col(along).alias("_next"), F.col("region").alias("b"))
        met = here.join(there, ["il", across, "_next"]).select("il", "a", "b").distinct()
        edges = met if edges is None else edges.unionByName(met)
    roots = smallest_reachable(edges, ["il"]).withColumnRenamed("node", "region")
    return labelled.join(roots, ["il", "region"], "left").select("il", "trace", "s", value, F.coalesce("root", "region").alias("region"))
