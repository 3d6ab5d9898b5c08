"""Joins of intervals and boxes that meet, and greedy suppression of boxes, on grids that fit their sizes.

An extent belongs to the level whose cells are the least power of two not smaller than
its longest side, so it lies in two cells an axis at most. It is registered in the cells
of its own level and of every greater level that occurs, and a pair meets once: at the
greater of its two levels, in the cell that holds the lower corner of what both cover.
Copies of a row are bounded by the levels that occur, whatever lies beside it, and all
shuffles are on cells, so a hot image or well is spread over its cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.geometry import iou
from quarry.session import written

Axes = list[tuple[str, str]]


def _extent(axes: Axes) -> Column:
    """The longest side."""
    sides = [F.col(hi).cast("double") - F.col(lo).cast("double") for lo, hi in axes]
    return sides[0] if len(sides) == 1 else F.greatest(*sides)


def _level(axes: Axes) -> Column:
    """The exponent of the least power of two not smaller than the longest side; null for points."""
    e = _extent(axes)
    return F.when(e > 0, F.ceil(F.log2(e))).cast("int")


def _meant(df: DataFrame, axes: Axes) -> DataFrame:
    """Rows whose extents are neither null nor the wrong way round."""
    for lo, hi in axes:
        df = df.where(F.col(lo) <= F.col(hi))
    return df


def _levels(*sides: tuple[DataFrame, Axes]) -> tuple[list[int], int]:
    """The levels that occur, points left out, and that of the mean extent: one aggregate, some tens of numbers."""
    found: set[int] = set()
    means = []
    for df, axes in sides:
        row = df.agg(F.collect_set(_level(axes)), F.avg(F.when(_extent(axes) > 0, _extent(axes)))).first()
        found |= set(row[0])
        means += [row[1]] if row[1] and math.isfinite(row[1]) else []
    return sorted(found), math.floor(math.log2(max(means))) if means else 0


def _registered(df: DataFrame, axes: Axes, levels: list[int], own: str, level: str, cell: str) -> DataFrame:
    """``df`` with a row for each cell of its own level (at least the first of ``levels``) and of all greater ones."""
    df = df.withColumn(own, F.greatest(F.coalesce(_level(axes), F.lit(levels[0])), F.lit(levels[0])))
    df = df.withColumn(level, F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(own))))
    for k, (lo, hi) in enumerate(axes):
        width = F.pow(F.lit(2.0), F.col(level))
        df = df.withColumn(f"{cell}{k}", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return df


def overlap_join(left: DataFrame, right: DataFrame, left_axes: Axes, right_axes: Axes, on: list[str] = ()) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose closed extents meet on every axis.

    ``left_axes`` and ``right_axes`` name (low, high) columns; other than ``on`` the
    sides share no column names. Points are extents of no length. Rows with a null or
    a high below a low meet nothing. Lengths of both sides are measured first, in one
    aggregate each; cells are no smaller than the mean extent.
    """
    left, right = _meant(left, left_axes), _meant(right, right_axes)
    occur, mean = _levels((left, left_axes), (right, right_axes))
    levels = sorted({max(x, mean) for x in occur} | {mean})
    a = _registered(left, left_axes, levels, "_own_a", "_level", "_cell")
    b = _registered(right, right_axes, levels, "_own_b", "_level", "_cell")
    cells = [f"_cell{k}" for k in range(len(left_axes))]
    pairs = a.join(b, [*on, "_level", *cells])
    here = F.col("_level") == F.greatest("_own_a", "_own_b")
    width = F.pow(F.lit(2.0), F.col("_level"))
    for c, (lo, hi), (lo2, hi2) in zip(cells, left_axes, right_axes, strict=True):
        here = here & (F.col(lo) <= F.col(hi2)) & (F.col(lo2) <= F.col(hi)) & (F.floor(F.greatest(F.col(lo).cast("double"), F.col(lo2).cast("double")) / width) == F.col(c))
    return pairs.where(here).drop("_level", "_own_a", "_own_b", *cells)


BOX = ["x1", "y1", "x2", "y2"]
BOX_AXES = [("x1", "x2"), ("y1", "y2")]


def box_pairs(left: DataFrame, right: DataFrame, on: list[str], prefix: str, over: float) -> DataFrame:
    """Pairs of boxes, equal in ``on``, with ``iou`` above ``over`` (0 or more); the right side's other columns are prefixed."""
    right = right.select(*on, *[F.col(c).alias(prefix + c) for c in right.columns if c not in on])
    axes = [(prefix + lo, prefix + hi) for lo, hi in BOX_AXES]
    v = iou([F.col(c) for c in BOX], [F.col(prefix + c) for c in BOX])
    return overlap_join(left, right, BOX_AXES, axes, on).withColumn("iou", v).where(F.col("iou") > over)


#: Boxes of a cell that the others of the cell are compared with in one round.
LISTED = 32


def _first_of_cells(live: DataFrame, place: list[str], name: str, listed: int) -> DataFrame:
    """``*place, name``: the first ``listed`` boxes of every cell. Windows are limited before the shuffle."""
    w = Window.partitionBy(*place).orderBy("_first")
    few = live.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= listed)
    return few.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_first", *BOX))).alias(name))


def suppress_by_rounds(boxes: DataFrame, over: float, on: list[str], id_col: str = "det_id", confidence: str = "confidence", listed: int = LISTED) -> DataFrame:
    """The boxes that greedy suppression by falling confidence, then id, keeps: ``boxes`` without the others.

    A box is kept once no live box before it overlaps it by more than ``over``. Boxes
    before it that overlap it share a cell with it, of the greater of both levels, so it
    is compared with the first ``listed`` boxes of each of its cells: all up to its level
    in cells of its own, those of the greater level in cells of that. One that comes after
    more than these in a cell waits for a later round. What a kept box overlaps by more
    than ``over`` goes. The first of all boxes is always kept, so the rounds end when none
    is left. A cell's boxes meet no more than ``listed`` others a round, never each other,
    and each round ends in a written table. Boxes without an area overlap nothing and are kept.
    """
    flat = ~((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    rest = boxes.where(~F.coalesce(flat, F.lit(True)))
    occur, _ = _levels((rest, BOX_AXES))
    ids = boxes.where(F.coalesce(flat, F.lit(True))).select(id_col)
    narrow = rest.select(*on, id_col, F.struct((-F.col(confidence)).alias("c"), F.col(id_col).alias("i")).alias("_first"), *BOX)
    live = written(_registered(narrow, BOX_AXES, occur or [0], "_own", "_level", "_cell"), "live-boxes")
    place = [*on, "_level", "_cell0", "_cell1"]
    both = "greatest(0D, least(o.x2, x2) - greatest(o.x1, x1)) * greatest(0D, least(o.y2, y2) - greatest(o.y1, y1))"
    apart = f"{both} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (x2 - x1) * (y2 - y1) - {both} + 1e-8D) <= {float(over)!r}D"
    clear = lambda near: f"{near} IS NULL OR ((size({near}) < {listed} OR _first <= element_at({near}, -1)._first) AND forall({near}, o -> o._first >= _first OR {apart}))"
    while not live.isEmpty():
        near = live.join(_first_of_cells(live, place, "_any", listed), place).join(_first_of_cells(live.where("_own = _level"), place, "_same", listed), place, "left")
        free = F.expr(f"if(_own = _level, {clear('_any')}, {clear('_same')})")
        won = near.groupBy(id_col).agg(F.min(free).alias("_free")).where("_free").select(id_col)
        won = written(won, "kept-boxes")
        ids = ids.unionByName(won)
        of_won = live.join(won, id_col).select(*place, F.col("_own").alias("_w_own"), *[F.col(c).alias(f"_w_{c}") for c in BOX])
        v = iou([F.col(c) for c in BOX], [F.col(f"_w_{c}") for c in BOX])
        lost = live.join(of_won, place).where((F.col("_level") == F.greatest("_own", "_w_own")) & (v > over)).select(id_col)
        live = written(live.join(won.unionByName(lost).distinct(), id_col, "left_anti"), "live-boxes")
    return boxes.join(ids, id_col, "left_semi")
