"""Operators on detections: normalising, matching, suppression, painting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.geometry import pixel_to_data, to_index
from quarry.operators.overlaps import BOX, BOX_AXES, box_pairs, overlap_join, suppress_by_rounds

#: Groups of up to so many boxes are suppressed in one fold; larger ones by rounds, with equal results.
FOLD_BOXES = 2_000


def tag(dets: DataFrame, model: str, order: list[str]) -> DataFrame:
    """Adds ``tag``: the given id, else model, step and place within the step."""
    place = F.row_number().over(Window.partitionBy("step").orderBy(*order)) - 1
    return dets.withColumn("tag", F.coalesce(F.col("given_id").cast("string"), F.format_string(f"{model}_s%d_i%d", F.col("step"), place)))


def normalize(dets: DataFrame, width: int, height: int) -> DataFrame:
    """One class name, confidence and normalised box per row of differing kinds.

    Class: class_name, label, horizon_name, cluster, unknown. Box: normalised,
    else pixels, else the hull of points, else a square around the centroid of
    half its area's root (2 pixels at least). Rows without any are dropped.
    """
    w, h = F.lit(float(max(width, 1))), F.lit(float(max(height, 1)))
    cluster = F.when(F.col("cluster_id").isNotNull(), F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")))
    cls = F.coalesce("class_name", "label", "horizon_name", cluster, F.lit("unknown"))
    px = F.when(F.lit(width > 1 and height > 1), F.transform("bbox_pixel", lambda v, i: v / F.when(i % 2 == 0, w).otherwise(h)))
    lim = lambda f, k: f(F.transform("points", lambda p: p[k].cast("double")))
    hull = F.when(F.size("points") > 0, F.array(lim(F.array_min, "trace_idx") / w, lim(F.array_min, "sample_idx") / h, lim(F.array_max, "trace_idx") / w, lim(F.array_max, "sample_idx") / h))
    half = F.greatest(F.sqrt(F.coalesce(F.col("area_pixels"), F.lit(100)).cast("double")) / 2, F.lit(2.0))
    cx, cy = F.col("centroid_xy")[0], F.col("centroid_xy")[1]
    square = F.when(F.col("centroid_xy").isNotNull(), F.array(F.greatest(F.lit(0.0), cx - half) / w, F.greatest(F.lit(0.0), cy - half) / h, F.least(w, cx + half) / w, F.least(h, cy + half) / h))
    box = F.coalesce(F.col("bbox_norm"), px, hull, square)
    return dets.select("det_id", cls.alias("class_name"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), box.alias("box")).where("box IS NOT NULL")


def match_verifications(vers: DataFrame, dets: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``vers`` with the matched ``det_id``: by id, else the best box of the same image and class.

    Only boxes above the threshold (0 or more) count; ties go to the smaller id. Boxes
    meet in the cells of a grid within image and class, not in all pairs.
    """
    by_id = vers.join(dets.select(F.col("det_id").alias("_d")), vers["result_id"].cast("string") == F.col("_d").cast("string"), "left")
    lost = by_id.where("_d IS NULL").drop("_d")
    pairs = box_pairs(lost, dets.select("image", "class_id", "det_id", *BOX), ["image", "class_id"], "d_", threshold)
    best = pairs.groupBy("ver_id").agg(F.min_by("d_det_id", F.struct(-F.col("iou"), F.col("d_det_id"))).alias("matched"), F.max("iou").alias("iou"))
    found = by_id.where("_d IS NOT NULL").select("ver_id", F.col("_d").alias("matched"), F.lit(None).cast("double").alias("iou"))
    return vers.join(found.unionByName(best), "ver_id", "left")


def filter_false_positives(vers: DataFrame, dets: DataFrame, min_confidence: float = 0.5, threshold: float = 0.3) -> DataFrame:
    """Each rejected verification with its outcome: dropped, or why it is only reviewed."""
    matched = match_verifications(vers.where(~F.col("is_real")), dets, threshold)
    sure = F.col("matched").isNotNull() & F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    # the first sure rejection of a detection drops it; all after it are duplicates
    first = F.min(F.when(sure, F.col("ver_id"))).over(Window.partitionBy("matched"))
    outcome = F.when(F.col("matched").isNull(), "unmatched").when(F.col("ver_id") == first, "dropped").when(F.col("ver_id") > first, "duplicate").when(F.col("confidence").isNotNull(), "low_confidence").otherwise("no_confidence")
    return matched.withColumn("outcome", outcome)


def surviving(dets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Detections that were not dropped."""
    gone = outcomes.where(F.col("outcome") == "dropped").select(F.col("matched").alias("det_id"))
    return dets.join(gone, "det_id", "left_anti")


def nms_greedy(dets: DataFrame, threshold: float, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """Greedy suppression per image and class against kept boxes only; equal overlap survives.

    Groups of at most ``fold_boxes`` boxes are folded by falling confidence, then id;
    of larger ones, rounds on a grid keep the same boxes without a group of them all.
    """
    sizes = dets.groupBy("image", "class_id").agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > fold_boxes).select("image", "class_id")
    if large.isEmpty():
        return _folded(dets, threshold)
    few = _folded(dets.join(large, ["image", "class_id"], "left_anti"), threshold)
    many = suppress_by_rounds(dets.join(large, ["image", "class_id"], "left_semi"), threshold, ["image", "class_id"])
    return few.unionByName(many.select("image", "class_id", "det_id", "confidence"))


def _folded(dets: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression of groups that fit into a row each."""
    item = F.struct((-F.col("confidence")).alias("k"), "det_id", *BOX)
    ious = "greatest(0D, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0D, least(k.y2, x.y2) - greatest(k.y1, x.y1))"
    area = lambda v: f"greatest(0D, {v}.x2 - {v}.x1) * greatest(0D, {v}.y2 - {v}.y1)"
    fold = f"aggregate(slice(_s, 2, size(_s) - 1), slice(_s, 1, 1), (acc, x) -> if(exists(acc, k -> {ious} / ({area('k')} + {area('x')} - {ious} + 1e-8D) > {threshold}D), acc, concat(acc, array(x))))"
    groups = dets.groupBy("image", "class_id").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return groups.select("image", "class_id", F.explode(F.expr(fold)).alias("_k")).select("image", "class_id", F.col("_k.det_id").alias("det_id"), (-F.col("_k.k")).alias("confidence"))


def nms_all(dets: DataFrame, threshold: float) -> DataFrame:
    """Suppression against every higher-ranked box, suppressed or not: an anti-join on the pairs that overlap."""
    pairs = box_pairs(dets, dets.select("image", "class_id", "det_id", "confidence", *BOX), ["image", "class_id"], "o_", threshold)
    ahead = (F.col("o_confidence") > F.col("confidence")) | ((F.col("o_confidence") == F.col("confidence")) & (F.col("o_det_id") < F.col("det_id")))
    return dets.join(pairs.where(ahead).select("det_id"), "det_id", "left_anti")


def suppress_hulls(regions: DataFrame, threshold: float) -> DataFrame:
    """Regions whose hull does not overlap that of a more confident one of the section by more than ``threshold``.

    Overlap is that of the corner coordinates, the more confident ones count
    suppressed or not, and of equal ones the smaller region number goes first.
    """
    o = regions.select("il", *[F.col(c).alias(f"o_{c}") for c in ("region", "confidence", *BOX)])
    pairs = overlap_join(regions, o, BOX_AXES, [(f"o_{lo}", f"o_{hi}") for lo, hi in BOX_AXES], ["il"])
    ahead = (F.col("o_confidence") > F.col("confidence")) | ((F.col("o_confidence") == F.col("confidence")) & (F.col("o_region") < F.col("region")))
    w = F.least("x2", "o_x2") - F.greatest("x1", "o_x1")
    h = F.least("y2", "o_y2") - F.greatest("y1", "o_y1")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) + (F.col("o_x2") - F.col("o_x1")) * (F.col("o_y2") - F.col("o_y1"))
    over = (w > 0) & (h > 0) & (w * h / (area - w * h + F.lit(1e-8)) > threshold)
    return regions.join(pairs.where(ahead & over).select("il", "region"), ["il", "region"], "left_anti")


def dedup_by_id(dets: DataFrame, key: str, order: str) -> DataFrame:
    """The most confident row of each key, the first of equals; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), order)
    return dets.withColumn("_n", F.when(F.col(key).isNotNull(), F.row_number().over(w)).otherwise(1)).where("_n = 1").drop("_n")


def cells(dets: DataFrame, nx: int, ny: int) -> DataFrame:
    """Every cell (x, y) of every box, inclusive, clipped to the grid."""
    span = lambda a, b, n: F.sequence(to_index(F.col(a), n), F.greatest(to_index(F.col(a), n), to_index(F.col(b), n)))
    return dets.withColumn("x", F.explode(span("x1", "x2", nx))).withColumn("y", F.explode(span("y1", "y2", ny)))


def paint_volume(dets: DataFrame, nx: int, ny: int) -> DataFrame:
    """Highest confidence per class, image and cell; rows out of the region of interest do not paint."""
    return cells(dets.where(F.coalesce(F.col("in_roi"), F.lit(True))), nx, ny).groupBy("class_id", "image", "x", "y").agg(F.max("confidence").alias("confidence"))


def paint_views(dets: DataFrame, views: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``class_name, il, xl, s, confidence``: highest confidence of each cell of a volume that boxes on its views cover.

    ``views``: ``view_name`` (inline, crossline or slice; others are not
    painted), ``image`` (path of its picture), ``index`` (its place on its axis),
    ``rows``, ``cols`` (of its array). ``dets``: ``image_name, class_name,
    confidence, in_roi`` and a normalised box. A view is known by the stem of its
    image, by ``seismic_`` and its name, and by its name alone. Inlines have
    crosslines across and samples down, crosslines inlines across and samples
    down, slices crosslines across and inlines down. Rows out of the region of
    interest do not paint, nor do views beyond the volume.
    """
    n_il, n_xl, n_s = shape
    stem = F.regexp_extract("image", r"([^/]*?)(?:\.[^./]*)?$", 1)
    limit = F.when(F.col("view_name") == "inline", n_il).when(F.col("view_name") == "crossline", n_xl).when(F.col("view_name") == "slice", n_s)
    known = views.where((F.col("index") >= 0) & (F.col("index") < limit)).withColumn("image_name", F.explode(F.array_distinct(F.array(stem, F.concat(F.lit("seismic_"), F.col("view_name")), F.col("view_name"))))).drop("image")
    d = dets.where(F.coalesce(F.col("in_roi"), F.lit(True))).join(known, "image_name")
    at = lambda b, n: F.least(F.greatest(F.col(b) * F.col(n), F.lit(0.0)), F.col(n) - 1).cast("int")
    span = lambda a, b, size, n: F.sequence(F.least(F.least(at(a, size), at(b, size)), F.lit(n - 1)), F.least(F.greatest(at(a, size), at(b, size)), F.lit(n - 1)))
    one, v = F.array(F.col("index").cast("int")), F.col("view_name")
    axes = d.select(
        F.coalesce("class_name", F.lit("unknown")).alias("class_name"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.when(v == "inline", one).when(v == "crossline", span("x1", "x2", "cols", n_il)).otherwise(span("y1", "y2", "rows", n_il)).alias("il"),
        F.when(v == "crossline", one).otherwise(span("x1", "x2", "cols", n_xl)).alias("xl"),
        F.when(v == "slice", one).otherwise(span("y1", "y2", "rows", n_s)).alias("s"),
    )
    each = axes.withColumn("il", F.explode("il")).withColumn("xl", F.explode("xl")).withColumn("s", F.explode("s"))
    return each.groupBy("class_name", "il", "xl", "s").agg(F.max("confidence").alias("confidence"))


def to_data(dets: DataFrame, width: int, height: int, x_axis: tuple[float, float], y_axis: tuple[float, float]) -> DataFrame:
    """``x_min, x_max, y_min, y_max`` on the data axes of the rows that have a box in pixels."""
    rows = dets.where((F.col("coordinate_system") == "pixel") & F.col("bbox_pixel").isNotNull())
    x = [pixel_to_data(F.col("bbox_pixel")[i], width, *x_axis) for i in (0, 2)]
    y = [pixel_to_data(F.col("bbox_pixel")[i], height, *y_axis) for i in (1, 3)]
    return rows.withColumns({"x_min": F.least(*x), "x_max": F.greatest(*x), "y_min": F.least(*y), "y_max": F.greatest(*y)})


def paint_mask(dets: DataFrame, nx: int, ny: int, least: float, order: str = "det_id") -> DataFrame:
    """The last box that covers a cell decides it, with ``least`` confidence at least."""
    last = F.max_by(F.greatest(F.col("confidence"), F.lit(least)), F.col(order))
    return cells(dets, nx, ny).groupBy("image", "x", "y").agg(last.alias("confidence"))
