"""The models of a plan: from an instruction (parameters) and a context (tables) to detections.

Context tables: ``curve`` (well, idx, depth and value columns), ``traces`` (il,
trace, samples), ``cube`` (il, trace, s, p). An instruction is a small
dictionary on the driver; what it asks for is declared on the tables.
Identifiers are made of places, so that they are the same in every run.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.geometry import settled
from quarry.operators import curves, detections, documents, kernels, ml, sections

Context = dict[str, DataFrame]

#: Confidences of the rule model with ranges, over the whole curve and without a curve.
RANGE_SURE, SCAN_SURE, UNSEEN_SURE = 0.95, 0.90, 0.70
#: Confidences of rules that the log analyzer only passes on.
RULE_SURE, FALLBACK_SURE = 0.75, 0.65
#: Curves that are missing read as these, in the analyzer and in the learned model.
ANALYZER_DEFAULTS = {"den": 2.5, "rt": 5.0, "cnl": 0.2}
LEARNED_DEFAULTS = {"gr": 95.0, "rt": 3.0, "den": 2.55, "cnl": 0.25}


def _read_rules(spark: SparkSession, asked: list) -> list[tuple[list[tuple[float, float]], Row | None]]:
    """Depth ranges, in any of their spellings, and the parsed rule of each of a plan's few rules: one job for all."""
    rows = [(k, json.dumps(x), str(x.get("rule", ""))) if isinstance(x, dict) else (k, "{}", "") for k, x in enumerate(asked)]
    if not rows:
        return []
    read = spark.createDataFrame(rows, "k int, raw string, text string").select("k", documents.depth_ranges(documents.range_of(F.col("raw"))).alias("r"), rules.parse_rule(F.col("text")).alias("p"))
    return [([(x["top"], x["bottom"]) for x in row["r"]], row["p"]) for row in sorted(read.collect(), key=lambda row: row["k"])]


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _session(ctx: Context) -> SparkSession:
    return next(iter(ctx.values())).sparkSession if ctx else SparkSession.getActiveSession()


_RULE_ROW = "id string, class_name string, depth_top double, depth_bottom double, thickness double, confidence double, rule string, evidence string, result string"


def traditional_code(ins: dict, ctx: Context) -> DataFrame:
    """Threshold rules over curves.

    ``rules``: [{class_name, rule, a depth range under any of its names}], or one
    such rule itself. A rule that parses and whose curve is there gives runs,
    within its ranges if it has any; else its ranges themselves, else a row that
    says so.
    """
    spark = _session(ctx)
    asked = ins["rules"] if "rules" in ins else [ins] if "rule" in ins else None
    if asked is None:
        return _literal(spark, [{"id": "code_custom_0", "class_name": ins.get("class_name", "custom"), "result": "no rules specified"}], _RULE_ROW)
    curve, parts = ctx.get("curve"), []
    for k, (rule, (ranges, parsed)) in enumerate(zip(asked, _read_rules(spark, asked), strict=True)):
        if isinstance(rule, str):
            parts.append(_literal(spark, [{"id": f"code_str_{k}", "class_name": rule}], _RULE_ROW))
            continue
        name, text = rule.get("class_name", "segment"), rule.get("rule", "")
        value = parsed and next((c for c in curve.columns if c.lower() == parsed["variable"].lower()), None) if curve is not None else None
        if value:
            for top, bottom in ranges or [(None, None)]:
                runs = curves.threshold_segments(curve, value, parsed["op"], parsed["threshold"], top=top, bottom=bottom)
                said = f"{parsed['variable']}{parsed['op']}{parsed['threshold']}"
                evidence = F.concat(F.lit(f"{said} -> mean="), settled(F.col("mean_value"), 2).cast("string")) if ranges else F.lit(f"{said} over the whole curve")
                parts.append(runs.select("well", F.format_string(f"code_{name}_{k}_%s_%.1f", F.col("well").cast("string"), F.col("depth_top")).alias("id"), F.lit(name).alias("class_name"), "depth_top", "depth_bottom", "thickness", F.lit(RANGE_SURE if ranges else SCAN_SURE).alias("confidence"), F.lit(text).alias("rule"), evidence.alias("evidence"), F.lit(None).cast("string").alias("result")))
        elif ranges:
            parts.append(_literal(spark, [{"id": f"code_{name}_{k}_{j}", "class_name": name, "depth_top": round(t, 1), "depth_bottom": round(b, 1), "thickness": round(b - t, 1), "confidence": UNSEEN_SURE, "rule": text, "evidence": "based on expected depth ranges"} for j, (t, b) in enumerate(ranges)], _RULE_ROW))
        else:
            parts.append(_literal(spark, [{"id": f"code_{name}_{k}", "class_name": name, "rule": text, "result": "no curve data or depth range provided"}], _RULE_ROW))
    return _union(parts) if parts else _literal(spark, [], _RULE_ROW)


def _with_curves(curve: DataFrame, missing: dict[str, float]) -> DataFrame:
    return curve.withColumns({c: F.lit(v) for c, v in missing.items() if c not in curve.columns})


def _passed_on(spark: SparkSession, ins: dict, prefix: str, default: str, sure: float, cut: int | None = None) -> DataFrame | None:
    """Ranges of an instruction's rules as they are."""
    asked = ins.get("rules") or []
    rows = [{"id": f"{prefix}_{k}_{j}", "class_name": rule.get("class_name", default), "depth_top": t, "depth_bottom": b, "confidence": sure, "rule": str(rule.get("rule", ""))[:cut]} for k, (rule, (ranges, _)) in enumerate(zip(asked, _read_rules(spark, asked), strict=True)) if isinstance(rule, dict) for j, (t, b) in enumerate(ranges)]
    return _literal(spark, rows, "id string, class_name string, depth_top double, depth_bottom double, confidence double, rule string") if rows else None


def well_log_analyzer(ins: dict, ctx: Context) -> DataFrame | None:
    """Segments with their lithology (merged in order) and zones with their fluid.

    ``analysis_type``: curve_segmentation, fluid_identification or full_analysis.
    Without curves, or where nothing is found, the rules' own ranges are passed on.
    """
    spark, kind, parts = _session(ctx), ins.get("analysis_type", "full_analysis"), []
    curve = ctx.get("curve")
    if kind in ("curve_segmentation", "full_analysis"):
        if curve is not None and "gr" in curve.columns:
            segs = curves.classified_segments(_with_curves(curve, ANALYZER_DEFAULTS)).withColumnRenamed("gr_mean", "mean_value")
            merged = curves.merge_fold(segs, keep=("confidence", "den_mean", "rt_mean"))
            parts.append(merged.select("well", F.format_string("wl_seg_%s_%.1f", F.col("well").cast("string"), F.col("depth_top")).alias("id"), F.col("lithology").alias("class_name"), "depth_top", "depth_bottom", "confidence", "lithology", F.col("mean_value").alias("gr_mean"), settled(F.col("den_mean"), 3).alias("den_mean"), settled(F.col("rt_mean"), 1).alias("rt_mean"), F.lit("curve_segmentation").alias("analysis")))
        elif passed := _passed_on(spark, ins, "wl_rule", "segment", RULE_SURE):
            parts.append(passed)
    if kind in ("fluid_identification", "full_analysis") and curve is not None and "rt" in curve.columns:
        z = curves.fluid_zones(_with_curves(curve, ANALYZER_DEFAULTS))
        parts.append(z.select("well", F.format_string("wl_fluid_%s_%.1f", F.col("well").cast("string"), F.col("depth_top")).alias("id"), F.col("fluid").alias("class_name"), settled(F.col("depth_top"), 1).alias("depth_top"), settled(F.col("depth_bottom"), 1).alias("depth_bottom"), "confidence", F.col("fluid").alias("fluid_type"), settled(F.col("rt_mean"), 1).alias("rt_mean_ohmm"), settled(F.col("den_mean"), 3).alias("den_mean"), settled(F.col("cnl_mean"), 3).alias("cnl_mean"), "evidence", F.lit("fluid_identification").alias("analysis")))
    out = _union(parts)
    if ins.get("rules") and (out is None or out.isEmpty()):
        return _passed_on(spark, ins, "wl_fb", "zone", FALLBACK_SURE, 120)
    return out


def well_log_ml(ins: dict, ctx: Context, model: ml.LithologyModel | None = None) -> DataFrame:
    """Lithology by the forest over sliding windows, fluids by their bounds, equal neighbours merged.

    ``analysis_type``: lithology, fluid or full; ``depth_range``: {top_m, bottom_m}.
    """
    spark, curve = _session(ctx), ctx.get("curve")
    if curve is None:
        return _literal(spark, [{"id": "wlml_no_data", "result": "need curves in context"}], "id string, result string")
    lim = ins.get("depth_range") or {}
    number = lambda k: float(lim[k]) if str(lim.get(k) or "").replace(".", "", 1).lstrip("-").isdigit() else None
    w = curves.sliding_features(_with_curves(curve, LEARNED_DEFAULTS), top=number("top_m"), bottom=number("bottom_m"))
    model = model or ml.default_lithology(spark)
    found = model.predict(w)
    fluid = rules.ml_fluid(F.col("lithology"), F.col("rt_mean"), F.col("den_mean"), F.col("cnl_mean")) if ins.get("analysis_type", "full") in ("fluid", "full") else F.lit(None).cast("string")
    found = found.withColumn("fluid_type", fluid).withColumn("first", F.struct("start_idx", settled(F.col("rt_mean"), 1).alias("rt"), settled(F.col("den_mean"), 3).alias("den"), "confidence"))
    merged = curves.merge_islands(found, ["lithology", "fluid_type"], 3.0, first="first")
    has = F.col("fluid_type").isNotNull()
    return merged.select("well", F.format_string("wlml_%s_%d", F.col("well").cast("string"), F.col("first.start_idx")).alias("id"), F.col("lithology").alias("class_name"), settled(F.col("depth_top"), 1).alias("depth_top"), settled(F.col("depth_bottom"), 1).alias("depth_bottom"), "lithology", settled(F.col("confidence"), 3).alias("lithology_confidence"), "fluid_type", F.when(has, settled(F.col("first.confidence") * 0.85, 3)).alias("fluid_confidence"), F.when(has, F.col("first.rt")).alias("rt_mean"), F.when(has, F.col("first.den")).alias("den_mean"))


def _boxes(ins: dict) -> list[tuple[int, list[float]]]:
    """Regions of interest that have a box, with their place in the list."""
    found = [(i, r.get("bbox_norm") or r.get("bbox_xyxy_norm")) for i, r in enumerate(ins.get("regions_of_interest") or [])]
    return [(i, [float(v) for v in b]) for i, b in found if b and len(b) == 4]


_EXTRACTED = ("envelope", "phase", "frequency", "rms_amplitude", "sweetness")


def attribute_extractor(ins: dict, ctx: Context) -> DataFrame | None:
    """Statistics of each attribute, of each region of interest if there are any.

    ``attributes``: envelope, phase, frequency, rms_amplitude, sweetness, glcm,
    spectral; others give nothing. ``spectral_bands``: [[low, high], ...] as
    frequencies a sample, three bands without.
    """
    names = [a for a in ins.get("attributes") or [] if a in (*_EXTRACTED, "glcm", "spectral")]
    traces = ctx.get("traces")
    if not names or traces is None:
        return None
    edges = ins.get("spectral_bands") or [(0.0, 0.125), (0.125, 0.25), (0.25, 0.425)]
    bands = {f"spectral_{int(a)}-{int(b)}hz" if ins.get("spectral_bands") else f"spectral_{a}-{b}": (float(a), float(b)) for a, b in edges} if "spectral" in names else {}
    plain, parts = [n for n in names if n in _EXTRACTED], []
    for index, box in _boxes(ins) if ins.get("regions_of_interest") else [(None, None)]:
        if plain or bands:
            maps = kernels.section_maps(traces, plain, box, bands)
            each = maps.select("il", F.explode(F.array(*[F.struct(F.lit(n).alias("attribute_name"), F.col(f"`{n}`").alias("amp")) for n in [*plain, *bands]])).alias("m")).select("il", "m.*")
            stats = each.where(~F.isnan("amp") & (F.abs("amp") < float("inf"))).groupBy("il", "attribute_name").agg(F.min("amp").alias("lo"), F.max("amp").alias("hi"), F.avg("amp").alias("mean"), F.stddev_pop("amp").alias("std"))
            parts.append(stats.withColumn("roi_index", F.lit(index).cast("int")))
        if "glcm" in names:
            sub = kernels.section_maps(traces, ["amplitude"], box).withColumnRenamed("amplitude", "amp")
            texture = sections.glcm(sub)
            each = texture.select("il", F.explode(F.array(*[F.struct(F.lit(f"glcm_{c}").alias("attribute_name"), F.col(c).alias("v")) for c in ("energy", "contrast", "homogeneity", "correlation")])).alias("m")).select("il", "m.*")
            parts.append(each.select("il", "attribute_name", F.col("v").alias("lo"), F.col("v").alias("hi"), F.col("v").alias("mean"), F.lit(0.0).alias("std"), F.lit(index).cast("int").alias("roi_index")))
    out = _union(parts)
    if out is None:
        return None
    ident = F.concat(F.lit("attr_"), F.col("attribute_name"), F.coalesce(F.concat(F.lit("_roi"), F.col("roi_index").cast("string")), F.lit("")))
    return out.select("il", ident.alias("id"), "attribute_name", "roi_index", *[settled(F.col(c), 4).alias(c) for c in ("lo", "hi", "mean", "std")])


#: Maps that the facies model knows, by the names of its parameter.
FACIES_MAPS = {"envelope": "envelope", "phase": "phase", "frequency": "phase_step", "gradient_magnitude": "gradient_magnitude", "local_variance": "local_variance", "local_entropy": "local_entropy", "dip": "dip"}


def facies_classifier(ins: dict, ctx: Context) -> DataFrame | None:
    """Clusters of samples by their attributes, with size, centroid, means and the feature that tells most.

    ``n_clusters``, ``attribute_list``, ``method`` (gmm or kmeans),
    ``regions_of_interest``. All sections of the context are clustered together;
    fewer than ten samples a cluster give nothing, as do clusters under ten.
    """
    traces, k = ctx.get("traces"), int(ins.get("n_clusters", 4))
    if traces is None:
        return None
    asked = ins.get("attribute_list") or ["envelope", "gradient", "local_variance"]
    known = [n for n in asked if n in FACIES_MAPS]
    features = [FACIES_MAPS[n] for n in known] or ["amplitude"]
    rows = kernels.section_maps(traces, list(dict.fromkeys(features)))
    if boxes := _boxes(ins):
        size = traces.groupBy("il").agg((F.max("trace") + 1).alias("_nt"), F.max(F.size("samples")).alias("_ns"))
        at = lambda v, n: F.least(F.greatest(F.lit(v) * F.col(n), F.lit(0.0)), F.col(n) - 1).cast("int")
        inside = [F.col("trace").between(at(b[0], "_nt"), at(b[2], "_nt")) & F.col("s").between(at(b[1], "_ns"), at(b[3], "_ns")) for _, b in boxes]
        rows = rows.join(size, "il").where(reduce(Column.__or__, inside)).drop("_nt", "_ns")
    features = list(dict.fromkeys(features))
    rows = rows.persist()  # iterations read it again and again; what does not fit in memory goes to disk
    if rows.count() < 10 * k:
        rows.unpersist()
        return None
    found = ml.cluster_facies(rows, features, k, ins.get("method", "gmm"))
    stats = rows.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    each = found.groupBy("cluster_id").agg(F.count("*").alias("area_pixels"), F.avg("trace").alias("cx"), F.avg("s").alias("cy"), *[F.avg(f).alias(f) for f in features]) if set(features) <= set(found.columns) and found.columns else None
    each = each.where("area_pixels >= 10").crossJoin(F.broadcast(stats))  # one row
    names = ins.get("attribute_list")
    told = F.greatest(*[F.struct(F.abs((F.col(f) - F.col(f"_m_{f}")) / (F.col(f"_s_{f}") + F.lit(1e-8))).alias("v"), F.lit(-i).alias("i"), F.lit(names[i] if names else f"attr_{i}").alias("n")) for i, f in enumerate(features)])["n"]
    centre = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f"attr_{i}"), settled(F.col(f), 4))])
    return each.select(F.concat(F.lit("facies_cluster_"), F.col("cluster_id").cast("string")).alias("id"), "cluster_id", "area_pixels", F.array("cx", "cy").alias("centroid_xy"), centre.alias("cluster_center"), told.alias("dominant_feature"), F.lit(len(features)).alias("n_attributes_used"))


def horizon_tracker(ins: dict, ctx: Context) -> DataFrame | None:
    """Horizons from seed points: one row per section and seed, with its points and scores.

    ``seed_points``: [{trace_idx or cdp, sample_idx or time_ms}];
    ``tracking_mode``: correlation, or peak, trough, zero_crossing_pos2neg,
    zero_crossing_neg2pos to move a seed first; ``search_window_samples``;
    ``horizon_name``. ``time_ms`` is read against the context's ``time_axis_ms``.
    """
    traces, seeds = ctx.get("traces"), ins.get("seed_points") or []
    if traces is None or not seeds:
        return None
    mode, name = ins.get("tracking_mode", "correlation"), ins.get("horizon_name", "H")
    points = sections.track_seeds(traces, seeds, mode, int(ins.get("search_window_samples", 10)), ctx.get("time_axis_ms"))
    keys = ["il", "seed", "seed_trace", "seed_sample"]
    gap = (F.col("trace") - F.lag("trace").over(Window.partitionBy("il", "seed").orderBy("trace")) > 1).cast("int")
    item = F.struct(F.col("trace").alias("trace_idx"), F.col("s").alias("sample_idx"), settled(F.col("confidence"), 3).alias("confidence"))
    out = points.withColumn("gap", gap).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("points"), settled(1 / (1 + F.coalesce(F.avg("gap"), F.lit(0.0))), 3).alias("continuity_score"), settled(F.avg(settled(F.col("confidence"), 3)), 3).alias("average_confidence"), F.count("*").alias("n_points"))
    return out.select("il", F.format_string(f"htrack_{name}_%d", "seed").alias("id"), F.format_string(f"{name}_%d", "seed").alias("horizon_name"), F.col("seed_trace").alias("seed_trace_idx"), F.col("seed_sample").alias("seed_sample_idx"), F.lit(mode).alias("tracking_mode"), "points", "continuity_score", "average_confidence", "n_points")


#: Class names of the tasks, and the maps whose least is the probability of each attribute.
TASK_CLASSES = {"fault_detection": "fault", "facies_classification": "facies", "fracture": "fracture"}
FUSED = {"coherence": ["coherence_fault"], "coherence+gradient": ["coherence_fault"], "structure_tensor": ["structure_tensor"], "gradient": ["gradient_fault"], "both": ["coherence_fault", "structure_tensor", "gradient_fault"], "variance": ["variance_fault"]}


def seismic_domain_model(ins: dict, ctx: Context) -> DataFrame | None:
    """Regions where the fused attributes pass a threshold, overlapping ones suppressed.

    ``task``, ``attribute``, ``confidence_threshold`` (a probability, or from 1 a
    percentile), ``min_region_area_pixels``, ``regions_of_interest``: in those,
    the threshold is 0.7 of the given one and the area half, and what remains is
    suppressed again across regions.
    """
    traces, maps = ctx.get("traces"), FUSED.get(ins.get("attribute", "gradient"))
    if traces is None or not maps:
        return None
    least, area = float(ins.get("confidence_threshold", 0.3)), int(ins.get("min_region_area_pixels", 100))
    name = TASK_CLASSES.get(ins.get("task", "fault_detection"), ins.get("task"))

    def found(box: list[float] | None, index: int, threshold: float, size: int) -> DataFrame:
        prob = kernels.section_maps(traces, maps, box, clip=True, least=(5, 10) if box else (0, 0))
        prob = prob.select("il", "trace", "s", (F.least(*maps) if len(maps) > 1 else F.col(maps[0])).alias("p"))
        r = sections.region_stats(sections.label_regions(sections.probability_mask(prob, threshold)), size)
        kept = detections.suppress_hulls(r, 0.3)
        return kept.select("il", F.format_string(f"seisattr_{name}_{index}_%d", "region").alias("id"), F.lit(name).alias("class_name"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], settled(F.col("confidence"), 3).alias("confidence"), F.col("area").alias("area_pixels"), settled(F.col("aspect"), 1).alias("aspect_ratio"), F.lit(ins.get("attribute", "gradient")).alias("attribute"))

    if not ins.get("regions_of_interest"):
        return found(None, 0, least, area)
    out = _union([found(b, i, least * 0.7, area // 2) for i, b in _boxes(ins)])
    if out is None:
        return None
    boxes = out.select(F.col("il").alias("image"), F.lit(0).alias("class_id"), F.col("id").alias("det_id"), "x1", "y1", "x2", "y2", "confidence")
    kept = detections.nms_greedy(boxes, 0.3).select(F.col("image").alias("il"), F.col("det_id").alias("id"))
    return out.join(kept, ["il", "id"], "left_semi")


def sam(ins: dict, ctx: Context) -> DataFrame:
    """Area, hull and centroid of a prompted mask; a row of area 0 where there is none.

    ``prompt_type`` bbox: the samples of the box (pixels, ends included) above
    its mean and half a deviation, a flat box whole; point: what hangs together
    with the point within ``tolerance`` of its value.
    """
    label, kind, value = ins.get("label", "segment"), ins.get("prompt_type", "bbox"), [float(v) for v in ins.get("prompt_value") or []]
    traces = ctx.get("traces")
    empty = _literal(_session(ctx), [{"id": f"sam_{label}_noinput", "label": label, "mask_area_pixels": 0}], "id string, label string, mask_area_pixels long")
    if traces is None or len(value) != {"bbox": 4, "point": 2}.get(kind):
        return empty
    sec = traces.select("il", "trace", F.posexplode("samples").alias("s", "amp"))
    if kind == "bbox":
        x1, y1, x2, y2 = (max(0, int(v)) for v in value)
        stats = sections.mask_stats(sec.where(F.col("trace").between(x1, x2) & F.col("s").between(y1, y2)))
    else:
        seeds = sec.select("il").distinct().select("il", F.lit(int(value[0])).alias("trace"), F.lit(int(value[1])).alias("s"))
        stats = sections.flood_fill(sec, seeds, float(ins.get("tolerance", 0.15)))
    return stats.select("il", F.format_string(f"sam_{label}_%s", F.col("il").cast("string")).alias("id"), F.lit(label).alias("label"), F.col("area").alias("mask_area_pixels"), F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox_pixel"), F.array("cx", "cy").alias("centroid"))


def cube_regions(cube: DataFrame, threshold: float, class_name: str, prefix: str, least: int = 20) -> DataFrame:
    """Regions of a probability cube, slice by slice; slices under the threshold have none."""
    r = sections.region_stats(sections.label_regions(cube.where(F.col("p") >= threshold)), least)
    return r.select(F.format_string(f"{prefix}_%d_%d", "il", "region").alias("id"), F.lit(class_name).alias("class_name"), F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox_pixel"), settled(F.col("mean_value"), 3).alias("confidence"), F.col("il").alias("slice_index"), F.col("area").alias("area_pixels"))


def cig_fault(ins: dict, ctx: Context) -> DataFrame | None:
    """Faults of a probability cube made elsewhere (``cube``); ``threshold`` 0.5."""
    cube = ctx.get("cube")
    return None if cube is None else cube_regions(cube, float(ins.get("threshold", 0.5)), "fault", "cigfault")


def cig_channel(ins: dict, ctx: Context) -> DataFrame | None:
    """Channels of a score cube; ``threshold`` 2.0 for scores summed over scales, else 0.5."""
    cube = ctx.get("cube")
    default = 2.0 if ins.get("accumulate", "sum") == "sum" else 0.5
    return None if cube is None else cube_regions(cube, float(ins.get("threshold", default)), "channel", "cigchannel")
