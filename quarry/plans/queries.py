"""The registered queries: operators over the views, one entry each."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import geometry, rules
from quarry.operators import curves, documents, kernels, ml, overlaps, retrieval, schemas, scores, sections
from quarry.operators import detections as det
from quarry.plans import models
from quarry.plans.loop import Step, Verdict
from quarry.plans.loop import closed_loop as closed_loop_of
from quarry.plans.registry import Registry
from quarry.session import shared_dir, written
from quarry.sources import files, views
from quarry.streaming import runs, windows

N_SAMPLES = 64
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; a shift far below the last digit settles halves alike."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-9), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- curves ---------------------------------------------------------------


@query
def curve_threshold_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.threshold_segments(views.event_curve(spark, sf_dir), "x", "<", 20.0))


@query
def curve_crossings(spark, sf_dir):
    return rounded(curves.crossings(views.event_curve(spark, sf_dir), "x", 20.0))


@query
def sand_intervals(spark, sf_dir):
    return rounded(curves.crossing_intervals(views.line_curve(spark, sf_dir), "gr", 120.0, 1.0))


@query
def curve_gradient_z(spark, sf_dir):
    z = curves.gradient_z(views.line_curve(spark, sf_dir), "gr").where("z > 2")
    return rounded(z.select("well", "idx", "g", "z"))


@query
def curve_changepoints(spark, sf_dir):
    c = curves.classified_segments(views.line_curve(spark, sf_dir), 3.0)
    return rounded(c.select("well", "start_idx", "end_idx", "depth_top", "depth_bottom", "gr_mean", "den_mean", "rt_mean", "lithology", "confidence"))


@query
def litho_classify(spark, sf_dir):
    c = views.line_curve(spark, sf_dir).withColumn("_l", rules.lithology(F.col("gr"), F.col("den"), F.col("rt")))
    return rounded(c.groupBy("_l.lithology", "_l.confidence").agg(F.count("*").alias("n"), F.avg("gr").alias("gr_mean")))


@query
def fluid_zones(spark, sf_dir):
    z = curves.fluid_zones(views.line_curve(spark, sf_dir), 15.0)
    return rounded(z)


@query
def fluid_two_stage(spark, sf_dir):
    c = views.line_curve(spark, sf_dir)
    return c.groupBy("well", rules.two_stage_fluid(F.col("rt"), F.col("den")).alias("fluid")).agg(F.count("*").alias("n"))


def _segments(spark, sf_dir) -> DataFrame:
    return curves.classified_segments(views.line_curve(spark, sf_dir), 2.0).withColumnRenamed("gr_mean", "mean_value")


@query
def merge_adjacent_fold(spark, sf_dir):
    return rounded(curves.merge_fold(_segments(spark, sf_dir), 5.0))


@query
def merge_adjacent_islands(spark, sf_dir):
    return rounded(curves.merge_islands(_segments(spark, sf_dir), ["lithology"], 3.0))


@query
def welllog_windows(spark, sf_dir):
    w = curves.sliding_features(views.line_curve(spark, sf_dir), top=1005.0, bottom=1070.0)
    lith = rules.lithology(F.col("gr_mean"), F.col("den_mean"), F.col("rt_mean"))["lithology"]
    fluid = rules.ml_fluid(lith, F.col("rt_mean"), F.col("den_mean"), F.col("cnl_mean"))
    return rounded(w.withColumn("lithology", lith).withColumn("fluid", fluid))


@query
def rule_parse(spark, sf_dir):
    """A rule for every line item, in all spellings, held against a value of the item."""
    li = views.table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    forms = [F.concat(F.lit("GR<"), F.col("q")), F.concat(F.lit("RT > "), F.col("q")), F.concat(F.lit("DEN <= "), F.col("q"), F.lit(".5")), F.concat(F.col("q"), F.lit("<GR<1"), F.col("q")), F.concat(F.lit("CNL>="), F.col("q"), F.lit(" AND DEN<2.35"))]
    rule = F.when(F.col("l_partkey") % 13 == 0, F.lit("none")).when(F.col("l_partkey") % 11 == 0, F.lit("GR<-5")).otherwise(F.element_at(F.array(*forms), (F.col("l_suppkey") % 5 + 1).cast("int")))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", rule.alias("rule"), (F.col("l_partkey") % 60).cast("double").alias("value"))
    p = rules.parse_rule(F.col("rule"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "rule", p["variable"].alias("variable"), p["op"].alias("op"), p["threshold"].alias("threshold"), rules.holds(F.col("rule"), F.col("value")).alias("holds"))


@query
def depth_ranges(spark, sf_dir):
    """A depth range for every order, in all spellings."""
    a, b = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 50).cast("string")
    raws = [F.concat(F.lit('{"expected_range":[{"top_m":'), a, F.lit(',"bottom_m":'), b, F.lit("}]}")), F.concat(F.lit('{"target_range":[['), a, F.lit(',"'), b, F.lit('"]]}')), F.concat(F.lit('{"depth_range":["'), a, F.lit('",'), b, F.lit("]}")), F.concat(F.lit('{"depth_ranges":[{"top":1,"bottom":"x"},['), a, F.lit(","), b, F.lit("]]}")), F.concat(F.lit('{"expected_range":[],"depth_range":['), a, F.lit(","), b, F.lit("]}")), F.concat(F.lit('{"other":'), a, F.lit("}"))]
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*raws), (F.col("o_custkey") % 6 + 1).cast("int")).alias("raw"))
    found = o.select("o_orderkey", F.posexplode(documents.depth_ranges(documents.range_of(F.col("raw")))).alias("pos", "r"))
    return found.select("o_orderkey", "pos", "r.top", "r.bottom")


@query
def parse_scales(spark, sf_dir):
    """Lists of numbers, and of what is none, of every order."""
    raw = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_orderpriority")), F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".5 ")))
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", F.posexplode(documents.parse_scales(F.col("raw"))).alias("pos", "scale"))


@query
def nearest_sample(spark, sf_dir):
    c = views.event_curve(spark, sf_dir)
    t = c.select("well").distinct().select("well", F.explode(F.array(*[F.lit(x) for x in (1001.0, 1003.37, 1010.5)])).alias("t"))
    near = files.nearest(c, t, "well", "depth", "t").where(F.abs(F.col("nearest") - F.col("t")) < 1.0)
    return near.select("well", "t", F.round((F.col("nearest") - F.lit(views.TOP_M)) / F.lit(views.STEP_M)).cast("long").alias("idx"))


@query
def interval_recall(spark, sf_dir):
    found = curves.crossing_intervals(views.line_curve(spark, sf_dir), "gr", 120.0, 1.0)
    return curves.interval_recall(views.ground_truth(spark), found)


@query
def tolerance_match(spark, sf_dir):
    found = curves.crossing_intervals(views.line_curve(spark, sf_dir), "gr", 120.0, 1.0)
    return rounded(curves.tolerance_match(views.ground_truth(spark), found, 3.0))


@query
def labelled_hits(spark, sf_dir):
    """Sands are of two kinds by their well, truths by their number; a hit is of one kind and holds the middle."""
    kind = lambda c: F.when(c % 2 == 0, "gas").otherwise("water").alias("fluid")
    sands = curves.crossing_intervals(views.line_curve(spark, sf_dir), "gr", 120.0, 1.0).select("well", "depth_top", "depth_bottom", kind(F.col("well")))
    truth = views.ground_truth(spark).select("gt_id", ((F.col("gt_top") + F.col("gt_bottom")) / 2).alias("gt_depth"), kind(F.substring("gt_id", 2, 1).cast("int")))
    return curves.labelled_hits(truth, sands, "fluid")


@query
def eval_summary(spark, sf_dir):
    lab = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    out = lab.groupBy("source").agg(F.count("*").alias("runs"), F.avg("quality").alias("pass_rate"), F.stddev_pop("quality").alias("pass_std"), F.sum(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("clean"), F.avg(F.lit(0.7) * F.col("quality") + F.lit(0.3) * (1 - F.col("toxic"))).alias("score"))
    return rounded(out)


# --- detections -----------------------------------------------------------


def _dets(spark, sf_dir) -> DataFrame:
    return views.detections(spark, sf_dir).drop("e6")


@query
def geom_pixel_to_data(spark, sf_dir):
    d = _dets(spark, sf_dir)
    px = lambda c, n: F.col(c) * n
    x = [geometry.pixel_to_data(px(c, 1000), 1000, 0.0, 300.0) for c in ("x1", "x2")]
    y = [geometry.pixel_to_data(px(c, 500), 500, 2500.0, 0.0) for c in ("y1", "y2")]
    return rounded(d.select("det_id", F.least(*x).alias("cdp_min"), F.greatest(*x).alias("cdp_max"), F.least(*y).alias("time_min"), F.greatest(*y).alias("time_max")))


@query
def geom_data_to_pixel(spark, sf_dir):
    d = _dets(spark, sf_dir)
    return rounded(d.select("det_id", geometry.data_to_pixel(F.col("x1") * 300, 1000, 0.0, 300.0).alias("px"), geometry.data_to_pixel(F.col("y1") * 2500, 500, 0.0, 2500.0).alias("py"), geometry.data_to_pixel(F.col("y1"), 500, 5.0, 5.0).alias("flat")))


@query
def bbox_iou(spark, sf_dir):
    a = _dets(spark, sf_dir).drop("confidence")
    pairs = overlaps.box_pairs(a, a, ["image", "class_id"], "o_", 0.2)
    return rounded(pairs.where("det_id < o_det_id").select("det_id", F.col("o_det_id").alias("other"), "iou"))


@query
def det_tag(spark, sf_dir):
    d = _dets(spark, sf_dir).select("det_id", F.col("image").alias("step"), F.when(F.col("det_id") % 3 == 0, F.col("det_id")).alias("given_id"))
    return det.tag(d, "model", ["det_id"]).select("det_id", "step", "tag")


def _mixed(spark, sf_dir) -> DataFrame:
    """Detections of five shapes, by their number."""
    k = F.col("det_id") % 5
    d = _dets(spark, sf_dir)
    null = lambda t: F.lit(None).cast(t)
    pt = lambda x, y: F.struct(F.floor(F.col(x) * 1000).cast("int").alias("trace_idx"), F.floor(F.col(y) * 500).cast("int").alias("sample_idx"))
    return d.select(
        "det_id",
        F.when(k == 0, F.lit("fault")).alias("class_name"),
        F.when(k == 1, F.lit("seg")).alias("label"),
        F.when(k == 2, F.lit("H1")).alias("horizon_name"),
        F.when(k == 3, F.col("class_id")).alias("cluster_id"),
        F.when(F.col("det_id") % 2 == 0, F.col("confidence")).alias("confidence"),
        F.when(k == 0, F.array(*[F.col(c) for c in det.BOX])).alias("bbox_norm"),
        F.when(k == 1, F.array(F.col("x1") * 1000, F.col("y1") * 500, F.col("x2") * 1000, F.col("y2") * 500)).alias("bbox_pixel"),
        F.when(k == 2, F.array(pt("x1", "y2"), pt("x2", "y1"))).otherwise(null("array<struct<trace_idx:int,sample_idx:int>>")).alias("points"),
        F.when(k == 3, F.array(F.col("x1") * 1000, F.col("y1") * 500)).alias("centroid_xy"),
        F.when((k == 3) & (F.col("det_id") % 2 == 0), F.lit(400)).alias("area_pixels"),
    )


@query
def det_normalize(spark, sf_dir):
    n = det.normalize(_mixed(spark, sf_dir), 1000, 500)
    return rounded(n.select("det_id", "class_name", "confidence", *[F.col("box")[i].alias(c) for i, c in enumerate(det.BOX)]))


@query
def det_to_json(spark, sf_dir):
    d = _dets(spark, sf_dir)
    ms = geometry.pixel_to_data(F.col("y1") * 500, 500, 0.0, 2500.0)
    return d.select("image", F.to_json(F.struct(F.col("det_id").alias("id"), F.col("class_id").alias("class"), F.round(ms).cast("int").alias("time_ms"))).alias("json"))


@query
def dedup_by_id(spark, sf_dir):
    d = _dets(spark, sf_dir).withColumn("key", F.when(F.col("det_id") % 11 != 0, F.col("det_id") % 97))
    return rounded(det.dedup_by_id(d, "key", "det_id").select("det_id", F.coalesce("key", F.lit(-1)).alias("key"), "confidence"))


@query
def fp_match_iou(spark, sf_dir):
    m = det.match_verifications(views.verifications(spark, sf_dir), _dets(spark, sf_dir))
    return rounded(m.select("ver_id", "matched", "iou"))


@query
def fp_filter(spark, sf_dir):
    o = det.filter_false_positives(views.verifications(spark, sf_dir), _dets(spark, sf_dir))
    return o.select("ver_id", "matched", "outcome")


@query
def fp_survivors(spark, sf_dir):
    d = _dets(spark, sf_dir)
    o = det.filter_false_positives(views.verifications(spark, sf_dir), d)
    return det.surviving(d, o).groupBy("image").agg(F.count("*").alias("n"))


@query
def nms_greedy(spark, sf_dir):
    return rounded(det.nms_greedy(_dets(spark, sf_dir), 0.3))


@query
def nms_antijoin(spark, sf_dir):
    return rounded(det.nms_all(_dets(spark, sf_dir), 0.3).select("image", "class_id", "det_id", "confidence"))


@query
def volume_paint(spark, sf_dir):
    d = _dets(spark, sf_dir).withColumn("in_roi", F.when(F.col("det_id") % 13 == 0, F.lit(False)))
    return rounded(det.paint_volume(d, 20, 50))


@query
def slice_mask(spark, sf_dir):
    return rounded(det.paint_mask(_dets(spark, sf_dir), 20, 50, 0.25))


@query
def step_image_join(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    r = views.table(spark, sf_dir, "region").where("r_regionkey < 3")
    first = r.agg(F.min_by("r_name", "r_regionkey").alias("first"))
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left").crossJoin(F.broadcast(first))
    return j.select("n_nationkey", F.coalesce("r_name", "first").alias("image"), F.col("r_name").isNull().alias("fallback"))


#: Names of target classes and the task they mean.
CLASS_ALIASES = {"fault": "fault", "horizon": "horizon", "facies": "facies", "fracture": "fracture", "channel": "facies", "reservoir_candidate": "facies", "断层": "fault", "层位": "horizon", "沉积相": "facies", "裂缝": "fracture"}
#: The model recommended for each task.
TASK_MODELS = {"fault": "cig_fault", "horizon": "horizon_tracker", "facies": "facies_classifier", "fracture": "seismic_domain_model"}


def _literal_map(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


@query
def task_hint(spark, sf_dir):
    """The model that the class of every detection asks for; one class is unknown."""
    names = [*CLASS_ALIASES, "salt"]
    r = _dets(spark, sf_dir).select("det_id", F.element_at(F.array(*map(F.lit, names)), (F.col("det_id") % len(names) + 1).cast("int")).alias("cls"))
    task = F.try_element_at(_literal_map(CLASS_ALIASES), F.col("cls"))
    model = F.try_element_at(_literal_map(TASK_MODELS), task)
    return r.select("det_id", "cls", task.alias("task"), F.coalesce(F.concat(F.col("cls"), F.lit(" -> "), model), F.col("cls")).alias("hint"))


# --- retrieval ------------------------------------------------------------


@query
def tokenize(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


def _asked(spark) -> DataFrame:
    rows = [(1, "thing ing the heation"), (2, "license version software"), (3, "keit der ung eine")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in rows])))


@query
def tfidf_topk(spark, sf_dir):
    s = retrieval.tfidf_scores(views.table(spark, sf_dir, "documents"), _asked(spark), "doc_id", "text")
    return rounded(retrieval.top_k(s, "doc_id", 3), 6)


def _parts(spark) -> DataFrame:
    rows = [(1, "Fault zone"), (1, "reservoir"), (2, "well LOG"), (3, "unknown"), (3, "断层与层位")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(p).alias("part")) for i, p in rows])))


@query
def keyword_route(spark, sf_dir):
    """What the keywords in every text of ``documents`` lead to."""
    parts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("part"))
    return retrieval.keyword_route(parts, retrieval.keyword_table(spark))


@query
def hybrid_retrieve(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    ranked = retrieval.top_k(retrieval.tfidf_scores(docs, _asked(spark), "doc_id", "text"), "doc_id", 5).select("query_id", F.col("doc_id").cast("string").alias("doc"), "rank")
    routed = retrieval.keyword_route(_parts(spark), retrieval.keyword_table(spark))
    w = Window.partitionBy("query_id").orderBy("doc_name")
    return retrieval.hybrid(routed.select("query_id", F.col("doc_name").alias("doc"), F.row_number().over(w).alias("rank")), ranked, 3)


@query
def knowledge_text(spark, sf_dir):
    return retrieval.knowledge_text(hybrid_retrieve(spark, sf_dir), views.table(spark, sf_dir, "documents"), "doc_id", "text")


# --- documents and JSON ---------------------------------------------------


@query
def message_explode(spark, sf_dir):
    m = views.table(spark, sf_dir, "conversations").where("role = 'user'")
    return m.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("first_text"))


@query
def section_extract(spark, sf_dir):
    """Every text of ``documents`` as a section of a prompt file, taken out again; without the heading it is taken whole."""
    whole = F.concat(F.lit("# T\n\n## System Prompt\n"), F.col("text"), F.lit("\n\n## Next\nx"))
    body, plain = documents.section_after(whole, "## System Prompt\n"), documents.section_after(F.col("text"), "## System Prompt\n")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.length(body).alias("n_chars"), F.md5(body.cast("binary")).alias("body"), F.md5(plain.cast("binary")).alias("fallback"))


@query
def manifest_slim(spark, sf_dir):
    """A manifest for every part: with a list of curves, with a map of them, and without any."""
    on = F.when(F.col("p_size") % 2 == 1, F.lit("true")).otherwise(F.lit("false"))
    curve = lambda name, available: F.concat(F.lit('{"canonical_name":"'), name, F.lit('","available":'), available, F.lit("}"))
    head = F.concat(F.lit('{"sample_id":"p'), F.col("p_partkey").cast("string"), F.lit('"'))
    raws = [
        F.concat(head, F.lit(',"task":"'), F.col("p_brand"), F.lit('","seismic":{"shape":[1,2]},"well_logs":{"curves":['), curve(F.col("p_type"), on), F.lit(","), curve(F.lit("RT"), F.lit("false")), F.lit("]}}")),
        F.concat(head, F.lit(',"seismic":{},"well_logs":{"curves":{"g":'), curve(F.lit("GR"), F.lit("true")), F.lit(',"d":'), curve(F.col("p_type"), on), F.lit("}}}")),
        F.concat(head, F.lit("}")),
    ]
    r = views.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*raws), (F.col("p_partkey") % 3 + 1).cast("int")).alias("raw"))
    s = r.select("p_partkey", documents.slim_manifest(F.col("raw")).alias("m"))
    return s.select("p_partkey", "m.sample_id", "m.task", F.array_join(F.sort_array("m.curves_present"), ",").alias("curves"))


@query
def run_report(spark, sf_dir):
    d = _dets(spark, sf_dir)
    return d.groupBy("image").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("model_"), F.col("class_id").cast("string")))), ",").alias("models"))


@query
def json_extract(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("noise {} then "), F.col("props"), F.lit(" tail }")).alias("t"), "props")
    return e.select("event_id", F.get_json_object(documents.extract_json("t"), "$.k").alias("k"), documents.extract_json("t").isNotNull().alias("found"))


def _plans(spark, sf_dir) -> DataFrame:
    models = ["traditional_code", "horizon_tracker", "attribute_extractor", "sam", "other"]
    n = views.table(spark, sf_dir, "nation")
    m = F.element_at(F.array(*[F.lit(x) for x in models]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    ins = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"rules":[1],"seed_points":[2]}')).when(F.col("n_nationkey") % 3 == 0, F.lit('{"attributes":["envelope"]}')).otherwise(F.lit("{}"))
    return n.select("n_nationkey", m.alias("model"), ins.alias("instruction"))


@query
def plan_validate(spark, sf_dir):
    return documents.validate_plan(_plans(spark, sf_dir)).select("n_nationkey", "model", "missing")


@query
def schema_validate(spark, sf_dir):
    """A detection in JSON for every embedding, a part of them with one fault each."""
    k, d = F.col("det_id") % 5, F.col("det_id").cast("string")
    raw = F.when(k == 4, F.concat(F.lit("not json "), d)).otherwise(F.concat(F.lit('{"bbox":[0,0,1'), F.when(k == 1, "").otherwise(F.concat(F.lit(","), d)), F.lit('],"confidence":'), F.when(k == 2, "1.5").otherwise("0.5"), F.lit(',"kind":"'), F.when(k == 3, "x").otherwise("fault"), F.lit('"}')))
    r = _dets(spark, sf_dir).select("det_id", raw.alias("raw"))
    field = lambda k: F.get_json_object("raw", f"$.{k}")
    checks = [("bbox", F.size(F.from_json(field("bbox"), "array<double>")) == 4, "4 numbers"), ("confidence", field("confidence").try_cast("double").between(0, 1), "0 to 1"), ("kind", field("kind").isin("fault", "horizon"), "fault or horizon")]
    return documents.validate(r, "raw", checks).select("det_id", "error")


@query
def apply_retry(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("n_name")).alias("old"))
    new = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    m = n.select("n_nationkey", documents.merge_maps(F.col("old"), new).alias("m"))
    return m.select("n_nationkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


# --- sections -------------------------------------------------------------


def _sec(spark, sf_dir) -> DataFrame:
    return views.section(spark, sf_dir)


@query
def section_normalize(spark, sf_dir):
    n = sections.normalize(_sec(spark, sf_dir))
    return rounded(n.groupBy("il", "s").agg(F.avg("value").alias("mean_value"), F.min("value").alias("lo"), F.max("value").alias("hi")))


@query
def attr_stats(spark, sf_dir):
    return rounded(sections.attribute_stats(_sec(spark, sf_dir)))


@query
def attr_stats_roi(spark, sf_dir):
    return rounded(sections.attribute_stats(sections.region(_sec(spark, sf_dir), N_SAMPLES, 0.1, 0.2, 0.6, 0.7)))


@query
def grad_density(spark, sf_dir):
    return rounded(sections.gradient_density(_sec(spark, sf_dir), 0.2))


@query
def moving_rms(spark, sf_dir):
    return rounded(sections.moving_rms(_sec(spark, sf_dir), N_SAMPLES).select("il", "trace", "s", "rms"))


@query
def trace_coherence(spark, sf_dir):
    c = sections.coherence(_sec(spark, sf_dir), N_SAMPLES)
    return rounded(c.select("il", "trace", "s", "coherence", (1 - F.col("coherence")).alias("fault_probability")))


@query
def local_variance(spark, sf_dir):
    return rounded(sections.local_variance(_sec(spark, sf_dir), N_SAMPLES), 5)


@query
def sobel_magnitude(spark, sf_dir):
    return rounded(sections.gradient_magnitude(_sec(spark, sf_dir)))


@query
def glcm(spark, sf_dir):
    return rounded(sections.glcm(_sec(spark, sf_dir)))


def _probability(spark, sf_dir) -> DataFrame:
    """|amp| and a second attribute, fused by their minimum."""
    return _sec(spark, sf_dir).withColumn("p", F.least(F.lit(1.0), F.lit(3.0) * F.abs("amp"), F.lit(0.2) + F.lit(2.0) * F.abs("amp")))


@query
def prob_threshold(spark, sf_dir):
    p = sections.probability_mask(_probability(spark, sf_dir), 95.0)
    return rounded(p.groupBy("il").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.avg("p").alias("mean_p")))


def _labelled(spark, sf_dir) -> DataFrame:
    return sections.label_regions(sections.probability_mask(_probability(spark, sf_dir), 0.5))


@query
def connected_components(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("il", "region").agg(F.count("*").alias("area"))


@query
def region_stats(spark, sf_dir):
    r = sections.region_stats(_labelled(spark, sf_dir), 5)
    return rounded(r.select("il", "region", "area", "x1", "x2", "y1", "y2", "aspect", "confidence"))


@query
def mask_stats(spark, sf_dir):
    return rounded(sections.mask_stats(_sec(spark, sf_dir)))


@query
def flood_fill(spark, sf_dir):
    seeds = _sec(spark, sf_dir).select("il").distinct().select("il", F.lit(3).alias("trace"), F.lit(20).alias("s"))
    return sections.flood_fill(_sec(spark, sf_dir), seeds, 0.08).drop("cx", "cy")


@query
def slice_extract(spark, sf_dir):
    t = views.traces(spark, sf_dir)
    return rounded(t.select("il", "trace", F.size("samples").alias("n"), F.posexplode("samples").alias("s", "amp")))


@query
def slice_stride(spark, sf_dir):
    t = files.slices(views.traces(spark, sf_dir), 5)
    tasks = F.explode(F.array(*[F.lit(x) for x in TASK_MODELS]))
    return t.select("il").distinct().select("il", tasks.alias("task"))


@query
def volume_metadata(spark, sf_dir):
    return files.volume_metadata(views.traces(spark, sf_dir))


@query
def zscore_features(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return rounded(sections.zscore(e, [f"f{i}" for i in range(64)]))


@query
def cluster_profile(spark, sf_dir):
    names = [f"f{i}" for i in range(64)]
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return rounded(ml.cluster_profile(sections.zscore(e, names), "label", names))


@query
def horizon_seed(spark, sf_dir):
    p = sections.pick_seed(_sec(spark, sf_dir), 30, 4, "peak")
    t = sections.pick_seed(_sec(spark, sf_dir), 30, 4, "trough").withColumnRenamed("seed", "trough")
    return p.join(t, ["il", "trace"])


@query
def horizon_track(spark, sf_dir):
    return rounded(sections.track_horizon(views.correlated_traces(spark, sf_dir), 30))


@query
def horizon_quality(spark, sf_dir):
    # picks: traces whose strongest sample lies in the upper half
    top = sections.pick_seed(_sec(spark, sf_dir), 32, 32, "magnitude").where("seed < 32")
    return rounded(sections.horizon_quality(top.withColumn("confidence", F.col("seed") / F.lit(64.0))))


@query
def closed_loop(spark, sf_dir):
    """Steps of one model each; the first is asked again with a lower threshold after its false positives are dropped."""
    dets, vers = _dets(spark, sf_dir), views.verifications(spark, sf_dir)
    reg = Registry()
    reg.register("boxes", lambda ins, ctx: ctx["dets"].where((F.col("class_id") == ins["class_id"]) & (F.col("confidence") >= ins["least"])).withColumns({"step": F.lit(ins["class_id"]), "least": F.lit(float(ins["least"]))}))
    steps = [Step(k, "boxes", {"class_id": k, "least": 0.3}) for k in range(4)] + [Step(9, "unknown")]

    def verify(found, n):
        gone = det.filter_false_positives(vers, found.drop("step", "least")).where("outcome = 'dropped'").select(F.col("matched").alias("det_id"))
        return Verdict(gone, 0, {"least": 0.2}) if n == 0 else None

    last = closed_loop_of(steps, reg, {"dets": dets}, verify)
    return rounded(last.groupBy("step", "least").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")))


@query
def tumbling_counts(spark, sf_dir):
    w = windows.tumbling_counts(views.table(spark, sf_dir, "events"))
    return rounded(w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), 2)


@query
def gap_sessions(spark, sf_dir):
    s = windows.gap_sessions(views.table(spark, sf_dir, "events"), gap="6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


# --- models and kernels ---------------------------------------------------

RULE_PLAN = {"rules": [{"class_name": "high", "rule": "GR>100"}, {"class_name": "pay", "rule": "RT>20", "expected_depth_ranges": [[1005, 1020], {"top_m": 1030, "bottom_m": "1040"}]}, {"class_name": "blind", "rule": "SP<1", "depth_range": [1, 2.5]}, {"class_name": "odd", "rule": "50<GR<90"}]}


@query
def latest_rounds(spark, sf_dir):
    """Days are rounds and users steps: what each user did on the last day that has any of it."""
    ev = views.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = files.latest_round(ev, "user_id", "day")
    return rounded(last.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last_event")), 2)


@query
def stream_runs(spark, sf_dir):
    """Stretches of high values of each user, from a stream of ``events`` that ends when all is taken."""
    at = os.path.join(shared_dir(spark), f"stream-runs-{uuid.uuid4().hex}")
    ev = views.stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = runs.threshold_runs(ev, F.col("value") >= 50, "user_id", "event_id", "value")
    q = found.writeStream.option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{at}/out")
    day = lambda c: F.col(c).cast("timestamp_ntz").alias(f"run_{c}")
    return rounded(out.select("user_id", day("start"), day("end"), "n", "total"), 2)


@query
def rule_model(spark, sf_dir):
    found = models.traditional_code(RULE_PLAN, {"curve": views.line_curve(spark, sf_dir)})
    return rounded(found.select("class_name", "well", "depth_top", "depth_bottom", "thickness", "confidence", "rule", "result"))


@query
def log_model(spark, sf_dir):
    found = models.well_log_analyzer({}, {"curve": views.line_curve(spark, sf_dir)})
    return rounded(found.select("well", "class_name", "depth_top", "depth_bottom", "confidence", "analysis"))


@query
def learned_model(spark, sf_dir):
    curve = views.line_curve(spark, sf_dir)
    return models.well_log_ml({"depth_range": {"top_m": 1005, "bottom_m": 1060}}, {"curve": curve}).groupBy("lithology", "fluid_type").agg(F.count("*").alias("n"))


@query
def attribute_model(spark, sf_dir):
    ins = {"attributes": ["envelope", "rms_amplitude", "unknown"], "regions_of_interest": [{"bbox_norm": [0.1, 0.2, 0.6, 0.7]}, {"bbox_norm": [0, 0, 1]}, {"bbox_xyxy_norm": [0, 0, 1, 1]}]}
    out = models.attribute_extractor(ins, {"traces": views.traces(spark, sf_dir)})
    return rounded(out.select("il", "attribute_name", "roi_index", "lo", "hi", "mean", "std"), 3)


@query
def instantaneous(spark, sf_dir):
    m = kernels.section_maps(views.traces(spark, sf_dir), ["envelope", "phase", "frequency", "sweetness"])
    return rounded(m.groupBy("il", "s").agg(F.avg("envelope").alias("envelope"), F.avg(F.cos("phase")).alias("cos_phase"), F.avg("frequency").alias("frequency"), F.avg(F.least("sweetness", F.lit(5.0))).alias("sweetness")))


@query
def fault_kernels(spark, sf_dir):
    m = kernels.section_maps(views.traces(spark, sf_dir), ["gradient_fault", "variance_fault", "structure_tensor"])
    return rounded(m.groupBy("il", "trace").agg(*[F.avg(c).alias(c) for c in ("gradient_fault", "variance_fault", "structure_tensor")]))


@query
def domain_model(spark, sf_dir):
    ins = {"attribute": "variance", "confidence_threshold": 0.6, "min_region_area_pixels": 12}
    out = models.seismic_domain_model(ins, {"traces": views.traces(spark, sf_dir)})
    return rounded(out.select("il", "class_name", "x1", "y1", "x2", "y2", "confidence", "area_pixels", "aspect_ratio"), 2)


@query
def facies_model(spark, sf_dir):
    ins = {"n_clusters": 3, "attribute_list": ["envelope", "gradient_magnitude", "local_variance"], "method": "kmeans"}
    return models.facies_classifier(ins, {"traces": views.traces(spark, sf_dir)}).select("cluster_id", "area_pixels", "dominant_feature", "n_attributes_used")


@query
def horizon_model(spark, sf_dir):
    ins = {"seed_points": [{"trace_idx": 2, "sample_idx": 30}, {"cdp": 0}], "tracking_mode": "peak", "horizon_name": "T"}
    return models.horizon_tracker(ins, {"traces": views.correlated_traces(spark, sf_dir)}).select("il", "horizon_name", "seed_trace_idx", "seed_sample_idx", "n_points", "continuity_score")


@query
def prompted_mask(spark, sf_dir):
    out = models.sam({"prompt_type": "bbox", "prompt_value": [2, 10, 12, 40], "label": "body"}, {"traces": views.traces(spark, sf_dir)})
    return rounded(out.select("il", "label", "mask_area_pixels", *[F.col("bbox_pixel")[i].alias(c) for i, c in enumerate(det.BOX)], F.col("centroid")[0].alias("cx"), F.col("centroid")[1].alias("cy")))


@query
def cube_faults(spark, sf_dir):
    out = models.cig_fault({"threshold": 0.3}, {"cube": _probability(spark, sf_dir).select("il", "trace", "s", "p")})
    return rounded(out.select("slice_index", "class_name", "area_pixels", *[F.col("bbox_pixel")[i].alias(c) for i, c in enumerate(det.BOX)], "confidence"), 2)


@query
def views_paint(spark, sf_dir):
    """Boxes on three views of a volume of 12 x 14 x 40, views named in three ways."""
    rows = [("inline", "run/inline_model.png", 3, 40, 14), ("crossline", "run/xl_model.png", 5, 40, 12), ("slice", "run/z.png", 20, 12, 14), ("local_patch", "run/p.png", 0, 9, 9)]
    known = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("view_name"), F.lit(i).alias("image"), F.lit(n).alias("index"), F.lit(h).alias("rows"), F.lit(w).alias("cols")) for v, i, n, h, w in rows])))
    names = F.array(*[F.lit(x) for x in ("inline_model", "seismic_crossline", "slice", "p", "inline", "unknown")])
    d = _dets(spark, sf_dir).select(F.element_at(names, (F.col("det_id") % 6 + 1).cast("int")).alias("image_name"), F.when(F.col("class_id") > 0, F.concat(F.lit("c"), F.col("class_id").cast("string"))).alias("class_name"), F.when(F.col("det_id") % 7 > 0, F.col("confidence")).alias("confidence"), F.when(F.col("det_id") % 11 == 0, False).alias("in_roi"), *det.BOX)
    return rounded(det.paint_views(d, known, (12, 14, 40)))


@query
def volume_slices(spark, sf_dir):
    v = views.traces(spark, sf_dir).withColumn("xl", F.col("trace"))
    one = files.inline_slice(v, 1).select(F.lit("inline").alias("kind"), F.col("xl").alias("at"), F.col("samples")[0].alias("amp"))
    two = files.crossline_slice(v, 2).select(F.lit("crossline").alias("kind"), F.col("il").cast("long").alias("at"), F.col("samples")[0].alias("amp"))
    three = files.time_slice(v, 5).groupBy("il").agg(F.max("amp").alias("amp")).select(F.lit("time").alias("kind"), F.col("il").cast("long").alias("at"), "amp")
    return rounded(one.select("kind", F.col("at").cast("long").alias("at"), "amp").unionByName(two).unionByName(three))


_ANSWERS = {
    "seismic": ['{"faults":[{"positions":[[0,1]]},{"type":"Normal fault","positions":[[155,1],[156,2]]}],"anomalies":[1],"summary":"a summary that is long enough"}', '{"faults":[{"positions":[90,7],"type":"x"}],"summary":"short"}', "{}"],
    "log": ['{"lithology_zones":[{"depth_top":1210,"lithology":"Sandstone"},{"depth_top":1320,"lithology":"shale"},{"depth_top":1990,"lithology":"sand"}],"fluid_zones":[{"depth_top":1405,"fluid_type":"gas sand"},{"depth_top":1205,"fluid_type":"gas"}],"reservoir_zones":[1],"summary":"a summary that is long enough"}', "{}", '{"reservoir_zones":[1,2,3],"summary":"a summary that is long enough"}'],
    "fusion": ['{"well_seismic_calibration":{"correlation_coefficient":0.8,"calibration_quality":"good"},"key_geological_interfaces":[1,2],"fusion_summary":"a summary that is long enough"}', '{"well_seismic_calibration":{"correlation_coefficient":1.8,"calibration_quality":"x"}}', "{}"],
    "prospect": ['{"targets":[{"risk_assessment":{"trap_risk":1,"reservoir_risk":2,"seal_risk":5,"charge_risk":3,"geological_success_probability_pct":70},"decision":{"category":"drop"}}],"overall_summary":"a summary that is long enough"}', '{"targets":[{"risk_assessment":{"trap_risk":9},"decision":"inventory"}]}', "{}"],
}


@query
def accuracy_scores(spark, sf_dir):
    r = views.table(spark, sf_dir, "region").select("r_regionkey")
    score = {"seismic": scores.seismic_score(F.col("raw"), 150.0, "normal"), "log": scores.log_score(F.col("raw"), [1200.0, 1400.0], [1300.0], [(1200.0, "oil"), (1400.0, "gas")]), "fusion": scores.fusion_score(F.col("raw")), "prospect": scores.prospect_score(F.col("raw"))}
    out = None
    for agent, raws in _ANSWERS.items():
        one = r.select("r_regionkey", F.posexplode(F.array(*[F.lit(x) for x in raws])).alias("k", "raw")).select("r_regionkey", F.lit(agent).alias("agent"), "k", score[agent]["overall"].alias("overall"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query
def plan_branches(spark, sf_dir):
    """Plans of every model with an instruction that is empty, or has only a number or a text under ``task``."""
    names = F.array(*[F.lit(m) for m in schemas.INSTRUCTIONS])
    ins = F.array(F.lit("{}"), F.lit('{"threshold":1,"task":"fracture"}'), F.lit('{"threshold":"x","n_clusters":3,"analysis_type":"full"}'))
    r = views.table(spark, sf_dir, "region").select("r_regionkey", F.explode(names).alias("model")).select("*", F.posexplode(ins).alias("k", "ins"))
    raw = F.concat(F.lit('{"scene_understanding":"x","workflow_steps":[{"step":1,"model":"'), F.col("model"), F.lit('","instruction":'), F.col("ins"), F.lit("}]}"))
    return r.select("r_regionkey", "model", "k", schemas.error_column(raw, schemas.PLAN).alias("error"))


# --- without SQL ----------------------------------------------------------


@query
def envelope(spark, sf_dir):
    e = sections.envelope(views.traces(spark, sf_dir))
    return rounded(e.select("il", "trace", F.array_max("envelope").alias("peak"), F.expr("aggregate(frequency, 0D, (a, x) -> a + x) / size(frequency)").alias("mean_frequency")))


@query
def spectral_bands(spark, sf_dir):
    b = sections.spectral_band(views.traces(spark, sf_dir), 0.0, 0.125)
    return rounded(b.select("il", "trace", F.array_max("samples").alias("peak")))


@query
def facies_cluster(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(4)])
    return ml.cluster_facies(e, [f"f{i}" for i in range(4)]).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query
def rf_lithology(spark, sf_dir):
    w = curves.sliding_features(views.line_curve(spark, sf_dir))
    cols = ["gr_mean", "gr_std", "rt_mean", "den_mean", "cnl_mean", "gr_slope", "thickness", "rt_den"]
    label = F.when(F.col("gr_mean") < 20, 0.0).when(F.col("gr_mean") < 28, 1.0).otherwise(2.0)
    data = written(w.withColumn("label", label), "lithology-windows")  # fitting reads them several times
    model = ml.train_lithology(data.where("well % 2 = 0"), cols)
    return ml.predict_lithology(model, data.where("well % 2 = 1"), cols).groupBy("label", "class_id").agg(F.count("*").alias("n"))
