"""Models of a plan, kernels of sections, schemas and painting of views."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import detections, kernels, ml, schemas, sections
from quarry.plans import models
from quarry.plans.registry import default_registry


def curve(spark, **values):
    n = len(next(iter(values.values())))
    rows = [(1, i, 1000.0 + i, *(float(v[i]) for v in values.values())) for i in range(n)]
    return spark.createDataFrame(rows, "well long, idx int, depth double, " + ", ".join(f"{k} double" for k in values))


def traces(spark, *arrays):
    """Sections from arrays of samples by traces."""
    rows = [(il, t, a[:, t].astype(float).tolist()) for il, a in enumerate(arrays) for t in range(a.shape[1])]
    return spark.createDataFrame(rows, "il int, trace int, samples array<double>")


# kernels


def test_butterworth_is_flat_and_halves_the_power_at_its_edge():
    gain = lambda ba, f: abs(np.polyval(ba[0][::-1], z := np.exp(-1j * np.pi * f)) / np.polyval(ba[1][::-1], z))
    low, high, mid = kernels.butterworth(4, None, 0.25), kernels.butterworth(4, 0.5, None), kernels.butterworth(4, 0.25, 0.5)
    assert gain(low, 0.0) == pytest.approx(1) and gain(low, 0.25) == pytest.approx(np.sqrt(0.5)) and gain(low, 0.9) < 1e-3
    assert gain(high, 1.0) == pytest.approx(1) and gain(high, 0.5) == pytest.approx(np.sqrt(0.5)) and gain(high, 0.05) < 1e-3
    assert gain(mid, 0.25) == pytest.approx(np.sqrt(0.5)) and gain(mid, 0.5) == pytest.approx(np.sqrt(0.5)) and gain(mid, 0.36) == pytest.approx(1, abs=1e-2)


def test_band_keeps_its_phase():
    t = np.arange(400.0)[:, None]
    slow, fast = np.sin(2 * np.pi * t / 50), np.sin(2 * np.pi * t / 4)
    assert np.allclose(kernels.band(slow + fast, 0.0, 0.08)[40:-40], slow[40:-40], atol=0.02)
    assert np.allclose(kernels.band(slow + fast, 0.15, 0.5)[40:-40], fast[40:-40], atol=0.02)
    with pytest.raises(ValueError):
        kernels.band(slow[:9], 0.0, 0.1)


def direct(x, f, half_before, half_after):
    """Values of ``f`` over each square around a sample, edges reflected."""
    wide = np.pad(x, ((half_before, half_after), (half_before, half_after)), mode="symmetric")
    n = half_before + half_after + 1
    return np.array([[f(wide[i : i + n, j : j + n]) for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_kernels_against_direct_sums():
    x = np.random.default_rng(3).normal(size=(31, 27))
    k = np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    assert np.allclose(kernels.sobel(x, 0), direct(x, lambda p: (p * k).sum(), 1, 1))
    assert np.allclose(kernels.sobel(x, 1), direct(x, lambda p: (p * k.T).sum(), 1, 1))
    assert np.allclose(kernels.variance(x, 9), direct(x, np.var, 4, 4))
    w = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    w = np.outer(w, w) / w.sum() ** 2
    smooth = direct(x, lambda p: (p * w).sum(), 6, 6)
    assert np.allclose(kernels.gaussian(x, 1.5), smooth)
    want = np.zeros(x.shape)
    for i in range(5, 26):
        for j in range(5, 22):
            p = smooth[i - 5 : i + 5, j - 5 : j + 5]
            h = np.histogram(p, 8, (p.min(), p.max()))[0] / (100 + 1e-8)
            want[i, j] = -(h * np.log(h + 1e-8)).sum()
    assert np.allclose(kernels.entropy(x), want, atol=1e-6)
    assert kernels.entropy(x[:9]).max() == 0 and kernels.unit(np.zeros((2, 2))).max() == 0


def test_fault_attributes_mark_a_step():
    x = np.tile(np.sin(np.arange(60) / 3.0)[:, None], (1, 40))
    x[:, 20:] = np.roll(x[:, 20:], 5, axis=0)
    assert np.abs(kernels.coherence(x)[10:50, 15:25].min(axis=0)).argmin() in (4, 5)
    assert (kernels.structure_tensor(x) <= 1).all() and (kernels.gradient_fault(x) <= 1).all()
    xs = np.random.default_rng(0).normal(size=(20, 20))
    gx, gy = kernels.sobel(xs, 1), kernels.sobel(xs, 0)
    tensor = np.array([[kernels.gaussian(a, 2.0) for a in r] for r in ((gx * gx, gx * gy), (gx * gy, gy * gy))])
    gap = np.array([[np.ptp(np.linalg.eigvalsh(tensor[:, :, i, j])) for j in range(20)] for i in range(20)])
    assert np.allclose(kernels.structure_tensor(xs), 1 - gap / (gap.max() + 1e-8))


def test_maps_of_a_box(spark):
    x = np.random.default_rng(5).normal(size=(40, 12))
    got = kernels.section_maps(traces(spark, x), ["envelope", "local_variance", "dip"], [0.25, 0.5, 0.7, 1.0]).orderBy("trace", "s").toPandas()
    sub = x[20:40, 3:9]
    assert sorted(set(got["trace"])) == list(range(3, 9)) and got["s"].min() == 20
    for name in ("envelope", "local_variance", "dip"):
        assert np.allclose(got[name].to_numpy().reshape(6, 20).T, kernels.MAPS[name](sub))


@pytest.mark.parametrize(("cols", "roi"), [(40, None), (8, None), (40, [0.1, 0.2, 0.9, 1.0])])
def test_maps_do_not_depend_on_tiles(spark, cols, roi):
    """Tiles of seven traces give what the whole section gives, with maxima and limits of the section."""
    x = np.random.default_rng(6).normal(size=(48, cols))
    x1, y1, x2, y2 = kernels.box_of(roi, *x.shape)
    lim = np.percentile(np.abs(x), 99)
    for clip in (False, True):
        sub = (np.clip(x / lim, -1, 1) if clip else x)[y1 : y2 + 1, x1 : x2 + 1]
        names = list(kernels.MAPS)
        got = kernels.section_maps(traces(spark, x), names, roi, {"low": (0.0, 0.2)}, clip=clip, tile=7).orderBy("trace", "s").toPandas()
        assert len(got) == sub.size and sorted(set(got["trace"])) == list(range(x1, x2 + 1))
        for name in names:
            assert np.allclose(got[name].to_numpy().reshape(sub.T.shape).T, kernels.MAPS[name](sub)), name
        assert np.allclose(got["low"].to_numpy().reshape(sub.T.shape).T, kernels.band(sub, 0.0, 0.2))


# models


def test_rule_model(spark):
    gr = [95.0] * 40
    gr[5:15], gr[25:30] = [30.0] * 10, [20.0] * 5
    ctx = {"curve": curve(spark, gr=gr)}
    rows = models.traditional_code({"rules": [{"class_name": "sand", "rule": "GR<50"}, {"class_name": "part", "rule": "GR<50", "expected_depth_ranges": [{"top_m": 1005, "bottom_m": 1009}]}, {"class_name": "blind", "rule": "SP>1", "depth_range": [1, 2]}, {"class_name": "none", "rule": "odd"}, "loose"]}, ctx).collect()
    by = {}
    for r in rows:
        by.setdefault(r.class_name, []).append((r.depth_top, r.depth_bottom, r.confidence, r.result))
    assert by == {"sand": [(1005.0, 1014.0, 0.9, None), (1025.0, 1029.0, 0.9, None)], "part": [(1005.0, 1009.0, 0.95, None)], "blind": [(1.0, 2.0, 0.7, None)], "none": [(None, None, None, "no curve data or depth range provided")], "loose": [(None, None, None, None)]}
    assert models.traditional_code({"class_name": "x"}, ctx).first().result == "no rules specified"
    assert models.traditional_code({"rule": "GR > 90", "class_name": "shale"}, ctx).count() == 3


def test_log_analyzer(spark):
    gr, rt = [30.0] * 30 + [110.0] * 30, [3.0] * 30 + [60.0] * 20 + [3.0] * 10
    ctx = {"curve": curve(spark, gr=gr, rt=rt, den=[2.3] * 60)}
    found = models.well_log_analyzer({}, ctx).collect()
    assert {r.class_name for r in found if r.analysis == "curve_segmentation"} == {"clean_sandstone", "sandy_shale"}
    (zone,) = [r for r in found if r.analysis == "fluid_identification"]
    assert (zone.fluid_type, zone.depth_top, zone.depth_bottom, zone.cnl_mean) == ("gas", 1030.0, 1049.0, 0.2)
    assert models.well_log_analyzer({"analysis_type": "fluid_identification"}, ctx).count() == 1
    rules = {"rules": [{"class_name": "z", "rule": "r", "depth_range": [1, 2]}]}
    assert [r.confidence for r in models.well_log_analyzer(rules | {"analysis_type": "curve_segmentation"}, {"curve": ctx["curve"].drop("gr")}).collect()] == [0.75]
    assert [r.confidence for r in models.well_log_analyzer(rules | {"analysis_type": "fluid_identification"}, {"curve": ctx["curve"].drop("rt")}).collect()] == [0.65]


def test_rf_lithology_fits_the_whole_forest(spark, monkeypatch):
    """The query's forest has the trees and the depth of the surveyed system, and every window of the odd wells is judged by it."""
    from quarry.operators import curves
    from quarry.plans.queries import rf_lithology
    from quarry.sources import views

    made, train = [], ml.train_lithology
    monkeypatch.setattr(ml, "train_lithology", lambda *a, **k: made.append(train(*a, **k)) or made[-1])
    sf = "/root/testdata/sf0.001"
    judged = sum(r.n for r in rf_lithology(spark, sf).collect())
    (forest,) = made
    assert forest.getNumTrees == 100 and forest.getMaxDepth() == 10
    assert judged == curves.sliding_features(views.line_curve(spark, sf)).where("well % 2 = 1").count()


def test_learned_lithology(spark, tmp_path):
    model = ml.LithologyModel.train(ml.training_samples(spark, 200), trees=30)
    fresh = ml.training_samples(spark, 100, seed=7)
    names = [c[0] for c in ml.LITHOLOGY_CLASSES]
    got = model.predict(fresh).collect()
    assert sum(r.lithology == names[int(r.label)] for r in got) > 0.9 * len(got) == 540
    model.save(f"{tmp_path}/m")
    assert ml.LithologyModel.load(f"{tmp_path}/m").predict(fresh).select("lithology").collect() == model.predict(fresh).select("lithology").collect()
    ctx = {"curve": curve(spark, gr=[30.0] * 60 + [110.0] * 60, rt=[60.0] * 60 + [4.0] * 60, den=[2.3] * 60 + [2.58] * 60, cnl=[0.15] * 60 + [0.28] * 60)}
    zones = models.well_log_ml({}, ctx, model).orderBy("depth_top").collect()
    assert zones[0].lithology == "clean_sandstone" and zones[0].fluid_type == "gas" and zones[-1].lithology == "shale" and zones[-1].fluid_type is None
    assert models.well_log_ml({"analysis_type": "lithology", "depth_range": {"top_m": 1090}}, ctx, model).where("fluid_type IS NOT NULL OR depth_bottom < 1090").count() == 0
    assert models.well_log_ml({}, {}).first().result == "need curves in context"


def test_attribute_model(spark):
    x = np.random.default_rng(7).normal(size=(64, 20))
    ctx = {"traces": traces(spark, x)}
    got = {(r.attribute_name, r.roi_index): r for r in models.attribute_extractor({"attributes": ["envelope", "rms_amplitude", "nothing", "glcm", "spectral"], "regions_of_interest": [{"bbox_norm": [0, 0, 0.5, 0.99]}, {}]}, ctx).collect()}
    assert len(got) == 9 and {k for _, k in got} == {0}
    env = kernels.MAPS["envelope"](x[:64, :11])
    r = got["envelope", 0]
    assert (r.lo, r.hi, r.mean, r.std) == pytest.approx((env.min(), env.max(), env.mean(), env.std()), abs=1e-4)
    assert models.attribute_extractor({"attributes": ["nothing"]}, ctx) is None
    assert {r.roi_index for r in models.attribute_extractor({"attributes": ["phase"]}, ctx).collect()} == {None}


def test_facies_model(spark):
    x = np.random.default_rng(8).normal(size=(40, 30)) * np.where(np.arange(30) < 15, 0.1, 3.0)
    got = models.facies_classifier({"n_clusters": 2, "attribute_list": ["envelope", "local_variance"], "method": "kmeans"}, {"traces": traces(spark, x)}).collect()
    assert sum(r.area_pixels for r in got) == 1200 and all(len(r.centroid_xy) == 2 and r.n_attributes_used == 2 and r.dominant_feature in ("envelope", "local_variance") for r in got)
    assert models.facies_classifier({"n_clusters": 200}, {"traces": traces(spark, x)}) is None
    assert sum(r.area_pixels for r in models.facies_classifier({"n_clusters": 2, "regions_of_interest": [{"bbox_norm": [0, 0, 0.4, 0.9]}]}, {"traces": traces(spark, x)}).collect()) == 13 * 37


def test_horizon_model(spark):
    s = np.arange(120)
    x = np.stack([np.exp(-((s - 50 - t) ** 2) / 8.0) for t in range(12)], axis=1)
    ctx = {"traces": traces(spark, x)}
    got = models.horizon_tracker({"seed_points": [{"trace_idx": 5, "sample_idx": 57}, {"cdp": 3, "time_ms": 212.0}], "tracking_mode": "peak"}, ctx | {"time_axis_ms": [4.0 * k for k in range(120)]}).orderBy("id").collect()
    assert [r.seed_sample_idx for r in got] == [55, 53] and all([p.sample_idx for p in r.points] == [50 + t for t in range(12)] for r in got)
    assert all(r.continuity_score == 1.0 and r.n_points == 12 for r in got)
    assert models.horizon_tracker({}, ctx) is None
    wave = np.sin(np.arange(50) / 4.0)
    assert wave[sections.snap(wave, 12, "zero_crossing_pos2neg")] >= 0 > wave[sections.snap(wave, 12, "zero_crossing_pos2neg") + 1]
    sec = traces(spark, wave[:, None]).select("il", "trace", F.posexplode("samples").alias("s", "amp"))
    for mode in ("zero_crossing_pos2neg", "zero_crossing_neg2pos", "zero_crossing", "peak", "trough"):
        assert sections.pick_seed(sec, 12, 4, mode).first().seed == sections.snap(wave, 12, mode), mode


def test_flat_seed_and_weak_neighbour_end_a_horizon():
    wave = np.zeros((6, 80))
    wave[:, 40] = [1, 1, 0, 1, 1, 1]  # the flat trace is skipped
    wave[5] = np.random.default_rng(0).normal(size=80)
    got = sections.follow(wave, 1, 40, 25, 10, 0.4)
    assert [t for t, *_ in got] in ([0, 1, 3, 4], [0, 1, 3, 4, 5]) and sections.follow(np.zeros((3, 80)), 0, 40, 25, 10, 0.4) == [(0, 40, 0.0)]


def test_domain_model(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 60)) * 0.05
    x[:, 28:32] += np.sin(np.arange(80))[:, None] * 3
    ctx = {"traces": traces(spark, x)}
    for attribute in ("gradient", "variance", "coherence", "structure_tensor", "both"):
        got = models.seismic_domain_model({"attribute": attribute, "confidence_threshold": 90, "min_region_area_pixels": 20}, ctx).collect()
        assert all(r.class_name == "fault" and r.area_pixels >= 20 and r.attribute == attribute for r in got)
    assert models.seismic_domain_model({"attribute": "variance", "confidence_threshold": 0.3}, ctx).count() == 1
    assert models.seismic_domain_model({"attribute": "unknown"}, ctx) is None
    inside = models.seismic_domain_model({"attribute": "variance", "task": "fracture", "regions_of_interest": [{"bbox_norm": [0.3, 0, 0.7, 1]}, {"bbox_norm": [0, 0, 0.01, 1]}]}, ctx).collect()
    assert inside and all(r.class_name == "fracture" and r.x1 >= 18 for r in inside)


def test_prompted_masks_and_cubes(spark):
    x = np.zeros((30, 20))
    x[10:20, 5:10] = 1.0
    ctx = {"traces": traces(spark, x)}
    box = models.sam({"prompt_value": [0, 0, 19, 29], "label": "L"}, ctx).first()
    assert (box.mask_area_pixels, box.bbox_pixel, box.centroid) == (50, [5.0, 10.0, 9.0, 19.0], [7.0, 14.5])
    assert models.sam({"prompt_type": "point", "prompt_value": [6, 12]}, ctx).first().mask_area_pixels == 50
    assert models.sam({"prompt_type": "bbox", "prompt_value": [1]}, ctx).first().mask_area_pixels == 0
    cube = spark.createDataFrame([(il, t, s, 0.9 if il == 1 and 2 <= t < 8 and 3 <= s < 9 else 0.1) for il in range(2) for t in range(10) for s in range(10)], "il int, trace int, s int, p double")
    (fault,) = models.cig_fault({}, {"cube": cube}).collect()
    assert (fault.slice_index, fault.area_pixels, fault.bbox_pixel, fault.confidence) == (1, 36, [2.0, 3.0, 7.0, 8.0], 0.9)
    assert models.cig_channel({}, {"cube": cube}).count() == 0 and models.cig_channel({"accumulate": "max"}, {"cube": cube}).count() == 1
    assert default_registry().names() == sorted("traditional_code well_log_analyzer well_log_ml attribute_extractor facies_classifier horizon_tracker seismic_domain_model sam cig_fault cig_channel".split())


# painting


def test_three_views_and_their_names(spark):
    views = spark.createDataFrame([("inline", "a/inline_model.png", 2, 20, 10), ("crossline", "b/x.png", 3, 20, 8), ("slice", "c/z.png", 5, 8, 10), ("local_patch", "d/p.png", 0, 5, 5), ("slice", "e/far.png", 99, 8, 10)], "view_name string, image string, index int, rows int, cols int")
    rows = [("inline_model", "f", 0.5, None, 0.0, 0.0, 0.35, 0.2), ("seismic_inline", "f", 0.9, True, 0.3, 0.2, 0.3, 0.2), ("crossline", "g", 0.4, True, 0.0, 0.0, 0.3, 0.1), ("z", None, None, None, 0.1, 0.5, 0.2, 0.9), ("p", "f", 1.0, None, 0, 0, 1, 1), ("far", "f", 1.0, None, 0, 0, 1, 1), ("inline", "h", 0.7, False, 0, 0, 1, 1)]
    dets = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows], "image_name string, class_name string, confidence double, in_roi boolean, x1 double, y1 double, x2 double, y2 double")
    got = {(r.class_name, r.il, r.xl, r.s): r.confidence for r in detections.paint_views(dets, views, (8, 10, 20)).collect()}
    want = {("f", 2, x, s): 0.5 for x in range(0, 4) for s in range(0, 5)} | {("f", 2, 3, 4): 0.9} | {("g", i, 3, s): 0.4 for i in range(0, 3) for s in range(0, 3)} | {("unknown", i, x, 5): 1.0 for i in range(4, 8) for x in (1, 2)}
    assert got == want


def test_only_pixel_boxes_go_to_data(spark):
    d = spark.createDataFrame([(1, "pixel", [100.0, 50.0, 0.0, 0.0]), (2, "data", [1.0, 1.0, 1.0, 1.0]), (3, "pixel", None)], "det_id int, coordinate_system string, bbox_pixel array<double>")
    (r,) = detections.to_data(d, 100, 100, (0.0, 300.0), (0.0, 2500.0)).collect()
    assert (r.x_min, r.x_max, r.y_min, r.y_max) == (0.0, 300.0, 0.0, 1250.0)


# schemas

GOOD = {"scene_understanding": "x", "workflow_steps": [{"step": 1, "model": "traditional_code", "instruction": {"rules": [{"class_name": "a", "rule": "GR<5"}]}}]}


def step(model, instruction):
    return {"scene_understanding": "x", "workflow_steps": [{"step": 1, "model": model, "instruction": instruction}]}


@pytest.mark.parametrize(
    ("name", "value", "error"),
    [
        ("workflow_plan", GOOD, None),
        ("workflow_plan", step("traditional_code", {}), "workflow_steps/0/instruction: 'rules' is a required property"),
        ("workflow_plan", step("traditional_code", {"rules": []}), "workflow_steps/0/instruction/rules: [] should be non-empty"),
        ("workflow_plan", step("sam", {"prompt_type": "bbox", "label": "x"}), "workflow_steps/0/instruction: 'prompt_value' is a required property"),
        ("workflow_plan", step("seismic_domain_model", {"task": "x"}), "workflow_steps/0/instruction/task: 'x' is not one of ['fault_detection', 'facies_classification', 'fracture']"),
        ("workflow_plan", step("attribute_extractor", {"attributes": [1]}), "workflow_steps/0/instruction/attributes/0: 1 is not of type 'string'"),
        ("workflow_plan", step("horizon_tracker", {"seed_points": [1], "tracking_mode": "peak", "search_window_samples": 0}), "workflow_steps/0/instruction/search_window_samples: 0 is less than the minimum of 1"),
        ("workflow_plan", step("facies_classifier", {"n_clusters": 21}), "workflow_steps/0/instruction/n_clusters: 21 is greater than the maximum of 20"),
        ("workflow_plan", step("well_log_analyzer", {}), "workflow_steps/0/instruction: 'analysis_type' is a required property"),
        ("workflow_plan", step("seismic_foundation", {}), "workflow_steps/0/instruction: 'task' is a required property"),
        ("workflow_plan", step("cig_fault", {"threshold": "x"}), "workflow_steps/0/instruction/threshold: 'x' is not of type 'number'"),
        ("workflow_plan", step("cig_channel", {"scales": 1}), "workflow_steps/0/instruction/scales: 1 is not of type 'array'"),
        ("workflow_plan", step("well_log_ml", {"analysis_type": "all"}), "workflow_steps/0/instruction/analysis_type: 'all' is not one of ['lithology', 'fluid', 'full']"),
        ("workflow_plan", {"workflow_steps": []}, "<root>: 'scene_understanding' is a required property"),
        ("workflow_verification", {"verified": [{"is_real": True, "confidence": 1.5}], "need_retry": False}, "verified/0/confidence: 1.5 is greater than the maximum of 1.0"),
        ("workflow_verification", {"verified": [{"is_real": True, "rejection_reason": None}], "need_retry": True, "retry_instructions": None}, None),
        ("log_analysis", {"lithology_zones": [{"id": "x", "depth_top": 1, "depth_bottom": 2, "lithology": "shale", "confidence": 1}], "reservoir_zones": [], "fluid_zones": [], "summary": ""}, "lithology_zones/0/id: 'x' does not match '^L\\\\d+$'"),
        ("seismic_interp", {"faults": [{"id": "F1", "type": "normal", "positions": [[1, 2]], "confidence": 0.5}], "horizons": [], "seismic_facies": [], "summary": 1}, "faults/0/positions: [[1, 2]] is too short"),
        ("prospect_evaluation", {"targets": [], "risk_summary": {"total_prospects": True}, "overall_summary": ""}, "risk_summary/total_prospects: True is not of type 'integer'"),
        ("well_seismic_fusion", [], "<root>: [] is not of type 'object'"),
    ],
)
def test_first_errors(name, value, error):
    assert schemas.first_error(schemas.SCHEMAS[name], value) == error


def test_error_column(spark):
    raws = [json.dumps(GOOD), "{}", "no", None]
    got = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", schemas.error_column(F.col("raw"), schemas.PLAN).alias("e")).orderBy("k").collect()
    assert [r.e for r in got] == [None, "<root>: 'scene_understanding' is a required property", "<root>: not JSON", "<root>: not JSON"]


def test_a_rejected_answer_is_asked_for_once_more():
    asked = []

    def ask(answers):
        def one(prompt, temperature):
            asked.append((prompt, temperature))
            return answers.pop(0)

        return one

    first = schemas.ask_json(ask(["so: {\"a\": 1}", json.dumps(GOOD)]), "p", schemas.PLAN, 0.7)
    assert first.valid and first.attempts == 2 and asked[0] == ("p", 0.7) and asked[1][1] == 0.0 and "scene_understanding" in asked[1][0]
    again = schemas.ask_json(ask(['{"a": 1}', '{"b": 2}']), "p", schemas.PLAN)
    assert not again.valid and again.data == {"b": 2} and again.attempts == 2 and again.errors
    assert schemas.ask_json(ask(["none"]), "p").data is None and schemas.ask_json(ask(['{"a": 1}']), "p").valid
    assert schemas.ask_json(ask(['{"a": 1}', "none"]), "p", schemas.PLAN).data is None


def test_skeleton_shows_the_shape():
    got = schemas.skeleton(schemas.VERIFICATION)
    assert got["verified"][0]["is_real"] == "boolean" and got["need_retry"] == "boolean" and got["retry_instructions"] == {}
    assert schemas.skeleton(schemas.PROSPECT)["targets"][0]["decision"] == "..."
