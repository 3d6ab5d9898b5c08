"""Operators on small hand-checked frames."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.operators import curves, documents, retrieval, sections
from quarry.operators import detections as det
from quarry.plans.loop import Step, Verdict, apply_retry, closed_loop
from quarry.plans.registry import Registry, default_registry
from quarry.sources import files, segy
from quarry.streaming import windows


def curve(spark, values, **more):
    rows = [(1, i, 1000.0 + i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "well long, idx int, depth double, gr double").withColumns({k: F.lit(v) for k, v in more.items()})


def test_step_curve_has_its_two_islands(spark):
    values = [95.0] * 2000
    values[400:510], values[1100:1250] = [35.0] * 110, [38.0] * 150
    got = curves.threshold_segments(curve(spark, values), "gr", "<", 50.0).orderBy("depth_top").collect()
    assert [(r.depth_top, r.depth_bottom, r.n, r.mean_value) for r in got] == [(1400.0, 1509.0, 110, 35.0), (2100.0, 2249.0, 150, 38.0)]
    windowed = curves.threshold_segments(curve(spark, values), "gr", "<", 50.0, top=1400.0, bottom=1402.0).collect()
    assert [r.n for r in windowed] == [3]
    assert curves.threshold_segments(curve(spark, [1, 99, 1, 1, 99]), "gr", "<", 50.0).count() == 0


def test_crossing_intervals_stay_open_to_the_end(spark):
    got = curves.crossing_intervals(curve(spark, [90] * 5 + [10] * 20 + [90] * 5 + [10] * 15), "gr", 50.0).orderBy("depth_top").collect()
    assert [(r.depth_top, r.depth_bottom) for r in got] == [(1005.0, 1025.0), (1030.0, 1044.0)]


def test_gradient_matches_numpy(spark):
    values = np.random.default_rng(0).normal(size=40)
    got = curves.gradient_z(curve(spark, values), "gr").orderBy("idx").toPandas()
    g = np.abs(np.gradient(values))
    assert np.allclose(got["g"], g) and np.allclose(got["z"], (g - g.mean()) / (g.std() + 1e-8))


def test_flat_curve_is_one_segment(spark):
    got = curves.change_point_segments(curve(spark, [5.0] * 30), "gr").collect()
    assert [(r.start_idx, r.end_idx) for r in got] == [(0, 30)]


def test_fold_averages_pair_by_pair(spark):
    rows = [(1, 0.0, 10.0, "a", 1.0), (1, 12.0, 20.0, "a", 3.0), (1, 21.0, 30.0, "a", 8.0), (1, 36.0, 40.0, "a", 2.0), (1, 41.0, 42.0, "b", 2.0)]
    seg = spark.createDataFrame(rows, "well long, depth_top double, depth_bottom double, lithology string, mean_value double")
    got = curves.merge_fold(seg, 5.0).orderBy("depth_top").collect()
    assert [(r.depth_top, r.depth_bottom, r.mean_value) for r in got] == [(0.0, 30.0, 5.0), (36.0, 40.0, 2.0), (41.0, 42.0, 2.0)]


def test_short_curve_has_no_window(spark):
    c = curve(spark, range(20), rt=3.0, den=2.5, cnl=0.2)
    assert curves.sliding_features(c).count() == 0
    c = curve(spark, range(41), rt=3.0, den=2.5, cnl=0.2)
    assert sorted(r.start_idx for r in curves.sliding_features(c).collect()) == [0, 10, 20]


@pytest.mark.parametrize(("rule", "want"), [("GR<50", ("GR", "<", 50.0)), ("RT >= 2.5", ("RT", ">=", 2.5)), ("50<GR<120", None), ("GR<-5", None)])
def test_rules(spark, rule, want):
    r = spark.range(1).select(rules.parse_rule(F.lit(rule)).alias("p")).first().p
    assert (tuple(r) if r else None) == want


BOXES = "det_id long, image int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_suppression_keeps_first_and_far(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, 0.4, 1.0, 1.0, 11.0, 11.0), (3, 0, 0, 0.7, 50.0, 50.0, 60.0, 60.0)], BOXES)
    for f in (det.nms_greedy, det.nms_all):
        assert {r.det_id for r in f(d, 0.5).collect()} == {1, 3}


def test_greedy_and_strict_suppression_differ(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 1.0), (2, 0, 0, 0.8, 4.0, 0.0, 14.0, 1.0), (3, 0, 0, 0.7, 8.0, 0.0, 18.0, 1.0)], BOXES)
    assert {r.det_id for r in det.nms_greedy(d, 0.3).collect()} == {1, 3}
    assert {r.det_id for r in det.nms_all(d, 0.3).collect()} == {1}
    again = det.nms_greedy(d, 0.3).join(d.drop("image", "class_id", "confidence"), "det_id")
    assert det.nms_greedy(again, 0.3).count() == 2


def test_false_positive_outcomes(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (2, 0, 0, 0.9, 5.0, 5.0, 6.0, 6.0)], BOXES)
    v = [(1, 1, False, 0.9, 0.0), (2, 1, False, 0.9, 0.0), (3, None, False, 0.2, 5.0), (4, None, False, None, 5.0), (5, None, False, 0.9, 90.0), (6, 2, True, 0.9, 5.0)]
    vers = spark.createDataFrame([(i, r, 0, 0, x, x, x + 1, x + 1, ok, c) for i, r, ok, c, x in v], "ver_id long, result_id long, image int, class_id int, x1 double, y1 double, x2 double, y2 double, is_real boolean, confidence double")
    o = det.filter_false_positives(vers, d)
    assert {r.ver_id: r.outcome for r in o.collect()} == {1: "dropped", 2: "duplicate", 3: "low_confidence", 4: "no_confidence", 5: "unmatched"}
    assert {r.det_id for r in det.surviving(d, o).collect()} == {2}


def test_painting_takes_the_highest(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.3, 0.0, 0.0, 0.5, 0.5), (2, 0, 0, 0.8, 0.4, 0.4, 2.0, 2.0)], BOXES).withColumn("in_roi", F.lit(None).cast("boolean"))
    got = {(r.x, r.y): r.confidence for r in det.paint_volume(d, 10, 10).collect()}
    assert got[0, 0] == 0.3 and got[5, 5] == 0.8 and got[9, 9] == 0.8 and (9, 0) not in got


def test_moving_rms_reflects_edges(spark):
    x = np.random.default_rng(1).normal(size=12)
    sec = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(x)], "il int, trace int, s int, amp double")
    got = [r.rms for r in sections.moving_rms(sec, 12, 5).orderBy("s").collect()]
    wide = np.concatenate([x[:2][::-1], x, x[-2:][::-1]])
    assert np.allclose(got, [np.sqrt((wide[i : i + 5] ** 2).mean()) for i in range(12)])


def test_regions(spark):
    art = ["##..#", "#...#", "..#.#"]
    cells = [(0, t, s, 1.0) for t, row in enumerate(art) for s, c in enumerate(row) if c == "#"]
    got = sections.label_regions(spark.createDataFrame(cells, "il int, trace int, s int, p double")).groupBy("region").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3, 3]


def test_horizon_follows_a_dip(spark):
    s = np.arange(100)
    rows = [(0, t, np.exp(-((s - 40 - t) ** 2) / 4.0).tolist()) for t in range(10)]
    got = sections.track_horizon(spark.createDataFrame(rows, "il int, trace int, samples array<double>"), 40).orderBy("trace").collect()
    assert [r.s for r in got] == [40 + t for t in range(10)]


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('x {} y {"b": "}{"} z', '{"b": "}{"}'), ("no json", None), ('{"a": {"b": 1', None), ('{bad} {"c": [1]}', '{"c": [1]}'), (None, None)])
def test_first_json(text, want):
    assert documents.first_json(text) == want


def test_tokens(spark):
    got = spark.range(1).select(retrieval.tokens(F.lit("The GR of 断层 is 2.35, a Log_x 7")).alias("t")).first().t
    assert got == ["gr", "断层", "2.35", "log_x"]


def test_retry_merges_and_loop_converges(spark):
    steps = [Step(1, "m", {"x": 1}), Step(2, "n", {"y": 1}), Step(3, "gone")]
    assert apply_retry(steps, 9, {"a": 1}) is None and apply_retry(steps, 2, {}) is None
    reg = Registry()
    reg.register("m", lambda i, c: spark.createDataFrame([("a1",), ("b1",)], "det_id string"))
    reg.register("n", lambda i, c: spark.createDataFrame([("b2" if i["y"] == 2 else "bad",)], "det_id string"))

    def verify(dets, n):
        return Verdict(spark.createDataFrame([("b1",)], "det_id string"), 2, {"y": 2}) if n == 0 else None

    assert {r.det_id for r in closed_loop(steps, reg, {}, verify).collect()} == {"a1", "b2"}
    assert closed_loop([Step(1, "none")], reg, {}, verify) is None
    assert "traditional_code" in default_registry().names()


def test_segy_round_trip(spark, tmp_path):
    lines = [(il, xl, [float(np.sin(il + xl + k)) * 10 for k in range(25)]) for il in (100, 101) for xl in (200, 201, 202)]
    path = str(tmp_path / "v.sgy")
    segy.write_segy(path, lines)
    spark.dataSource.register(segy.SegyDataSource)
    got = spark.read.format("segy").option("tracesPerPartition", 2).load(path).orderBy("il", "xl").collect()
    assert [(r.il, r.xl, r.interval_ms) for r in got] == [(a, b, 4.0) for a, b, _ in lines]
    assert all(np.allclose(r.samples, s, atol=1e-3) for r, (_, _, s) in zip(got, lines, strict=True))
    with pytest.raises(ValueError):
        segy.write_segy(path, [*lines, (1, 1, [0.0])])


def test_segy_sink_copies_headers_and_checks_the_shape(spark, tmp_path):
    lines = [(il, xl, [float(il + xl + k) for k in range(12)]) for il in (100, 101) for xl in (200, 201)]
    segy.write_segy(str(tmp_path / "ref.sgy"), lines, 2000)
    spark.dataSource.register(segy.SegyDataSource)
    volume = spark.read.format("segy").load(str(tmp_path / "ref.sgy"))
    doubled = volume.withColumn("samples", F.transform("samples", lambda x: x * 2))
    segy.write_attribute(doubled, str(tmp_path / "out"), str(tmp_path / "ref.sgy"))
    got = spark.read.format("segy").load(str(tmp_path / "out")).orderBy("il", "xl").collect()
    assert [(r.il, r.xl, r.interval_ms) for r in got] == [(a, b, 2.0) for a, b, _ in lines]
    assert all(np.allclose(r.samples, np.array(s) * 2, rtol=1e-5) for r, (_, _, s) in zip(got, lines, strict=True))
    for wrong in (doubled.where("xl = 200"), doubled.withColumn("samples", F.slice("samples", 1, 5))):
        with pytest.raises(Exception, match="traces, where|samples, not"):
            segy.write_attribute(wrong, str(tmp_path / "bad"), str(tmp_path / "ref.sgy"))
        assert not list((tmp_path / "bad").glob("*.sgy"))
    segy.write_attribute(doubled, str(tmp_path / "plain"), interval_ms=8.0)
    assert {r.interval_ms for r in spark.read.format("segy").load(str(tmp_path / "plain")).collect()} == {8.0}


def png(rows):
    """A grey picture as PNG bytes."""
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b"")


def test_run_directory(spark, tmp_path):
    run = tmp_path / "run"
    for rel in ("prompts", "schemas", "d"):
        (run / rel).mkdir(parents=True)
    with pytest.raises(FileNotFoundError, match="run dir not found"):
        files.load_run(spark, str(tmp_path / "gone"))
    (run / "manifest.json").write_text('{"sample_id": "s"}')
    image = lambda p, **more: {"type": "image", "path": p} | more
    messages = [{"role": "system", "content": [image("d/v1.png")]}, {"role": "user", "content": [image("d/v1.png", physical_view="inline"), image("d/v2.png", name="second"), image("d/gone.png"), {"type": "text", "text": "t"}]}]
    (run / "request.json").write_text(json.dumps({"messages": messages}))
    (run / "prompts/system_prompt.txt").write_text("sys")
    (run / "prompts/user_prompt.txt").write_text("user")
    with pytest.raises(FileNotFoundError, match="schemas/expected_model_output.schema.json"):
        files.load_run(spark, str(run))
    (run / "schemas/expected_model_output.schema.json").write_text("{}")
    (run / "d/v1.png").write_bytes(png([[0, 128, 255], [255, 0, 51]]))
    (run / "d/v2.png").write_bytes(b"no picture")
    got = files.load_run(spark, str(run))
    assert sorted(tuple(r) for r in got["images"].collect()) == [("second", "d/v2.png", "unknown"), ("v1", "d/v1.png", "inline")]
    assert got["system_prompt"].first().raw == "sys" and json.loads(got["manifest"].first().raw) == {"sample_id": "s"}
    (picture,) = files.read_images(spark, str(run / "d")).collect()
    assert (picture.height, picture.width) == (2, 3) and np.allclose(picture.gray, [0, 128 / 255, 1, 1, 0, 0.2])
    sec = {(r.trace, r.s): r.amp for r in files.image_sections(files.read_images(spark, str(run / "d"))).collect()}
    assert sec[2, 1] == pytest.approx(0.2) and len(sec) == 6


def test_arrays_and_slices(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(24.0).reshape(2, 3, 4))
    np.save(tmp_path / "s.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "flat.npy", np.arange(3.0))
    (tmp_path / "bad.npy").write_bytes(b"x")
    rows = files.read_npy(spark, str(tmp_path / "*.npy")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.il, r.trace): r.samples for r in rows} == {("v.npy", i, j): [12.0 * i + 4 * j + k for k in range(4)] for i in range(2) for j in range(3)} | {("s.npy", 0, j): [j, j + 3.0] for j in range(3)}
    volume = spark.createDataFrame([(100 + 2 * i, 200 + 5 * j, [10.0 * i + j, 1.0]) for i in range(2) for j in range(3)], "il int, xl int, samples array<double>")
    assert sorted(r.xl for r in files.inline_slice(volume, 1).collect()) == [200, 205, 210] and files.inline_slice(volume, 2).count() == 0
    assert sorted((r.il, r.samples[0]) for r in files.crossline_slice(volume, 2).collect()) == [(100, 2.0), (102, 12.0)]
    assert sorted(r.amp for r in files.time_slice(volume, 0).collect()) == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0]
    assert files.as_volume(volume.drop("il")).select("il").distinct().first().il == 0 and files.as_volume(volume) is volume


def test_knowledge_plans_and_volumes(spark, tmp_path):
    (tmp_path / "a.md").write_text("alpha")
    assert [(r.doc_id, r.text) for r in files.load_knowledge(spark, str(tmp_path)).collect()] == [("a", "alpha")]
    made = files.synthetic_volume(spark, 16, 36, 70)
    assert made.count() == 16 * 36 and made.where("il = 12 AND xl = 30").first().samples[62] < -1
    files.write_plan(spark, 'so: {"workflow_steps": [1]}', str(tmp_path / "p"))
    files.write_plan(spark, "no plan", str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p/vlm_plan")).first().value == '{"workflow_steps": [1]}' and spark.read.text(str(tmp_path / "p/vlm_plan_failed")).first().value == "no plan"
    cells = spark.createDataFrame([("f", 1, 2, 3, 0.5)], "class_name string, il int, xl int, s int, confidence double")
    files.write_volume(cells, str(tmp_path / "vol"))
    assert spark.read.parquet(str(tmp_path / "vol")).count() == 1
    with pytest.raises(NotImplementedError):
        files.write_volume(cells, str(tmp_path / "vol"), "crossline")


def test_nearest_value_on_either_side(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 6.0), ("b", 9.0)], "k string, v double")
    targets = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 5.2), ("a", 9.0), ("b", 1.0), ("c", 1.0)], "k string, t double")
    got = {(r.k, r.t): r.nearest for r in files.nearest(values, targets, "k", "v", "t").collect()}
    assert got == {("a", 0.0): 1.0, ("a", 5.0): 4.0, ("a", 5.2): 6.0, ("a", 9.0): 6.0, ("b", 1.0): 9.0}


def test_stream_equals_table(spark, tmp_path):
    src = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "ab"[i % 2], float(i)) for i in range(60)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "e"))
    want = {tuple(r) for r in windows.tumbling_counts(src).collect()}
    q = windows.tumbling_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("tumbled").collect()} == want


def test_sliding_features_equal_brute_force(spark):
    """Every feature of every window, for steps that halve, divide and do not divide the window; the samples are not repeated."""
    import statistics

    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(w, i, 1000.0 + 0.5 * i, *[None if rng.random() < 0.02 and w == 2 else float(v) for v in rng.normal(50, 20, 4)]) for w, n in ((1, 63), (2, 90), (3, 20)) for i in range(n)]
    curve = spark.createDataFrame(rows, "well long, idx long, depth double, gr double, rt double, den double, cnl double")
    wells = {w: [r for r in rows if r[0] == w] for w in (1, 2, 3)}
    for window, step in ((20, 10), (12, 5), (4, 6), (2, 1)):
        got = {(r.well, r.start_idx): r for r in curves.sliding_features(curve, window, step).collect()}
        assert sorted(got) == [(w, s) for w, all_ in wells.items() for s in range(0, len(all_) - window, step)]
        for (w, s), r in got.items():
            part = wells[w][s : s + window]
            gr = [p[3] for p in part]
            at = lambda k: gr[k] if 0 <= k < len(gr) else None  # noqa: B023,E731
            less = lambda a, b: None if a is None or b is None else a - b
            steps = [next((abs(v) for v in ((lambda d: d and d / 2)(less(at(k + 1), at(k - 1))), less(at(k + 1), at(k)), less(at(k), at(k - 1))) if v is not None), 0.0) for k in range(len(gr))]
            mean = lambda c: statistics.fmean(p[c] for p in part if p[c] is not None)  # noqa: B023,E731
            want = (part[0][2], part[-1][2], mean(3), statistics.pstdev(v for v in gr if v is not None), mean(4), mean(5), mean(6), statistics.fmean(steps))
            assert (r.depth_top, r.depth_bottom, r.gr_mean, r.gr_std, r.rt_mean, r.den_mean, r.cnl_mean, r.gr_slope) == pytest.approx(want)
    plan = curves.sliding_features(curve)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
