"""Overlap joins, suppression by rounds and tiled components against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import components, curves, overlaps, sections
from quarry.operators import detections as det


def random_boxes(rng, n, images=2, classes=2):
    """Boxes of very different sizes, some thin, flat, equal or the wrong way round, with tied confidences."""
    rows = []
    for i in range(n):
        size = rng.choice([0.01, 0.05, 0.2, 0.9])
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        w, h = size * rng.uniform(0.2, 1), size * rng.uniform(0.2, 1) * rng.choice([1, 1, 0.02])
        if i % 17 == 0 and rows:
            _, _, _, x, y, x2, y2, _ = rows[-1]
            w, h = x2 - x, y2 - y
        if i % 23 == 0:
            w = 0.0
        if i % 29 == 0:
            h = -h
        rows.append((i, rng.randrange(images), rng.randrange(classes), x, y, x + w, y + h, round(rng.random(), 1)))
    return rows


BOXES = "det_id long, image int, class_id int, x1 double, y1 double, x2 double, y2 double, confidence double"


def iou(a, b):
    w, h = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
    area = lambda r: max(0.0, r[5] - r[3]) * max(0.0, r[6] - r[4])
    return w * h / (area(a) + area(b) - w * h + 1e-8)


def brute_greedy(rows, over):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[0])):
        if not any(k[1:3] == r[1:3] and iou(k, r) > over for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


@pytest.mark.parametrize("kind", ["mixed", "points", "whole numbers"])
def test_interval_join(spark, kind):
    rng = random.Random(kind)
    cut = (lambda v: int(v)) if kind == "whole numbers" else (lambda v: v)
    def side(n, points):
        rows = []
        for i in range(n):
            lo = cut(rng.uniform(-500, 500))
            rows.append((i, rng.randrange(3), lo, lo if points else lo + cut(rng.choice([0, 1, 30, 700]) * rng.random() - (0.01 if i % 19 == 0 else 0))))
        return rows + [(n, None, 1, 2), (n + 1, 1, None, 3), (n + 2, 1, 5, None)]
    a, b = side(150, kind == "points"), side(150, False)
    t = "long" if kind == "whole numbers" else "double"
    as_t = (lambda rows: rows) if t == "long" else (lambda rows: [(i, k, None if x is None else float(x), None if y is None else float(y)) for i, k, x, y in rows])
    left = spark.createDataFrame(as_t(a), f"a long, k int, a1 {t}, a2 {t}")
    right = spark.createDataFrame(as_t(b), f"b long, k int, b1 {t}, b2 {t}")
    got = sorted((r["a"], r["b"]) for r in overlaps.overlap_join(left, right, [("a1", "a2")], [("b1", "b2")], ["k"]).collect())
    ok = lambda r: None not in r and r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(want) > 50


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "a long, a1 double, a2 double")
    assert overlaps.overlap_join(none, none.toDF("b", "b1", "b2"), [("a1", "a2")], [("b1", "b2")]).count() == 0


def test_box_pairs(spark):
    rows = random_boxes(random.Random(2), 250)
    d = spark.createDataFrame(rows, BOXES)
    got = {(r["det_id"], r["o_det_id"]): r["iou"] for r in overlaps.box_pairs(d, d, ["image", "class_id"], "o_", 0.1).collect()}
    want = {(a[0], b[0]): iou(a, b) for a in rows for b in rows if a[1:3] == b[1:3] and iou(a, b) > 0.1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("over", [0.0, 0.3, 0.7])
def test_suppression_by_rounds_is_the_fold(spark, over):
    rows = random_boxes(random.Random(int(over * 10)), 300, images=1, classes=2)
    d = spark.createDataFrame(rows, BOXES)
    want = brute_greedy(rows, over)
    assert {r["det_id"] for r in det.nms_greedy(d, over, fold_boxes=0).collect()} == want
    assert {r["det_id"] for r in det.nms_greedy(d, over).collect()} == want
    few = overlaps.suppress_by_rounds(d.where("det_id < 120"), over, ["image", "class_id"], listed=2)  # more rounds
    assert {r["det_id"] for r in few.collect()} == brute_greedy(rows[:120], over)
    mixed = spark.createDataFrame(rows + [(1000 + i, 9, 9, *r[3:]) for i, r in enumerate(rows[:20])], BOXES)
    assert {r["det_id"] for r in det.nms_greedy(mixed, over, fold_boxes=50).collect()} == brute_greedy(rows + [(1000 + i, 9, 9, *r[3:]) for i, r in enumerate(rows[:20])], over)


def test_one_image_of_many_boxes(spark):
    """20,000 boxes of one image and class in 400 heaps: no group, and one box a heap and cell at the end."""
    d = spark.range(20_000).selectExpr("id AS det_id", "1 AS image", "1 AS class_id", "cast(id % 20 AS double) AS x1", "cast((id div 20) % 20 AS double) AS y1", "(id % 20) + 0.8D AS x2", "((id div 20) % 20) + 0.8D AS y2", "pmod(xxhash64(id), 1000) / 1000D AS confidence")
    began = time.time()
    kept = det.nms_greedy(d, 0.3).collect()
    assert len(kept) == 400 and time.time() - began < 120
    best = {(r["x1"], r["y1"]): r["c"] for r in d.groupBy("x1", "y1").agg(F.max("confidence").alias("c")).collect()}
    assert sorted(r["confidence"] for r in kept) == sorted(best.values())


def test_hits_of_all_three_kinds(spark):
    zones = spark.createDataFrame([(1, 10.0, 20.0, "gas"), (1, 12.0, 30.0, "water"), (2, 5.0, 9.0, "gas"), (2, 14.0, 16.0, "gas")], "well int, depth_top double, depth_bottom double, fluid string")
    truth = spark.createDataFrame([("a", 11.0, 19.0), ("b", 30.0, 40.0)], "gt_id string, gt_top double, gt_bottom double")
    assert sorted(map(tuple, curves.interval_recall(truth, zones).collect())) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 0)]
    assert sorted((r["well"], r["gt_id"], r["off"]) for r in curves.tolerance_match(truth, zones, 3.0).collect()) == [(1, "a", 1.0), (1, "a", 1.0)]
    points = spark.createDataFrame([("p", 15.0, "gas"), ("q", 9.0, "gas"), ("r", 15.0, "oil")], "gt_id string, gt_depth double, fluid string")
    assert sorted(map(tuple, curves.labelled_hits(points, zones, "fluid").collect())) == [("p", 1, 1), ("p", 2, 1), ("q", 2, 1)]


def brute_labels(cells):
    label, todo = {}, sorted(cells)
    for c in todo:
        if c in label:
            continue
        stack, label[c] = [c], c[0] * components.SAMPLES + c[1]
        while stack:
            t, s = stack.pop()
            for n in ((t + 1, s), (t - 1, s), (t, s + 1), (t, s - 1)):
                if n in cells and n not in label:
                    label[n] = label[c]
                    stack.append(n)
    return label


def test_labels_of_a_tile():
    rng = random.Random(4)
    for share in (0.1, 0.45, 0.6, 0.9):
        cells = [(t, s) for t in range(40) for s in range(30) if rng.random() < share]
        rng.shuffle(cells)
        got = components.label_tile(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]))
        assert dict(zip(cells, got.tolist(), strict=True)) == brute_labels(set(cells))


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_components_over_tiles(spark, tile):
    rng = random.Random(tile)
    masks = {il: {(t, s) for t in range(24) for s in range(24) if rng.random() < share} for il, share in enumerate((0.4, 0.55, 0.62))}
    # a snake that passes every tile
    masks[7] = {(t, s) for t in range(24) for s in range(24) if t % 2 == 0 or s == (23 if t % 4 == 1 else 0)}
    rows = [(il, t, s, 1.0) for il, m in masks.items() for t, s in m]
    got = components.label_cells(spark.createDataFrame(rows, "il int, trace int, s int, p double"), tile=tile).collect()
    assert len(got) == len(rows)
    want = {il: brute_labels(m) for il, m in masks.items()}
    assert all(r["region"] == want[r["il"]][r["trace"], r["s"]] for r in got)


def test_components_of_nothing_and_of_long_chains(spark):
    none = spark.createDataFrame([], "il int, trace int, s int, p double")
    assert components.label_cells(none).count() == 0 and sections.label_regions(none).count() == 0
    edges = spark.range(200).selectExpr("cast(id % 2 AS int) AS g", "id AS a", "id + 2 AS b")
    roots = components.smallest_reachable(edges, ["g"]).collect()
    assert {(r["node"], r["root"]) for r in roots} == {(k, k % 2) for k in range(2, 202)}
