"""Samples are dealt out by wells once, to as many tasks as they need."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import curves
from quarry.sources import views

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("curve", [views.line_curve, views.event_curve])
def test_windows_over_wells_move_no_row_again(spark, curve):
    c = curve(spark, SF)
    value = "gr" if "gr" in c.columns else "x"
    plan = curves.gradient_z(c, value)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_grow_with_the_rows_and_change_nothing(spark, monkeypatch):
    whole = views.line_curve(spark, SF)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(views, "ROWS_EACH", 2000)
    cut = views.line_curve(spark, SF)
    assert sorted(map(tuple, cut.collect())) == want
    each = cut.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert cut.rdd.getNumPartitions() == -(-len(want) // 2000)
    assert max(r["count"] for r in each) < 5000 < len(want) / 10  # 100 wells over 30 tasks are not quite even
    tasks = cut.select("well", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r["well"] for r in tasks})
