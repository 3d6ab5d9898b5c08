"""Windowed operators over unbounded tables, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str = "ts", length: str = "1 day", late: str = "1 hour", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count and sum per window and key; the same plan for tables and streams."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def gap_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Islands in time: rows of a key at most ``gap`` apart."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
