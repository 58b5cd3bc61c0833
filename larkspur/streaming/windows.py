"""Streaming forms of the time-series operators (batch operators of the dialect, over unbounded input)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, ts: str, width: str, *keys: str, late: str = "10 minutes", aggregates: list[Column] | None = None) -> DataFrame:
    """Tumbling buckets of `width`; a bucket is final when the watermark of `late` has passed it."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    found = grouped.agg(*(aggregates or [F.count("*").alias("n")]))
    return found.withColumn("bucket", F.col("window.start")).drop("window")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of keys that a pause of `gap` ends."""
    grouped = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
