"""Event-time windows; the same logic runs on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """ts as a zoned timestamp, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str | None = None, ts: str = "ts", key: str = "event_type") -> DataFrame:
    if late:
        events = event_time(events, ts).withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("start"), key, "n", "total"))


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    if late:
        events = event_time(events, ts).withWatermark(ts, late)
    return (events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("start"), "n"))
