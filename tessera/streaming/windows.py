"""Event-time windows; the same functions take batch and streaming DataFrames. Beyond the relational dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and value sums by event type and window; late events count until the watermark passes."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of gap or more."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n")
