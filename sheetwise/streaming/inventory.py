"""Inventory over a stream of events (beyond what is asked): windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams take watermarks on zoned timestamps only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Events, their sum and extremes by type and window of (ts, event_type, value); rows later than the watermark are
    left out by a stream, and the same code runs over a table."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = _timed(events, late).groupBy(window.alias("w"), "event_type")
    return d.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"), F.max("value").alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total", "least", "most")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events at most ``gap`` apart."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")
