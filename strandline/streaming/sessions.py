"""Structured Streaming extensions: sessions by pause over event streams. The batch operators have no streaming counterpart to match; these are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n, value) of runs of events with pauses below `gap`. Works alike on a batch and on a stream; on a stream the watermark bounds state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(event_type, start, n) in tumbling, or with `slide` sliding, windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("event_type", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
