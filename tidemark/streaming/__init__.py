"""Structured Streaming forms: sessions in event time, and windowed counts with late data dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): events closer than ``gap`` chained; works on batch and streaming tables alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    by = rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return by.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windows(events: DataFrame, size: str, slide: str | None, keys: list[str], value: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(keys, start, n, total) of tumbling or sliding windows."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    by = rows.groupBy(F.window(ts, size, slide or size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(*keys, F.col("window.start").alias("start"), "n", "total")
