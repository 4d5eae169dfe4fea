"""Structured Streaming forms of the window operators; each also takes a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts and means; a stream drops rows later than `late`."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, step) if step else F.window(ts, size)
    out = source.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean_value")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions: islands of events with gaps below `gap`."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
