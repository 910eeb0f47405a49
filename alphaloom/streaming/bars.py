"""Bars from a stream of events: tumbling windows with a watermark, so that late events count and state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, symbol (event_type), open, high, low, close, volume of events (ts, event_type, value, event_id). The same on a batch and on a stream."""
    key = F.struct("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    rows = events.where("value is not null and ts is not null").withColumn("ts", ts)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    bars = rows.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume")
    )
    return bars.select(F.col("w.start").alias("start"), "symbol", "open", "high", "low", "close", "volume")
