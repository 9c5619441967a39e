"""Slot counts over a stream: the batch operators' counts, kept up to date by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str = "ts", item: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(period, slot, count) of event-time windows; rows later than the watermark are left out."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), F.col(item).alias("slot")).agg(F.count("*").alias("count"))
    return own.select(F.date_format("window.start", "yyyy-MM-dd").alias("period"), "slot", "count")
