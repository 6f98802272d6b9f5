"""Transforms over streams. They are stateless per row, so the batch functions apply to streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window of time; rows later than `late` are left out. An extension.

    A watermark needs a point in time, so a `ts` without a zone is taken in the session's.
    """
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
