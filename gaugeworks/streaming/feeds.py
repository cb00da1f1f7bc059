"""The monitor's counts over a stream: rows and last moment of each feed in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_counts(events: DataFrame, clock: str, feeds: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Works on a stream and on a table; on a stream, rows later than `late` are dropped by the watermark."""
    at = events.withColumn("at", F.col(clock).cast("timestamp")).withWatermark("at", late)
    out = at.groupBy(F.window("at", width), *feeds).agg(F.count(F.lit(1)).alias("rows"), F.max("at").alias("last_at"))
    return out.select(F.col("window.start").alias("window_start"), *feeds, "rows", "last_at")
