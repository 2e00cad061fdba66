"""An extra beside the batch queries: event counts in tumbling windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of each window; a stream keeps state only for windows the watermark has not passed."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    g = grouped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")
