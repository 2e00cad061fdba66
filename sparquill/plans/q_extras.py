"""Extras beyond the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.plans.registry import query
from sparquill.sources.tables import table
from sparquill.streaming.windows import windowed_counts


@query("extra_event_windows", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = windowed_counts(table(spark, sf, "events"))
    return w.selectExpr("unix_timestamp(start) AS start_s", "event_type", "n", "total")
