"""Structured Streaming forms of the daily rollups (an extension of the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_rollup(events: DataFrame, ts: str, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Count, sum and mean per day and key; a day is final once the watermark has passed it."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark, for feeds that deliver rows again."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
