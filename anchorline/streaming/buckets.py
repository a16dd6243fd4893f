"""Periods of unbounded series: means by week with a watermark, and coverage of the current period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_stream(rows: DataFrame, time: str, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Mean and count of each week (from Monday) and key; a week is final once the watermark has passed it.

    A stream's windows of seven days begin on a Thursday, as the epoch did: the offset moves them to Monday.
    """
    window = F.window(time, "7 days", "7 days", "4 days")
    return rows.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(*keys, F.col("w.start").cast("date").alias("date"), "value", "n")


def daily_stream(rows: DataFrame, time: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(*keys, F.col("w.start").cast("date").alias("date"), "value", "n")
