"""The tables that people read: summaries of forecasts, effects, nowcasts and structures, as joins of fans, history and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.calendar import horizons
from anchorline.operators.index import a_year_before

Keys = Sequence[str]


def latest_observed(history: DataFrame, keys: Keys, origin: str) -> DataFrame:
    """keys..., latest_date, latest: the last value at or before ``origin``."""
    seen = history.filter((F.col("date") <= F.lit(origin).cast("date")) & F.col("value").isNotNull())
    return seen.groupBy(*keys).agg(F.max("date").alias("latest_date"), F.max_by("value", "date").alias("latest"))


def forecast_summary(history: DataFrame, fans: DataFrame, keys: Keys, origin: str) -> DataFrame:
    """A row for each label M+1, M+2, ...: the latest observed value and the fan of the label's month, null where there is none."""
    labels = horizons(fans, keys, origin)
    named = labels.join(fans.withColumnRenamed("date", "target"), [*keys, "target"], "left")
    return named.join(latest_observed(history, keys, origin), list(keys), "left")


def effect_table(baseline: DataFrame, scenario: DataFrame, effect: DataFrame, keys: Keys, columns: Sequence[str] = ("mean", "q50")) -> DataFrame:
    """keys..., date and the columns of three fans side by side; a date that only some have stays, with nulls."""
    named = lambda df, prefix: df.select(*keys, "date", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    on = [*keys, "date"]
    return named(baseline, "baseline").join(named(scenario, "scenario"), on, "full").join(named(effect, "effect"), on, "full")


def nowcast_table(fans: DataFrame, observed: DataFrame, keys: Keys, missing_only: bool = False) -> DataFrame:
    """keys..., date, status (observed or nowcast), observed and the fan; ``missing_only`` leaves out what is observed."""
    both = fans.join(observed.filter("value is not null").select(*keys, "date", F.col("value").alias("observed")), [*keys, "date"], "left")
    out = both.withColumn("status", F.when(F.col("observed").isNotNull(), "observed").otherwise("nowcast"))
    return out.filter("status = 'nowcast'") if missing_only else out


def merged_nowcasts(baseline: DataFrame, scenario: DataFrame, keys: Keys) -> DataFrame:
    """keys..., date, baseline, scenario of the dates that both have."""
    return baseline.select(*keys, "date", F.col("value").alias("baseline")).join(scenario.select(*keys, "date", F.col("value").alias("scenario")), [*keys, "date"])


def transformed(df: DataFrame, keys: Keys, kind: Column) -> DataFrame:
    """``df`` with shown: the growth over a year in per cent (``yoy_pct``), the change over it (``diff12``) or the value (``level``)."""
    old = df.withColumn("_old", a_year_before("value", keys))
    yoy, diff = 100 * (F.col("value") / F.col("_old") - 1), F.col("value") - F.col("_old")
    return old.withColumn("shown", F.when(kind == "yoy_pct", yoy).when(kind == "diff12", diff).otherwise(F.col("value"))).drop("_old")


def scores(df: DataFrame, keys: Keys, column: str = "shown") -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("z", (F.col(column) - F.avg(column).over(w)) / F.stddev_samp(column).over(w))


def latest_valid(df: DataFrame, keys: Keys, column: str, columns: Sequence[str]) -> DataFrame:
    """Of each key the columns on the last date on which ``column`` is not null."""
    return df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in columns])


def kpis(effect: DataFrame, keys: Keys, value: str = "q50") -> DataFrame:
    """keys..., first, last, peak and its date: an effect's size at its ends and where it is furthest from 0, the earlier on ties."""
    size = F.struct(F.round(F.abs(F.col(value)), 9), -F.unix_date("date"))
    return effect.groupBy(*keys).agg(F.min_by(value, "date").alias("first"), F.max_by(value, "date").alias("last"), F.max_by(value, size).alias("peak"), F.max_by("date", size).alias("peak_date"))


def top_contributions(contributions: DataFrame, date: Column, k: int) -> DataFrame:
    """date, series, contribution, place of the k largest contributions of a date in size."""
    w = Window.partitionBy("date").orderBy(F.desc(F.round(F.abs("contribution"), 9)), "series")
    return contributions.filter(F.col("date") == date).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("date", "series", "contribution", "place")


def record_counts(display: DataFrame, keys: Keys) -> DataFrame:
    """keys..., record_type, rows, first, last: what a display table holds."""
    return display.groupBy(*keys, "record_type").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def as_display(df: DataFrame, schema, **fixed: str) -> DataFrame:
    """``df`` with the columns of the display contract in their order and types; what it has not is null or fixed."""
    held = {**{c: F.col(c) for c in df.columns}, **{k: F.lit(v) for k, v in fixed.items()}}
    return df.select(*[held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def statistic(df: DataFrame, name: str) -> DataFrame:
    """``df`` with shown: its mean or median column; ValueError if any is null."""
    column = {"mean": "mean", "median": "q50"}[name]
    if not df.filter(F.col(column).isNull()).isEmpty():
        raise ValueError(f"{column} has nulls")
    return df.withColumn("shown", F.col(column))
