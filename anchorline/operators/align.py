"""Joins of series and tables on dates, and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outer_align(named: dict[str, DataFrame]) -> DataFrame:
    """date and a column for each named series (date, value)."""
    return reduce(lambda a, b: a.join(b, "date", "full"), [df.select("date", F.col("value").alias(k)) for k, df in named.items()])


def common_dates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dates that every series has a value for."""
    held = df.filter("value is not null").groupBy("date").agg(F.count_distinct(*keys).alias("n"))
    return held.join(df.agg(F.count_distinct(*keys).alias("all")), F.col("n") == F.col("all")).select("date")


def nearest(targets: DataFrame, rows: DataFrame, keys: Sequence[str], days: int = 20) -> DataFrame:
    """For each target (keys, target) the row (keys, date, value) of the nearest date within ``days``, the earlier on ties.

    Dates are put into buckets of the tolerance's length, so a target meets the rows of three buckets and not all.
    """
    number = F.floor(F.unix_date("date") / days)
    mine = F.floor(F.unix_date("target") / days)
    spread = targets.withColumn("bucket", F.explode(F.array(mine - 1, mine, mine + 1)))
    met = spread.join(rows.withColumn("bucket", number), [*keys, "bucket"]).withColumn("days", F.abs(F.datediff("date", "target"))).filter(F.col("days") <= days)
    best = met.groupBy(*keys, "target").agg(F.min_by(F.struct("date", "value", "days"), F.struct("days", "date")).alias("best"))
    return targets.join(best, [*keys, "target"], "left").select(*keys, "target", "best.date", "best.value", "best.days")


def code_differences(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(found.select(key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def dedupe(df: DataFrame, keys: Sequence[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """One row of each key, and the keys whose rows have different values."""
    grouped = df.groupBy(*keys).agg(F.max(value).alias(value), F.count_distinct(value).alias("values"), F.count("*").alias("rows"))
    return grouped.select(*keys, value), grouped.filter("values > 1").select(*keys, "values", "rows")


def union_first(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All parts' rows; of one key the row of the part named first."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return tagged.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))).filter("_k = 1").drop("_k", "_part")


def replace_owned(table: DataFrame, new: DataFrame, owned) -> DataFrame:
    """``table`` whose owned rows give way to ``new``; the others stay as they are."""
    return table.filter(~F.coalesce(owned, F.lit(False))).unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of the same keys."""
    return table.join(new, list(keys), "left_anti").select(table.columns).unionByName(new.select(table.columns))


def remove(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` without the rows whose keys are in ``gone``."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(table.columns)


def table_signature(df: DataFrame) -> DataFrame:
    """rows, signature: sums of two halves of the rows' SHA-256, so their order does not matter and repeats count."""
    half = lambda at: F.sum(F.conv(F.substring("sha", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    hashed = df.select(F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("sha"))
    return hashed.agg(F.count("*").alias("rows"), F.concat_ws(":", half(1), half(16)).alias("signature"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int = 1) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def horizon_cap(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.withColumn("_k", F.dense_rank().over(Window.partitionBy(*keys).orderBy("date"))).filter(F.col("_k") <= n).drop("_k")


def preferred(df: DataFrame, keys: Sequence[str], column: str, order: DataFrame) -> DataFrame:
    """Rows of the first metric in ``order`` (the column, place) that a key has."""
    ranked = df.join(order, column).withColumn("_best", F.min("place").over(Window.partitionBy(*keys)))
    return ranked.filter("place = _best").drop("place", "_best")


def latest_change(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value of each key and its change from the one before."""
    w = Window.partitionBy(*keys).orderBy("date")
    seen = df.filter("value is not null").withColumn("previous", F.lag("value").over(w))
    return seen.groupBy(*keys).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"), F.max_by(F.col("value") - F.col("previous"), "date").alias("change"))
