"""Index algebra: December-chained aggregates, contributions, weights.

``levels`` has keys..., series, date (month starts), value; ``weights`` has year, series, w. A year's weights apply to the
growth since the December before. With keys such as ``draw``, every path has Decembers of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def renormalise(weights: DataFrame) -> DataFrame:
    """Shares of each year's basket."""
    return weights.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("year")))


def carry_weights(weights: DataFrame, until: int) -> DataFrame:
    """The last year's weights for the years after it up to ``until``; earlier years are never filled."""
    # All rows of the year's few series; the maximum is a column, so nothing runs while the plan is built.
    last = F.max("year").over(Window.partitionBy())
    return weights.withColumn("_last", last).withColumn("year", F.explode(F.when((F.col("year") == F.col("_last")) & (F.col("year") < until), F.sequence(F.col("year"), F.lit(until))).otherwise(F.array("year")))).drop("_last")


def december_ratio(levels: DataFrame, keys: Keys = ()) -> DataFrame:
    """``levels`` with year, december and ratio: a value over that of the same series in the December before its year."""
    before = Window.partitionBy(*keys, "series").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.month("date") == 12, F.struct(F.year("date").alias("year"), "value")), ignorenulls=True).over(before)
    out = levels.withColumn("year", F.year("date")).withColumn("_seen", seen).filter(F.col("_seen.year") == F.col("year") - 1)
    return out.withColumn("december", F.col("_seen.value")).drop("_seen").withColumn("ratio", F.col("value") / F.col("december"))


def weighted_ratios(levels: DataFrame, weights: DataFrame, keys: Keys, normalise: bool) -> DataFrame:
    """keys..., series, date, year, basket (series that the year's weights have), growth: share * ratio."""
    shares = renormalise(weights) if normalise else weights.withColumn("share", F.col("w") / 1000)
    shares = shares.filter("share is not null").select("year", "series", "share", F.count("*").over(Window.partitionBy("year")).alias("basket"))
    joined = december_ratio(levels, keys).join(shares, ["year", "series"])
    return joined.select(*keys, "series", "date", "year", "basket", (F.col("share") * F.col("ratio")).alias("growth"))


def earlier_decembers(keys: Keys, g: Column, start: float) -> Column:
    """The level that a year's growth sets out from: ``start`` times the growth of all earlier Decembers."""
    w = Window.partitionBy(*keys).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    return F.lit(start) * F.exp(F.coalesce(F.sum(F.when(F.month("date") == 12, g)).over(w), F.lit(0.0)))


def chain_link(levels: DataFrame, weights: DataFrame, keys: Keys = (), start: float = 100.0, normalise: bool = True) -> DataFrame:
    """keys..., date, value: the chained Laspeyres aggregate, ``start`` in the first December.

    Within a year it is the December level times g = sum of share * ratio, so over the years the Decembers' g multiply:
    one sum of logs over the years, and no recursion. Months in which a series is missing have no aggregate.
    """
    rows = weighted_ratios(levels, weights, keys, normalise)
    g = rows.groupBy(*keys, "year", "date").agg(F.sum("growth").alias("g"), F.count("growth").alias("n"), F.max("basket").alias("basket")).filter("n = basket")
    return g.select(*keys, "date", (earlier_decembers(keys, F.log("g"), start) * F.col("g")).alias("value"), "g")


def chain_terms(levels: DataFrame, weights: DataFrame, keys: Keys = (), start: float = 100.0, normalise: bool = True) -> DataFrame:
    """keys..., series, date, term, total: what each series adds to the aggregate; the terms of a date sum to total.

    All from one table of growths: windows over the series of a date, and over the years of a path.
    """
    date = Window.partitionBy(*keys, "date")
    rows = weighted_ratios(levels, weights, keys, normalise)
    rows = rows.withColumns({"g": F.sum("growth").over(date), "n": F.count("growth").over(date)}).filter("n = basket")
    rows = rows.withColumn("anchor", earlier_decembers(keys, F.log("g") / F.col("n"), start))
    return rows.select(*keys, "series", "date", (F.col("anchor") * F.col("growth")).alias("term"), (F.col("anchor") * F.col("g")).alias("total"))


def a_year_before(column: str, keys: Keys) -> Column:
    """The column's value of the same keys twelve months before, null if there is none."""
    w = Window.partitionBy(*keys).orderBy(F.year("date") * 12 + F.month("date")).rangeBetween(-12, -12)
    return F.first(column).over(w)


def yoy_contributions(terms: DataFrame, keys: Keys = ()) -> DataFrame:
    """Percentage points that each series adds to the 12-month growth of the total, and that growth."""
    by = [*keys, "series"]
    both = terms.withColumns({"term12": a_year_before("term", by), "total12": a_year_before("total", by)}).filter("total12 is not null")
    return both.select(*keys, "series", "date", (100 * (F.col("term") - F.col("term12")) / F.col("total12")).alias("contribution"), (100 * (F.col("total") / F.col("total12") - 1)).alias("yoy"))


def reanchored(levels: DataFrame, weights: DataFrame, published: DataFrame) -> DataFrame:
    """Each year's growth on the published December before, against what was published: date, rebuilt, value, error."""
    g = chain_link(levels, weights).select("date", "g")
    base = december_ratio(published.withColumn("series", F.lit("published"))).select("date", "value", "december")
    both = g.join(base, "date")
    return both.select("date", (F.col("december") * F.col("g")).alias("rebuilt"), "value", (F.col("december") * F.col("g") - F.col("value")).alias("error"))


def two_stage_chain(levels: DataFrame, weights: DataFrame, sub: Sequence[str], name: str) -> DataFrame:
    """First the series of ``sub`` are chained into one, then that one with the rest, by the sum of their weights."""
    inside, outside = F.col("series").isin(list(sub)), ~F.col("series").isin(list(sub))
    first = chain_link(levels.filter(inside), weights.filter(inside)).select(F.lit(name).alias("series"), "date", "value")
    begin = levels.select(F.add_months(F.trunc(F.min("date"), "year"), 11).alias("date")).select(F.lit(name).alias("series"), "date", F.lit(100.0).alias("value"))
    merged = levels.filter(outside).select("series", "date", "value").unionByName(first).unionByName(begin)
    grouped = weights.withColumn("series", F.when(inside, name).otherwise(F.col("series"))).groupBy("year", "series").agg(F.sum("w").alias("w"))
    return chain_link(merged, grouped)


def weight_identity(weights: DataFrame, total: float = 1000.0, tolerance: float = 0.5, guarded_from: int | None = None) -> DataFrame:
    """Each year's sum of weights against the total it should have."""
    sums = weights.groupBy("year").agg(F.sum("w").alias("weight_sum"), F.count("w").alias("n"))
    out = sums.withColumn("error", F.col("weight_sum") - total)
    guard = F.lit(True) if guarded_from is None else F.col("year") >= guarded_from
    return out.withColumn("status", F.when(~guard, "not guarded").when(F.abs("error") <= tolerance, "ok").otherwise("broken"))


def rebase_at_anchor(path: DataFrame, index: DataFrame, keys: Keys, before: Column) -> DataFrame:
    """``path`` in the index's units: index at the anchor * path / path at the anchor.

    The anchor is the last month before the path begins that both have.
    """
    common = path.join(index.withColumnRenamed("value", "index"), [*keys, "date"]).filter(F.col("date") < before)
    anchor = common.groupBy(*keys).agg(F.max_by(F.col("index") / F.col("value"), "date").alias("ratio"), F.max("date").alias("anchor_date"))
    return path.join(anchor, list(keys)).select(*keys, "date", "anchor_date", (F.col("value") * F.col("ratio")).alias("value"))


def official_contributions(terms: DataFrame, official: DataFrame) -> DataFrame:
    """Contributions whose terms are rescaled to the official total: share * official, over the official 12 months before."""
    shares = terms.join(official.withColumnRenamed("value", "official"), "date").withColumn("term", F.col("term") / F.col("total") * F.col("official"))
    return yoy_contributions(shares.select("series", "date", "term", F.col("official").alias("total")))


def weight_shares(weights: DataFrame) -> DataFrame:
    return weights.groupBy("year", "series").agg(F.sum("w").alias("w")).withColumn("pct", 100 * F.col("w") / F.sum("w").over(Window.partitionBy("year")))


def family_weights(weights: DataFrame, family: Column, total: float = 1000.0, tolerance: float = 0.5, guarded_from: int | None = None) -> DataFrame:
    """year, family, w: the weights of families of series; identity tells whether a guarded year's sum is the total."""
    sums = weights.groupBy("year", family.alias("family")).agg(F.sum("w").alias("w"))
    holds = F.abs(F.sum("w").over(Window.partitionBy("year")) - total) <= tolerance
    return sums.withColumn("identity", holds if guarded_from is None else F.when(F.col("year") >= guarded_from, holds))
