"""Taxes in prices: pre-tax prices and index levels, scenarios, and the layers of a contribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.index import a_year_before

LAYERS = ("pre_tax", "excise", "vat", "unsplit")


def bridge_scale(index: Column, price: Column) -> Column:
    """The slope through the origin of prices on an index, from six months at least."""
    both = index.isNotNull() & price.isNotNull()
    return F.when(F.count_if(both) >= 6, F.sum(F.when(both, index * price)) / F.sum(F.when(both, index * index)))


def pre_tax(index: Column, gamma: Column, vat: Column, excise: Column) -> Column:
    return gamma * index / (1 + vat / 100) - excise


def with_tax(pre: Column, vat: Column, excise: Column) -> Column:
    return (pre + excise) * (1 + vat / 100)


def index_with_tax(pre: Column, gamma: Column, vat: Column, excise: Column) -> Column:
    return with_tax(pre, vat, excise) / gamma


def overlay(base: DataFrame, start: str, vat: Column | None = None, excise: Column | None = None) -> DataFrame:
    """From ``start`` on, the scenario's taxes in place of the base's; a null in a dated path leaves the base's."""
    active = F.col("date") >= F.lit(start).cast("date")
    out = base.withColumn("scenario_active", active)
    for name, new in (("vat", vat), ("excise", excise)):
        out = out.withColumn(f"scenario_{name}", F.when(active, F.coalesce(new if new is not None else F.lit(None), F.col(name))).otherwise(F.col(name)))
    return out


def condition_path(last: DataFrame, keys: Sequence[str], horizon: int, start: int, end: int, value: float, mode: str = "percent") -> DataFrame:
    """keys..., h, value for h = 1 to ``horizon``: ``percent`` of the last value, or a ``level``, from start to end; null else."""
    level = F.col("value") * (1 + F.lit(value) / 100) if mode == "percent" else F.lit(float(value))
    path = last.select(*keys, "value", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return path.select(*keys, "h", F.when(F.col("h").between(start, end), level).alias("value"))


def yearly_growth_path(history: DataFrame, keys: Sequence[str], rates: DataFrame) -> DataFrame:
    """keys..., h, value: the levels after ``history`` (keys..., date, value) whose growth over twelve months is the vector ``rates``
    (keys..., h, rate in per cent; null is no condition). Beyond a year they grow from the path itself, and are null after a gap in it."""
    last = history.filter("value is not null").groupBy(*keys).agg(F.max("date").alias("end"))
    month = rates.join(last, list(keys)).withColumn("year", F.ceil(F.col("h") / 12).cast("int"))
    base = month.withColumn("date", F.to_date(F.add_months("end", F.col("h") - 12 * F.col("year")))).join(history.select(*keys, "date", "value"), [*keys, "date"], "left")
    w = Window.partitionBy(*keys, F.col("h") % 12).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.log1p(F.col("rate") / 100)).over(w))
    whole = F.count("rate").over(w) == F.count("h").over(w)
    return base.select(*keys, "h", F.when(whole, F.col("value") * grown).alias("value"))


def layer_shares(pre: Column, vat: Column, excise: Column) -> list[Column]:
    """Shares of the price with tax: before tax, excise, VAT (the rest); all of it unsplit where they can't be told."""
    gross = with_tax(pre, vat, excise)
    told = pre.isNotNull() & vat.isNotNull() & excise.isNotNull() & (gross > 0)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    one, two = clip(pre / gross), clip((pre + excise) / gross)
    shares = (one, two - one, 1 - two)
    return [*[F.when(told, x).otherwise(0.0).alias(n) for x, n in zip(shares, LAYERS, strict=False)], F.when(told, 0.0).otherwise(1.0).alias("unsplit")]


def layer_contributions(terms: DataFrame, shares: DataFrame) -> DataFrame:
    """series, date, layer, contribution of ``terms`` (series, date, term, total) by ``shares`` (series, date, layers).

    A month is split only if it and the month a year before can be; else all of its contribution is unsplit.
    """
    joined = terms.join(shares, ["series", "date"], "left").withColumn("unsplit", F.coalesce("unsplit", F.lit(1.0)))
    for name in LAYERS[:-1]:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0.0)))
    both = joined.withColumns({f"{name}12": a_year_before(name, ["series"]) for name in ("term", "total", *LAYERS)})
    both = both.filter("total12 is not null").withColumn("told", (F.col("unsplit") == 0) & (F.col("unsplit12") == 0))
    part = lambda n: 100 * (F.col("term") * F.col(n) - F.col("term12") * F.col(f"{n}12")) / F.col("total12")
    whole = 100 * (F.col("term") - F.col("term12")) / F.col("total12")
    split = [F.when(F.col("told"), part(n)).otherwise(0.0).alias(n) for n in LAYERS[:-1]]
    wide = both.select("series", "date", *split, F.when(F.col("told"), 0.0).otherwise(whole).alias("unsplit"))
    return wide.unpivot(["series", "date"], list(LAYERS), "layer", "contribution")


def layer_matrix(contributions: DataFrame) -> DataFrame:
    """series by layer of one date's contributions, with a row of totals."""
    sums = [F.sum(F.when(F.col("layer") == n, F.col("contribution"))).alias(n) for n in LAYERS]
    return contributions.rollup("series").agg(*sums, F.sum("contribution").alias("total")).withColumn("series", F.coalesce("series", F.lit("total")))
