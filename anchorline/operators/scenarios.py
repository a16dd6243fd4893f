"""Scenarios: taxes and conditions over draws, pairs of baseline and scenario, checks of stored baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.calendar import forward_fill
from anchorline.operators.fans import FAN, admissible, fan, keep_draws
from anchorline.operators.tax import bridge_scale, index_with_tax, overlay

Keys = Sequence[str]


def tax_context(index: DataFrame, prices: DataFrame, keys: Keys) -> DataFrame:
    """keys..., gamma: the slope of prices on the index, which turns index points into prices."""
    both = index.select(*keys, "date", F.col("value").alias("i")).join(prices.select(*keys, "date", F.col("value").alias("p")), [*keys, "date"])
    return both.groupBy(*keys).agg(bridge_scale(F.col("i"), F.col("p")).alias("gamma"))


def applied_taxes(taxes: DataFrame, dates: DataFrame) -> DataFrame:
    """date, vat, excise of every date of ``dates``: the last of ``taxes`` at or before it."""
    long = taxes.unpivot(["date"], ["vat", "excise"], "series", "value").filter("value is not null")
    wanted = dates.select("date").withColumn("series", F.explode(F.array(F.lit("vat"), F.lit("excise"))))
    held = forward_fill(long, ["series"], wanted)
    return held.groupBy("date").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in ("vat", "excise")])


def tax_pair(pre: DataFrame, taxes: DataFrame, gamma: Column, start: str, vat_points: float = 0.0, excise: float = 0.0) -> DataFrame:
    """``pre`` (..., date, value before tax) with baseline and scenario: index values with the taxes, and with VAT that is
    ``vat_points`` and excise that is ``excise`` higher from ``start`` on."""
    path = overlay(taxes, start, F.col("vat") + vat_points, F.col("excise") + excise)
    joined = pre.join(path, "date")
    both = {"baseline": ("vat", "excise"), "scenario": ("scenario_vat", "scenario_excise")}
    return joined.withColumns({k: index_with_tax(F.col("value"), gamma, F.col(v), F.col(e)) for k, (v, e) in both.items()}).select(*pre.columns, "baseline", "scenario")


def pair_effect(pairs: DataFrame, keys: Keys, relative: bool = False) -> DataFrame:
    """The fan of each draw's scenario less its baseline, or of the ratio in per cent."""
    effect = 100 * (F.col("scenario") / F.col("baseline") - 1) if relative else F.col("scenario") - F.col("baseline")
    return fan(pairs.withColumn("effect", effect), keys, FAN, "effect")


def paired_draws(baseline: DataFrame, scenario: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, baseline, scenario of the draws that are admissible in both: one mask for the two legs."""
    on = [*keys, "draw"]
    both = baseline.select(*on, "date", F.col("value").alias("baseline")).join(scenario.select(*on, "date", F.col("value").alias("scenario")), [*on, "date"])
    legs = both.unpivot([*on, "date"], ["baseline", "scenario"], "leg", "value")
    return keep_draws(both, admissible(legs, keys), keys)


def rebased_pair(pairs: DataFrame, index: DataFrame, keys: Keys, anchor: str) -> DataFrame:
    """Both legs of ``pairs`` in the index's units: the ratio of the index and the baseline at the anchor date, for each draw."""
    at = F.lit(anchor).cast("date")
    base = pairs.filter(F.col("date") == at).select(*keys, "draw", "baseline").join(index.filter(F.col("date") == at).select(*keys, F.col("value").alias("level")), list(keys))
    scale = base.select(*keys, "draw", (F.col("level") / F.col("baseline")).alias("scale"))
    return pairs.join(scale, [*keys, "draw"]).select(*keys, "draw", "date", (F.col("baseline") * F.col("scale")).alias("baseline"), (F.col("scenario") * F.col("scale")).alias("scenario"))


def replay_gap(stored: DataFrame, replayed: DataFrame, keys: Keys, tolerance: float = 1e-8) -> DataFrame:
    """Of stored and replayed paths: rows that only one has, the largest difference, and whether they are the same."""
    on = [*keys, "draw", "date"]
    both = stored.select(*on, F.col("value").alias("a")).join(replayed.select(*on, F.col("value").alias("b")), on, "full")
    gap = F.max(F.abs(F.col("a") - F.col("b")))
    alone = F.count_if(F.col("a").isNull() != F.col("b").isNull())
    return both.agg(F.count("*").alias("rows"), alone.alias("alone"), gap.alias("gap"), ((alone == 0) & (F.coalesce(gap, F.lit(0.0)) <= tolerance)).alias("same"))


def mixed_vintages(parts: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """keys..., vintages, parts of the keys whose parts come from more than one vintage."""
    tagged = [df.select(*keys, "vintage").distinct().withColumn("part", F.lit(name)) for name, df in parts.items()]
    both = tagged[0]
    for part in tagged[1:]:
        both = both.unionByName(part)
    return both.groupBy(*keys).agg(F.count_distinct("vintage").alias("vintages"), F.count_distinct("part").alias("parts")).filter("vintages > 1")


def overlap_gaps(series: DataFrame, history: DataFrame) -> DataFrame:
    """date: months inside the overlap of a series and the positive history on which one of them has no value."""
    ends = lambda df, name: df.filter("value is not null").agg(F.min("date").alias(f"{name}_from"), F.max("date").alias(f"{name}_to"))
    # A row each.
    span = ends(series, "s").join(ends(history.filter("value > 0"), "h"), F.lit(True))
    grid = span.select(F.explode(F.sequence(F.greatest("s_from", "h_from"), F.least("s_to", "h_to"), F.expr("interval 1 month"))).alias("date")).filter("date is not null")
    held = series.filter("value is not null").select("date").join(history.filter("value > 0").select("date"), "date", "left_semi")
    return grid.join(held, "date", "left_anti")


def observed_paths(series: DataFrame, history: DataFrame, draws: int) -> DataFrame:
    """draw, date, value: an observed monthly series as paths that are the same in every draw, on the dates from the later start to the
    earlier end of it and of the positive published history. ValueError names months inside that lack a value: none is filled."""
    gaps = sorted(str(r["date"]) for r in overlap_gaps(series, history).limit(10).collect())
    if gaps:
        raise ValueError(f"months inside the overlap lack values: {gaps}")
    on = series.filter("value is not null").select("date", "value").join(history.filter("value > 0").select("date"), "date", "left_semi")
    return on.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "date", "value")


def paired_posterior(posterior: DataFrame, pairs: DataFrame) -> DataFrame:
    """``posterior`` with a draw for each of ``pairs`` (pair_id, draw): several pairs may share a draw."""
    told = pairs.select(F.col("pair_id").cast("int").alias("_pair"), "draw")
    return posterior.join(told, "draw").withColumn("draw", F.col("_pair")).drop("_pair").select(posterior.columns)


def growth_conditions(paths: DataFrame, pairs: DataFrame, origin: str, horizon: int, series: str) -> DataFrame:
    """draw (the pair), series, h, value: log growth in per cent, in the periods after ``origin``, of the path (draw, date, value) of each pair."""
    w = Window.partitionBy("draw").orderBy("date")
    grown = paths.filter(F.col("date") >= F.lit(origin).cast("date")).withColumns({"h": F.row_number().over(w) - 1, "value": 100 * (F.log("value") - F.log(F.lag("value").over(w)))})
    return grown.filter((F.col("h") >= 1) & (F.col("h") <= horizon)).join(pairs.select("pair_id", "draw"), "draw").select(F.col("pair_id").cast("int").alias("draw"), F.lit(series).alias("series"), "h", "value")


def transfer(posterior: DataFrame, tail: DataFrame, keys: Keys, baseline: DataFrame, scenario: DataFrame, horizon: int, seed: int) -> DataFrame:
    """keys..., draw, h, series, baseline, scenario: what a model makes of another one's two legs, each pair with the same shocks.

    ``posterior`` is a paired_posterior(), the legs are growth_conditions(); rows "spread of ..." tell the shocks' deviations.
    """
    from anchorline.operators.models import simulate

    every = posterior.select(*keys).distinct()

    def leg(conditions: DataFrame, name: str) -> DataFrame:
        return simulate(posterior, tail, keys, horizon, seed, every.join(conditions, F.lit(True)), spreads=True).withColumnRenamed("value", name)

    return leg(baseline, "baseline").join(leg(scenario, "scenario"), [*keys, "draw", "h", "series"])


def pairing_gap(legs: DataFrame, keys: Keys, tolerance: float = 1e-12) -> DataFrame:
    """keys..., pairs, gap, paired: whether both legs of a transfer() had shocks of the same deviations."""
    gap = F.max(F.abs(F.col("scenario") - F.col("baseline")))
    return legs.filter("series like 'spread of %'").groupBy(*keys).agg(F.count_distinct("draw").alias("pairs"), gap.alias("gap"), (gap <= tolerance).alias("paired"))


def total_effect(legs: DataFrame, weights: DataFrame, keys: Keys, without: Sequence[str] = ()) -> DataFrame:
    """keys..., draw, h, baseline, scenario, effect: indices (1 before h = 1) of both legs' weighted growth, and the scenario's distance in per
    cent. ``without`` leaves series out, the weights of the others being scaled up to the whole: a core index."""
    upto = Window.partitionBy(*keys, "draw", "series").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    own = weights.filter(~F.col("series").isin(*without)) if without else weights
    level = lambda c: F.exp(F.sum(c).over(upto) / 100)
    rows = legs.join(own.select("series", "w"), "series").withColumns({"b": level("baseline"), "s": level("scenario")})
    share = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    sums = rows.groupBy(*keys, "draw", "h").agg(share("b").alias("baseline"), share("s").alias("scenario"))
    return sums.withColumn("effect", 100 * (F.col("scenario") / F.col("baseline") - 1))


def future_regressors(last: DataFrame, keys: Keys, horizon: int, driver: str = "value") -> DataFrame:
    """keys..., date, driver (held at its last value), m01..m11: the regressors of the months after ``last`` (keys..., date, value)."""
    from anchorline.functions.scalar import seasonal_dummies

    months = last.select(*keys, F.explode(F.sequence(F.add_months("date", 1), F.add_months("date", horizon), F.expr("interval 1 month"))).alias("date"), F.col(driver).alias("driver"))
    return months.select(*keys, "date", "driver", *seasonal_dummies(F.col("date")))


def state_conditions(conditions: DataFrame, transform: Column, partial: bool = False) -> DataFrame:
    """``conditions`` (..., value) as a model sees them: logs, shares of 100 or as they are. Without ``partial`` nulls are an error."""
    if not partial and not conditions.filter("value is null").isEmpty():
        raise ValueError("conditions have nulls")
    v = F.col("value")
    return conditions.withColumn("state", F.when(transform == "logdiff", F.when(v > 0, F.log(v))).when(transform == "percent_rate_diff", v / 100).otherwise(v))


def condition_from_quantile(fans: DataFrame, keys: Keys, quantile: str, after: str) -> DataFrame:
    """keys..., h, value: a fan's quantile after a date as the condition path of a simulation."""
    w = Window.partitionBy(*keys).orderBy("date")
    return fans.filter(F.col("date") > F.lit(after).cast("date")).select(*keys, F.row_number().over(w).alias("h"), F.col(quantile).alias("value"))
