"""Time operators over long panels: keys..., date, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]
STEP = {"month": "interval 1 month", "week": "interval 7 days"}


def by(keys: Keys, *order: str):
    return Window.partitionBy(*keys).orderBy(*(order or ("date",)))


def period_mean(df: DataFrame, keys: Keys, unit: str = "week") -> DataFrame:
    """The mean of each period, labelled by its first day (weeks run from Monday to Sunday)."""
    return df.groupBy(*keys, F.trunc("date", unit).alias("date")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def period_last(df: DataFrame, keys: Keys, unit: str = "week") -> DataFrame:
    """The value of the last date of each period that has one."""
    return df.filter("value is not null").groupBy(*keys, F.trunc("date", unit).alias("date")).agg(F.max_by("value", "date").alias("value"))


def label_shift(df: DataFrame, weeks: int) -> DataFrame:
    return df.withColumn("date", F.date_add("date", 7 * weeks))


def regularise(df: DataFrame, keys: Keys, unit: str = "month") -> DataFrame:
    """A row for each period from the first to the last one with a value; missing periods have null."""
    span = df.filter("value is not null").groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select(*keys, F.explode(F.expr(f"sequence(lo, hi, {STEP[unit]})")).alias("date"))
    return grid.join(df, [*keys, "date"], "left")


def calendar_gaps(df: DataFrame, keys: Keys, unit: str = "month") -> DataFrame:
    return regularise(df, keys, unit).filter("value is null").select(*keys, "date")


def semester_expand(df: DataFrame, keys: Keys, until: str, valid: int = 6, warn: int = 6, error: int = 12) -> DataFrame:
    """Half-yearly values by month: valid for six months, then carried on to ``until``, with how far and a status."""
    monthly = df.groupBy(*keys).agg(F.min("date").alias("lo")).select(*keys, F.explode(F.expr(f"sequence(lo, date'{until}', interval 1 month)")).alias("date"))
    w = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    seen = monthly.join(df.withColumn("source", F.col("date")), [*keys, "date"], "left")
    held = seen.withColumn("source", F.last("source", True).over(w)).withColumn("value", F.last("value", True).over(w))
    carried = F.greatest(F.lit(0), F.months_between("date", "source").cast("int") - (valid - 1))
    status = F.when(F.col("carried") > error, "error").when(F.col("carried") > warn, "warn").otherwise("ok")
    return held.withColumn("carried", carried).withColumn("status", status).drop("source")


def forward_fill(df: DataFrame, keys: Keys, dates: DataFrame) -> DataFrame:
    """Values on ``dates`` (keys, date): the last at or before each."""
    grid = dates.select(*keys, "date").unionByName(df.select(*keys, "date")).distinct()
    w = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(df, [*keys, "date"], "left").withColumn("value", F.last("value", True).over(w))
    return filled.join(dates.select(*keys, "date"), [*keys, "date"], "left_semi")


def interpolate_interior(df: DataFrame, keys: Keys) -> DataFrame:
    """Gaps between values filled in proportion to the days; the edges stay null."""
    before, after = by(keys).rowsBetween(Window.unboundedPreceding, -1), by(keys).rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("date"))
    marked = df.select("*", F.last(at, True).over(before).alias("d0"), F.last("value", True).over(before).alias("v0"), F.first(at, True).over(after).alias("d1"), F.first("value", True).over(after).alias("v1"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * F.datediff("date", "d0") / F.datediff("d1", "d0")
    return marked.withColumn("value", F.coalesce("value", line)).drop("d0", "v0", "d1", "v1")


def change(df: DataFrame, keys: Keys, lag: int = 1, kind: str = "diff", name: str = "change") -> DataFrame:
    """Difference, log difference or percentage growth over ``lag`` rows of a regular calendar."""
    old = F.lag("value", lag).over(by(keys))
    made = {"diff": F.col("value") - old, "logdiff": F.log("value") - F.log(old), "pct": 100 * (F.col("value") / old - 1)}[kind]
    return df.withColumn(name, made)


def growth_over(df: DataFrame, keys: Keys, months: int = 12) -> DataFrame:
    """Percentage growth over so many months, of dates that have a value then; gaps in the calendar do no harm."""
    old = df.select(*keys, F.add_months("date", months).alias("date"), F.col("value").alias("old"))
    return df.join(old, [*keys, "date"]).withColumn("growth", 100 * (F.col("value") / F.col("old") - 1)).drop("old")


def mondays(month: Column) -> Column:
    """How many Mondays a month (its first day) has."""
    first = F.next_day(F.date_sub(month, 1), "Mon")
    return (F.floor(F.datediff(F.last_day(month), first) / 7) + 1).cast("int")


def complete_month_mean(df: DataFrame, keys: Keys) -> DataFrame:
    """Monthly means of weekly values (dated by Mondays) of months that have all their Mondays."""
    monthly = df.groupBy(*keys, F.trunc("date", "month").alias("date")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return monthly.withColumn("expected", mondays(F.col("date"))).filter("n = expected")


def stitched_months(history: DataFrame, paths: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, date, value: monthly means of each draw's weeks, observed ones before its path's first week and its own from there on;
    months that lack a Monday have none. ValueError names weeks inside that neither has: none is filled."""
    first = paths.groupBy(*keys).agg(F.min("date").alias("first"))
    past = history.filter("value is not null").join(first, list(keys)).filter(F.col("date") < F.col("first")).select(*keys, "date", "value")
    w = Window.partitionBy(*keys).orderBy("date")
    weeks = past.select(*keys, "date").unionByName(paths.filter("value is not null").select(*keys, "date")).distinct().withColumn("before", F.lag("date").over(w))
    gaps = weeks.filter(F.datediff("date", "before") > 7).select(*keys, "before", "date").limit(5).collect()
    if gaps:
        raise ValueError(f"weeks lack values between {[(str(r['before']), str(r['date'])) for r in gaps]}")
    whole = past.join(paths.select(*keys, "draw").distinct(), list(keys)).select(*keys, "draw", "date", "value").unionByName(paths.select(*keys, "draw", "date", "value"))
    return complete_month_mean(whole, [*keys, "draw"]).select(*keys, "draw", "date", "value")


def period_coverage(df: DataFrame, keys: Keys, unit: str = "month", trailing: int = 24, least: float = 0.8) -> DataFrame:
    """The last period's observations against the median of the ``trailing`` periods before it."""
    counts = df.filter("value is not null").groupBy(*keys, F.trunc("date", unit).alias("period")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period"))))
    last = ranked.filter("back = 1").select(*keys, "period", "n")
    expected = ranked.filter(f"back between 2 and {trailing + 1}").groupBy(*keys).agg(F.greatest(F.bround(F.percentile("n", 0.5)), F.lit(1.0)).alias("expected"))
    out = last.join(expected, list(keys), "left").withColumn("ratio", F.col("n") / F.col("expected"))
    return out.withColumn("complete", F.coalesce(F.col("ratio") >= least, F.lit(False)))


def partial_estimate(n: Column, k: Column, mean: Column, last: Column, variance: Column) -> tuple[Column, Column]:
    """Mean and variance of a period of n observations of which k are known, if the rest follow a random walk.

    mean = (k * mean so far + (n - k) * last) / n; variance = variance / n^2 * (1^2 + ... + (n - k)^2).
    """
    m = n - k
    return (k * mean + m * last) / n, F.when(m == 0, 0.0).otherwise(variance / (n * n) * (m * (m + 1) * (2 * m + 1) / 6))


def mask_partial(df: DataFrame, keys: Keys, coverage: DataFrame) -> DataFrame:
    """Null instead of the value of a last period that is not complete."""
    bad = coverage.filter(~F.col("complete")).select(*keys, F.col("period").alias("date"), F.lit(True).alias("bad"))
    return df.join(bad, [*keys, "date"], "left").withColumn("value", F.when(F.col("bad").isNull(), F.col("value"))).drop("bad")


def segment(date: Column, observed_until: Column, forecast_from: Column) -> Column:
    return F.when(date <= observed_until, "observed").when(date < forecast_from, "nowcast").otherwise("forecast")


def horizons(df: DataFrame, keys: Keys, origin: str, wanted: Sequence[int] = (1, 2, 3, 6, 12), always: int = 3) -> DataFrame:
    """Target months after ``origin``: those up to ``always`` in any case, later ones where the path reaches them."""
    reach = df.groupBy(*keys).agg(F.max("date").alias("end"))
    targets = reach.select(*keys, "end", F.explode(F.array(*[F.lit(h) for h in wanted])).alias("h"))
    targets = targets.withColumn("target", F.add_months(F.lit(origin).cast("date"), F.col("h")))
    return targets.filter((F.col("h") <= always) | (F.col("target") <= F.col("end"))).select(*keys, F.concat(F.lit("M+"), "h").alias("label"), "h", "target")


def rolling_sum(df: DataFrame, keys: Keys, n: int = 12) -> DataFrame:
    """The sum of the last n values; null until there are n."""
    w = by(keys).rowsBetween(1 - n, 0)
    return df.withColumn("rolled", F.when(F.count("value").over(w) == n, F.sum("value").over(w)))


def backward_splice(primary: DataFrame, proxy: DataFrame, keys: Keys) -> DataFrame:
    """Before its first observation, the primary series goes on backwards by the proxy, scaled at their first common date."""
    both = primary.withColumnRenamed("value", "own").join(proxy.withColumnRenamed("value", "proxy"), [*keys, "date"], "full")
    first = both.filter("own is not null").groupBy(*keys).agg(F.min("date").alias("start"))
    anchor = both.filter("own is not null and proxy is not null").groupBy(*keys).agg(F.min_by(F.col("own") / F.col("proxy"), "date").alias("ratio"))
    joined = both.join(first, list(keys), "left").join(anchor, list(keys), "left")
    value = F.when(F.col("date") < F.col("start"), F.col("proxy") * F.col("ratio")).otherwise(F.col("own"))
    return joined.select(*keys, "date", value.alias("value")).filter("value is not null")


def growth_reanchor(path: DataFrame, keys: Keys, anchor: Column) -> DataFrame:
    """Levels that begin at ``anchor`` and grow each period as the path does."""
    growth = F.log(F.col("value") / F.lag("value").over(by(keys)))
    total = F.sum(F.coalesce("g", F.lit(0.0))).over(by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return path.withColumn("g", growth).withColumn("level", anchor * F.exp(total)).drop("g")


def carry_edge(df: DataFrame, keys: Keys) -> DataFrame:
    """Nulls after a series' last value become that value; gaps within stay."""
    last = Window.partitionBy(*keys)
    marked = df.withColumn("edge", F.max(F.when(F.col("value").isNotNull(), F.col("date"))).over(last))
    held = F.last("value", True).over(by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("held", held).withColumn("value", F.when(F.col("date") > F.col("edge"), F.col("held")).otherwise(F.col("value"))).drop("edge", "held")
