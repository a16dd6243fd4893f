"""Statistics of series and draws, as grouped aggregates over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def ols_origin(df: DataFrame, keys: Keys, x: str, y: str, least: int = 6) -> DataFrame:
    """The slope through the origin, from ``least`` pairs or more."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))
    return out.withColumn("slope", F.when(F.col("n") >= least, F.col("slope")))


def proxy_diagnostics(pair: DataFrame, keys: Keys, recent: int = 36) -> DataFrame:
    """How well ``proxy`` follows ``value``: slope, correlation and RMSE of log changes, slope of absolute changes, drift
    and range of the ratio, its variation in the last ``recent`` rows, and whether it passes."""
    w = Window.partitionBy(*keys).orderBy("date")
    ratio = F.col("value") / F.col("proxy")
    made = pair.filter("value > 0 and proxy > 0").select(*keys, "date", "value", "proxy", ratio.alias("ratio"), (F.log("value") - F.log(F.lag("value").over(w))).alias("dy"), (F.log("proxy") - F.log(F.lag("proxy").over(w))).alias("dx"), (F.col("value") - F.lag("value").over(w)).alias("ay"), (F.col("proxy") - F.lag("proxy").over(w)).alias("ax"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date"))).alias("back"))
    late = F.when(F.col("back") <= recent, F.col("ratio"))
    out = made.groupBy(*keys).agg(
        F.count("dx").alias("n"),
        (F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") * F.col("dx"))).alias("beta"),
        F.corr("dx", "dy").alias("corr"),
        F.sqrt(F.avg(F.pow(F.col("dy") - F.col("dx"), 2))).alias("rmse"),
        (F.sum(F.col("ax") * F.col("ay")) / F.sum(F.col("ax") * F.col("ax"))).alias("beta_abs"),
        (F.max_by("ratio", "date") / F.min_by("ratio", "date") - 1).alias("drift"),
        (F.max("ratio") / F.min("ratio") - 1).alias("range"),
        (F.stddev_samp(late) / F.avg(late)).alias("recent_cv"),
    )
    return out.withColumn("passes", (F.col("corr") >= 0.5) & (F.abs(F.col("beta") - 1) <= 0.5))


def mapping_check(df: DataFrame, keys: Keys) -> DataFrame:
    """Correlation of log changes of ``value`` with its own candidate and with the other, and by how much the own one leads."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = lambda c: F.log(c) - F.log(F.lag(c).over(w))
    made = df.select(*keys, d("value").alias("y"), d("own").alias("a"), d("cross").alias("b"))
    out = made.groupBy(*keys).agg(F.corr("y", "a").alias("own_corr"), F.corr("y", "b").alias("cross_corr"))
    margin = F.col("own_corr") - F.col("cross_corr")
    return out.withColumn("margin", margin).withColumn("status", F.when(F.col("margin") > 0, "ok").otherwise("swapped"))


def error_summary(df: DataFrame, keys: Keys, tolerance: float) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("error").alias("n"), F.max(F.abs("error")).alias("max_abs"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return out.withColumn("status", F.when(F.col("max_abs") <= tolerance, "pass").otherwise("watch"))


def missingness(df: DataFrame, keys: Keys) -> DataFrame:
    """Of a regular calendar: observations, first and last, gaps at the edges and within, coverage."""
    seen = F.when(F.col("value").isNotNull(), F.col("date"))
    marked = df.withColumn("lo", F.min(seen).over(Window.partitionBy(*keys))).withColumn("hi", F.max(seen).over(Window.partitionBy(*keys)))
    null = F.col("value").isNull()
    return marked.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.min("lo").alias("first"),
        F.max("hi").alias("last"),
        F.count_if(null & (F.col("date") > F.col("lo")) & (F.col("date") < F.col("hi"))).alias("internal_gaps"),
        F.count_if(null & (F.col("date") < F.col("lo"))).alias("leading"),
        F.count_if(null & (F.col("date") > F.col("hi"))).alias("trailing"),
        (100 * F.count("value") / F.count("*")).alias("coverage"),
    )


def residual_diagnostics(df: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Mean, sd, skewness and excess kurtosis corrected for bias, lag-one autocorrelation, largest size."""
    w = Window.partitionBy(*keys).orderBy("date")
    made = df.withColumn("m", F.avg(value).over(Window.partitionBy(*keys))).withColumn("lagged", F.lag(value).over(w))
    n, g1, g2 = F.count(value), F.skewness(value), F.kurtosis(value)
    acf = F.sum((F.col(value) - F.col("m")) * (F.col("lagged") - F.col("m"))) / F.sum(F.pow(F.col(value) - F.col("m"), 2))
    return made.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        (((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        acf.alias("acf1"),
        F.max(F.abs(value)).alias("max_abs"),
    )


def acf(df: DataFrame, keys: Keys, lags: int, order: str = "date") -> DataFrame:
    """Autocorrelations up to a number of lags: products with lagged values over the sum of squares."""
    w = Window.partitionBy(*keys).orderBy(order)
    centred = df.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    made = centred.select(*keys, "c", *[F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, lags + 1)])
    wide = made.groupBy(*keys).agg(*[(F.sum(F.col("c") * F.col(f"c{k}")) / F.sum(F.col("c") * F.col("c"))).alias(str(k)) for k in range(1, lags + 1)])
    return wide.unpivot(list(keys), [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def parameter_summary(draws: DataFrame, keys: Keys) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = draws.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"), F.count("*").alias("n_draws"))
    return out.select(*keys, "mean", F.get("q", F.lit(1)).alias("median"), "sd", F.get("q", F.lit(0)).alias("q05"), F.get("q", F.lit(2)).alias("q95"), "n_draws")


def relative_variance(df: DataFrame, keys: Keys) -> DataFrame:
    """(value / its median)^2, of each key over time."""
    return df.join(df.groupBy(*keys).agg(F.median("value").alias("mid")), list(keys)).withColumn("relative", F.pow(F.col("value") / F.col("mid"), 2)).drop("mid")


def joint_stress(df: DataFrame, keys: Keys) -> DataFrame:
    """date and stress: the geometric mean over keys of the relative variances."""
    return relative_variance(df, keys).groupBy("date").agg(F.exp(F.avg(F.log("relative"))).alias("stress"))


def regime_dates(stress: DataFrame, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """For each quantile of stress the date whose stress is nearest to it in logs, and the date of the peak."""
    q = stress.agg(F.percentile("stress", F.array(*[F.lit(x) for x in quantiles])).alias("q"), F.max("stress").alias("top"))
    targets = q.select(F.explode(F.concat(F.array(*[F.struct(F.lit(f"p{round(100 * x)}").alias("regime"), F.get("q", F.lit(i)).alias("target")) for i, x in enumerate(quantiles)]), F.array(F.struct(F.lit("peak").alias("regime"), F.col("top").alias("target"))))).alias("t")).select("t.*")
    both = stress.crossJoin(F.broadcast(targets)).withColumn("far", F.round(F.abs(F.log("stress") - F.log("target")), 12))
    return both.groupBy("regime").agg(F.min_by("date", F.struct("far", "date")).alias("date"))


def crps(draws: DataFrame, keys: Keys) -> DataFrame:
    """Exact CRPS of the draws (value) against ``outcome``: mean |x - y| - sum of (2i - n - 1) x_(i) / n^2."""
    w = Window.partitionBy(*keys)
    ranked = draws.withColumn("i", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count("*").over(w))
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col("value") - F.col("outcome"))) - F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("value") / (F.col("n") * F.col("n")))).alias("crps"))


def log_score(draws: DataFrame, keys: Keys) -> DataFrame:
    """Log of the kernel density of the draws at ``outcome``; bandwidth 0.9 min(sd, IQR / 1.349) n^(-1/5)."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    wide = draws.groupBy(*keys).agg(F.stddev_samp("value").alias("sd"), q.alias("q"), F.count("*").alias("n"))
    band = wide.select(*keys, "n", (0.9 * F.least(F.col("sd"), (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.349) * F.pow("n", F.lit(-0.2))).alias("h"))
    z = draws.join(band, list(keys)).withColumn("e", -0.5 * F.pow((F.col("outcome") - F.col("value")) / F.col("h"), 2))
    top = z.withColumn("top", F.max("e").over(Window.partitionBy(*keys)))
    return top.groupBy(*keys).agg((F.max("top") + F.log(F.sum(F.exp(F.col("e") - F.col("top")))) - F.log(F.max("n") * F.max("h") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("log_score"))


def ar1_scales(df: DataFrame, keys: Keys) -> DataFrame:
    """Residual sd of an AR(1) with intercept, with n - 2 degrees of freedom."""
    lagged = df.withColumn("x", F.lag("value").over(Window.partitionBy(*keys).orderBy("date"))).filter("x is not null and value is not null")
    s = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("value", "x").alias("phi"), F.regr_syy("value", "x").alias("syy"), F.regr_sxy("value", "x").alias("sxy"))
    return s.select(*keys, "n", "phi", F.sqrt((F.col("syy") - F.col("phi") * F.col("sxy")) / (F.col("n") - 2)).alias("sigma"))


def minnesota_prior(scales: DataFrame, lags: int, own: float = 0.2, cross: float = 0.5, decay: float = 1.0) -> DataFrame:
    """equation, variable, lag, sd: own / lag^decay on a variable's own lags; other ones also by cross and the scales' ratio.

    ``scales`` has a row for each variable of a model, so all its pairs are a small table.
    """
    left, right = scales.select(F.col("series").alias("equation"), F.col("sigma").alias("s_i")), scales.select(F.col("series").alias("variable"), F.col("sigma").alias("s_j"))
    grid = left.crossJoin(right).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    base = F.lit(own) / F.pow("lag", F.lit(decay))
    return grid.select("equation", "variable", "lag", F.when(F.col("equation") == F.col("variable"), base).otherwise(base * cross * F.col("s_i") / F.col("s_j")).alias("sd"))


def projection_sweep(df: DataFrame, keys: Keys) -> DataFrame:
    """Median, 95th, 99th percentile and maximum of errors, and where the maximum stands most often."""
    q = F.percentile("error", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*keys).agg(q.alias("q"), F.max("error").alias("max"), F.max_by("place", F.struct("error", "place")).alias("at"))
    return out.select(*keys, F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95"), F.get("q", F.lit(2)).alias("p99"), "max", "at")


def comparability(df: DataFrame, keys: Keys, windows: Sequence[int] = (12, 24, 36), threshold: float = 0.01) -> DataFrame:
    """Ratio of rebuilt to published: in the last 12, 24 and 36 months its largest drift from its median; null if too short."""
    ratio = df.select(*keys, "date", (F.col("rebuilt") / F.col("value")).alias("ratio")).withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date"))))
    grown = ratio.withColumn("window", F.explode(F.array(*[F.lit(n) for n in windows]))).filter("back <= window")
    mid = grown.groupBy(*keys, "window").agg(F.median("ratio").alias("mid"), F.count("*").alias("n"))
    out = grown.join(mid, [*keys, "window"]).groupBy(*keys, "window").agg(F.max(F.abs(F.col("ratio") / F.col("mid") - 1)).alias("drift"), F.max("n").alias("n"))
    told = F.when(F.col("n") == F.col("window"), F.col("drift"))
    return out.select(*keys, "window", told.alias("drift"), (told > threshold).alias("flagged"))


def additivity_gap(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """date, gap: the sum of the parts' means less the whole's; infinite where a date has no parts."""
    sums = parts.groupBy("date").agg(F.sum("value").alias("parts"))
    return whole.join(sums, "date", "left").select("date", F.coalesce(F.abs(F.col("parts") - F.col("value")), F.lit(float("inf"))).alias("gap"))


def oos_origins(df: DataFrame, keys: Keys, least: int, horizon: int, step: int, most: int) -> DataFrame:
    """The newest ``most`` origins, ``step`` apart, that have ``least`` rows up to them and all horizons realised."""
    w = Window.partitionBy(*keys).orderBy("date")
    n = df.withColumn("i", F.row_number().over(w)).withColumn("ahead", F.lead("value", horizon).over(w))
    able = n.filter((F.col("i") >= least) & F.col("ahead").isNotNull()).withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date"))) - 1)
    return able.filter((F.col("back") % step == 0) & (F.col("back") < step * most)).select(*keys, "date", "i")


def z_score(x: str, keys: Keys) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(x) - F.avg(x).over(w)) / F.stddev_samp(x).over(w)
