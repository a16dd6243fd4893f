"""Choosing among models: residual covariances, lag lengths, sparse regressions, stationarity tests, searches of priors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators import models as M
from anchorline.operators.stats import crps

Keys = Sequence[str]


def residuals(panel: DataFrame, coefficients: DataFrame, keys: Keys, lags: int) -> DataFrame:
    """keys..., date, equation, value: what the one-step mean leaves."""
    mean = M.fitted(panel, coefficients, keys, lags).withColumnRenamed("value", "mean")
    seen = panel.select(*keys, "date", F.col("series").alias("equation"), "value")
    return seen.join(mean, [*keys, "date", "equation"]).select(*keys, "date", "equation", (F.col("value") - F.col("mean")).alias("value"))


def residual_covariance(rest: DataFrame, keys: Keys) -> DataFrame:
    """keys..., equation, other, covariance (over n - 1, about the mean) of all pairs of equations.

    A date's residuals are one array, so its pairs are made in one row; there are as many pairs as a covariance matrix has.
    """
    row = F.collect_list(F.struct("equation", "value"))
    pairs = F.flatten(F.transform("row", lambda a: F.transform("row", lambda b: F.struct(a["equation"].alias("equation"), b["equation"].alias("other"), a["value"].alias("x"), b["value"].alias("y")))))
    made = rest.groupBy(*keys, "date").agg(row.alias("row")).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return made.groupBy(*keys, "equation", "other").agg(F.covar_samp("x", "y").alias("covariance"))


def normalised(irf: DataFrame, keys: Keys, own: str) -> DataFrame:
    """Responses scaled so that the response ``own`` moves by 1 at once, in place of a shock of one standard deviation."""
    first = F.max(F.when((F.col("h") == 0) & (F.col("response") == own), F.col("value"))).over(Window.partitionBy(*keys, "shock"))
    return irf.withColumn("unit", F.try_divide(F.col("value"), first))


def lag_comparison(panel: DataFrame, keys: Keys, lags: Sequence[int]) -> DataFrame:
    """keys..., lag, n, log_det, aic, bic: information criteria of the least-squares fits of several lag lengths, on the dates that
    the longest leaves to all."""
    longest = max(lags)
    kinds = dict(panel.dtypes)
    usable = panel.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "series").orderBy("date"))).filter(F.col("_k") > longest)
    dates = usable.select(*keys, "date").distinct()

    def criteria(frame: pd.DataFrame) -> pd.DataFrame:
        e = frame.pivot(index="date", columns="equation", values="value").dropna().to_numpy(float)
        n, m = e.shape
        lag = int(frame["lag"].iat[0])
        log_det = float(np.linalg.slogdet(e.T @ e / n)[1])
        free = m * (m * lag + 1)
        return pd.DataFrame({**{k: [frame[k].iat[0]] for k in keys}, "lag": [lag], "n": [n], "log_det": [log_det], "aic": [log_det + 2 * free / n], "bic": [log_det + np.log(n) * free / n]})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "lag int, n long, log_det double, aic double, bic double"])
    rest = None
    for lag in lags:
        # Each fit sees the same outcomes: those of the longest one, with their own lags before them.
        own = panel.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "series").orderBy("date"))).filter(F.col("_k") > longest - lag).drop("_k")
        part = residuals(own, M.fit(own, keys, lag), keys, lag).join(dates, [*keys, "date"], "left_semi").withColumn("lag", F.lit(lag))
        rest = part if rest is None else rest.unionByName(part)
    return rest.groupBy(*keys, "lag").applyInPandas(criteria, schema)


def sparse_fit(panel: DataFrame, keys: Keys, terms: DataFrame, lags: int) -> DataFrame:
    """keys..., equation, variable, lag, b: least squares of each equation on its own terms (equation, variable, lag) alone.

    ``const`` of lag 0 is the intercept. Dates that lack a regressor of the longest lag are left out.
    """
    name = F.concat_ws("|", "variable", F.col("lag").cast("string"))
    wanted = M.design(panel, keys, lags).join(terms, ["variable", "lag"]).select(*keys, "equation", "date", name.alias("name"), "x")
    y = panel.filter("value is not null").select(*keys, F.col("series").alias("equation"), "date", F.col("value").alias("y"))
    kinds = dict(panel.dtypes)

    def products(row: Column) -> Column:
        return F.flatten(F.transform(row, lambda a: F.concat(F.transform(row, lambda b: F.struct(a["name"].alias("name"), b["name"].alias("other"), (a["x"] * b["x"]).alias("s"))), F.array(F.struct(a["name"].alias("name"), F.lit("y").alias("other"), (a["x"] * F.col("y")).alias("s"))))))

    rows = wanted.join(y, [*keys, "equation", "date"]).groupBy(*keys, "equation", "date", "y").agg(F.collect_list(F.struct("name", "x")).alias("row"))
    rows = rows.withColumn("most", F.max(F.size("row")).over(Window.partitionBy(*keys, "equation"))).filter("size(row) = most")
    sums = rows.select(*keys, "equation", F.explode(products(F.col("row"))).alias("p")).groupBy(*keys, "equation", "p.name", "p.other").agg(F.sum("p.s").alias("s"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="name", columns="other", values="s")
        b = np.linalg.solve(wide[list(wide.index)].to_numpy(float), wide["y"].to_numpy(float))
        split = [n.rsplit("|", 1) for n in wide.index]
        return pd.DataFrame({**{k: frame[k].iat[0] for k in [*keys, "equation"]}, "variable": [v for v, _ in split], "lag": [int(n) for _, n in split], "b": b})

    return sums.groupBy(*keys, "equation").applyInPandas(solve, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "equation string, variable string, lag int, b double"]))


# Critical values at 5 % of a unit root test with a constant, and of a test of stationarity about a level.
ADF_5, KPSS_5 = -2.86, 0.463


def stationarity(panel: DataFrame, keys: Keys) -> DataFrame:
    """keys..., n, lag, adf, adf_rejects, kpss, kpss_rejects of each series.

    The augmented Dickey-Fuller statistic has the number of lagged changes of least AIC; the KPSS one a Bartlett window of
    4 (n / 100)^(1/4) lags.
    """
    kinds = dict(panel.dtypes)

    def tests(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("date")["value"].dropna().to_numpy(float)
        n = len(x)
        dx, most = np.diff(x), int(min(12 * (n / 100) ** 0.25, n // 2 - 3))
        best = None
        for lag in range(most + 1):
            # All lengths are compared on the same outcomes.
            y = dx[most:]
            z = np.column_stack([x[most:-1], *[dx[most - k : len(dx) - k] for k in range(1, lag + 1)], np.ones(len(y))])
            b, *_ = np.linalg.lstsq(z, y, rcond=None)
            e = y - z @ b
            aic = len(y) * np.log(max(float(e @ e), 1e-300) / len(y)) + 2 * z.shape[1]
            if best is None or aic < best[0]:
                sd = np.sqrt(float(e @ e) / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)[0, 0])
                best = (aic, lag, float(b[0] / max(sd, 1e-300)))
        c = x - x.mean()
        window = int(4 * (n / 100) ** 0.25)
        spread = float(c @ c) / n + 2 * sum((1 - k / (window + 1)) * float(c[k:] @ c[:-k]) / n for k in range(1, window + 1))
        kpss = float((np.cumsum(c) ** 2).sum()) / n**2 / max(spread, 1e-300)
        return pd.DataFrame({**{k: [frame[k].iat[0]] for k in keys}, "n": [n], "lag": [best[1]], "adf": [best[2]], "adf_rejects": [best[2] < ADF_5], "kpss": [kpss], "kpss_rejects": [kpss > KPSS_5]})

    return panel.groupBy(*keys).applyInPandas(tests, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n long, lag int, adf double, adf_rejects boolean, kpss double, kpss_rejects boolean"]))


def prior_search(panel: DataFrame, keys: Keys, grid: DataFrame, origins: DataFrame, lags: int, horizon: int, draws: int, burn: int, seed: int) -> DataFrame:
    """keys..., own, cross, crps, n, place: priors in the order of their forecasts' mean CRPS over the origins (keys..., origin).

    Every prior and origin is a model of its own, fitted to what lies up to the origin, so the search is one grouped job.
    """
    cases = origins.join(grid.select("own", "cross"), F.lit(True))
    cases = cases.withColumn("case", F.concat_ws("|", F.col("origin").cast("string"), F.col("own").cast("string"), F.col("cross").cast("string")))
    by = [*keys, "case"]
    seen = panel.join(cases, list(keys)).filter(F.col("date") <= F.col("origin"))
    fitted = M.gibbs(seen.select(*by, "series", "date", "value", "own", "cross"), by, lags, draws, burn, seed)
    # Dates that lack a value have none of their own; the last whole ones lead on.
    whole = seen.filter("value is not null").withColumn("n", F.count("*").over(Window.partitionBy(*by, "date"))).withColumn("all", F.max("n").over(Window.partitionBy(*by))).filter("n = all")
    paths = M.simulate(fitted, M.tail_of(whole, by, lags), by, horizon, seed)
    ahead = panel.join(cases, list(keys)).filter(F.col("date") > F.col("origin"))
    ahead = ahead.withColumn("h", F.row_number().over(Window.partitionBy(*by, "series").orderBy("date"))).select(*by, "series", "h", F.col("value").alias("outcome"))
    scored = crps(paths.join(ahead, [*by, "series", "h"]), [*by, "series", "h"]).join(cases.select(*by, "own", "cross"), by)
    mean = scored.groupBy(*keys, "own", "cross").agg(F.avg("crps").alias("crps"), F.count("*").alias("n"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("crps", "own", "cross")))


class Stage(NamedTuple):
    """How much a stage of a search spends on a candidate: draws and sweeps before them, origins and months between them; and how many
    candidates of a model come from the stage before."""

    name: str
    draws: int
    burn: int
    origins: int
    step: int = 1
    shortlist: int = 3


class Found(NamedTuple):
    ranking: DataFrame  # keys..., parameters, place, and the last stage's figures
    fits: int  # models that had to be fitted: those without scores


PARAMETERS = tuple(M.PRIOR)


def signature(keys: Keys, stage: Stage, lags: int, horizon: int, seed: int) -> Column:
    """What tells a fit from others: model, prior, origin, effort and seed. Numbers are written at nine places."""
    prior = [F.concat(F.lit(f"{p}="), F.format_string("%.9f", F.col(p))) for p in PARAMETERS]
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("origin").cast("string"), *prior, F.lit(f"{stage.draws}/{stage.burn}/{lags}/{horizon}/{seed}")), 256)


def origins_of(panel: DataFrame, keys: Keys, stage: Stage, horizon: int, least: int) -> DataFrame:
    """keys..., origin: dates, ``step`` apart, from the last one after which the horizon is known back; ``least`` dates are before each."""
    w = Window.partitionBy(*keys)
    dates = panel.select(*keys, "date").distinct().withColumns({"back": F.row_number().over(w.orderBy(F.desc("date"))) - 1 - horizon, "before": F.row_number().over(w.orderBy("date"))})
    on = (F.col("back") >= 0) & (F.col("back") % stage.step == 0) & (F.col("back") < stage.step * stage.origins) & (F.col("before") > least)
    return dates.filter(on).select(*keys, F.col("date").alias("origin"))


def scored_fits(panel: DataFrame, keys: Keys, todo: DataFrame, stage: Stage, lags: int, horizon: int, seed: int, target: str | None) -> DataFrame:
    """A row for each fit, series and month ahead, or for a fit that failed: signature, keys..., parameters, origin, stage, h, series, crps,
    error, sd, problem. Every fit is a group of its own, on the data up to its origin."""
    by = [*keys, "signature"]
    seen = panel.join(todo, list(keys)).filter(F.col("date") <= F.col("origin"))
    fitted = M.gibbs(seen.select(*by, "series", "date", "value", *PARAMETERS), by, lags, stage.draws, stage.burn, seed, failures=True).persist()
    known = seen.filter("value is not null").select(*by, "series", "date", "value")
    drawn = fitted.filter("kind = 'missing'").select(*by, "draw", F.col("equation").alias("series"), F.to_date("variable").alias("date"), F.col("b").alias("value"))
    ends = M.tail_of(fitted.filter("kind = 'phi'").select(*by, "draw").distinct().join(known, by).select(*by, "draw", "series", "date", "value").unionByName(drawn), [*by, "draw"], lags)
    paths = M.simulate(fitted, ends, by, horizon, seed)
    paths = paths if target is None else paths.filter(F.col("series") == target)
    ahead = panel.join(todo.select(*by, "origin"), list(keys)).withColumn("h", F.months_between("date", "origin").cast("int")).filter((F.col("h") > 0) & (F.col("h") <= horizon) & F.col("value").isNotNull())
    both = paths.join(ahead.select(*by, "series", "h", F.col("value").alias("outcome")), [*by, "series", "h"])
    points = both.groupBy(*by, "series", "h").agg((F.avg("value") - F.first("outcome")).alias("error"), F.stddev_samp("value").alias("sd"))
    scores = crps(both, [*by, "series", "h"]).join(points, [*by, "series", "h"]).select(*by, "series", "h", "crps", "error", "sd", F.lit(None).cast("string").alias("problem"))
    blank = {"series": "string", "h": "int", "crps": "double", "error": "double", "sd": "double"}
    failed = fitted.filter("kind = 'error'").select(*by, *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], F.col("variable").alias("problem"))
    return scores.unionByName(failed).join(todo, by).withColumn("stage", F.lit(stage.name))


def ranked(scores: DataFrame, keys: Keys, base: dict[str, float]) -> DataFrame:
    """keys..., parameters, crps, rmse, mae, sd, scores, origins, failures, is_base, crps_vs_base, rmse_vs_base, place: candidates in the order of
    their mean CRPS; those that never succeeded come last."""
    by = [*keys, *PARAMETERS]
    ok = F.col("problem").isNull()
    sums = scores.groupBy(*by).agg(
        F.avg("crps").alias("crps"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae"), F.avg("sd").alias("sd"), F.count("crps").alias("scores"),
        F.count_distinct(F.when(ok, F.col("origin"))).alias("origins"), F.count_distinct(F.when(~ok, F.col("origin"))).alias("failures"),
    )
    is_base = F.lit(True)
    for p in PARAMETERS:
        is_base = is_base & (F.abs(F.col(p) - base[p]) < 1e-9)
    whole = Window.partitionBy(*keys)
    of_base = lambda c: F.max(F.when(F.col("is_base"), F.col(c))).over(whole)
    made = sums.withColumn("is_base", is_base).withColumns({f"{c}_vs_base": 100 * (F.col(c) / of_base(c) - 1) for c in ("crps", "rmse")})
    return made.withColumn("place", F.row_number().over(whole.orderBy(F.col("crps").asc_nulls_last(), "rmse", "failures", *PARAMETERS)))


def block_search(panel: DataFrame, keys: Keys, blocks: dict[str, dict[str, Sequence[float]]], stages: Sequence[Stage], root: str, lags: int, horizon: int, seed: int, target: str | None = None, base: dict[str, float] | None = None, least: int = 24) -> Found:
    """Search each model's prior a block of parameters at a time, then score its best candidates again with more effort.

    The first stage goes through ``blocks`` in turn: all values of a block, the other parameters at the best so far. Each later stage
    takes the best candidates of the one before, and the base. All scores are rows of the table ``root``/scores, so what has been
    scored, in this run or one before, is not fitted again, and a search that was broken off goes on where it was.
    """
    spark = panel.sparkSession
    path, own_path, base = f"{root}/scores", f"{root}/run-{uuid4().hex}", M.PRIOR | (base or {})
    kinds = dict(panel.dtypes)
    schema = ", ".join(["signature string", *[f"{k} {kinds[k]}" for k in keys], *[f"{p} double" for p in PARAMETERS], "origin date, series string, h int, crps double, error double, sd double, problem string, stage string"])
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    columns = [c.split()[0] for c in schema.split(", ")]
    fits = 0

    def scores() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    def run(candidates: DataFrame, stage: Stage, step: str) -> DataFrame:
        """The ranking of ``candidates`` (keys..., parameters), of which those are fitted that have no scores."""
        nonlocal fits
        cases = candidates.join(origins_of(panel, keys, stage, horizon, least), list(keys)).withColumn("signature", signature(keys, stage, lags, horizon, seed))
        cases.write.mode("overwrite").parquet(f"{own_path}/cases-{step}")
        cases = spark.read.parquet(f"{own_path}/cases-{step}")
        todo = cases.join(scores().select("signature").distinct(), "signature", "left_anti")
        if n := todo.count():
            fits += n
            scored_fits(panel, keys, todo, stage, lags, horizon, seed, target).select(columns).write.mode("append").parquet(path)
        # A row for each model, candidate, origin, series and month.
        out = ranked(scores().join(cases.select("signature").distinct(), "signature", "left_semi"), keys, base)
        out.write.mode("overwrite").parquet(f"{own_path}/ranking-{step}")
        return spark.read.parquet(f"{own_path}/ranking-{step}")

    own = panel.select(*keys).distinct().select(*keys, *[F.lit(float(base[p])).alias(p) for p in PARAMETERS])
    best, seen = own, None
    for name, grid in blocks.items():
        # The values of one block, a design of the caller's.
        values = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
        each = F.explode(F.array(*[F.struct(*[F.lit(float(v[p])).alias(p) for p in grid]) for v in values])).alias("v")
        tried = best.select(*keys, *PARAMETERS, each).select(*keys, *[F.col(f"v.{p}").alias(p) if p in grid else F.col(p) for p in PARAMETERS])
        ranking = run(tried.unionByName(best).unionByName(own).distinct(), stages[0], f"{stages[0].name}-{name}")
        best = ranking.filter("place = 1").select(*keys, *PARAMETERS)
        seen = ranking if seen is None else seen.unionByName(ranking)
    for stage in stages[1:]:
        once = seen.groupBy(*keys, *PARAMETERS).agg(F.min("crps").alias("crps"))
        w = Window.partitionBy(*keys).orderBy(F.col("crps").asc_nulls_last(), *PARAMETERS)
        short = once.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= stage.shortlist).select(*keys, *PARAMETERS)
        ranking = seen = run(short.unionByName(own).distinct(), stage, stage.name)
    return Found(ranking, fits)
