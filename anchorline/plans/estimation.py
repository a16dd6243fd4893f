"""Queries of model choice, conditional forecasts and replicated panels; SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.operators import fans as A
from anchorline.operators import models as M
from anchorline.operators import scenarios as N
from anchorline.operators import search as G
from anchorline.operators import structural as T
from anchorline.plans import posteriors as P
from anchorline.plans import proxies as X
from anchorline.plans.queries import DLOG, IRF, MP, dlog, model_panel, query, r, responses
from anchorline.session import workspace

KEYS = ["model_id"]
_CO = "co AS (SELECT e.series AS equation, v.variable, v.lag, (length(e.series) * 3 + length(v.variable) * 5 + v.lag * 7) % 11 / 100.0 - 0.05 AS b FROM (SELECT DISTINCT series FROM mp) e, (SELECT DISTINCT variable, lag FROM dx) v)"
_RES = f"{X.INDEX}, {DLOG}, {MP}, {_CO}, fi AS (SELECT date, equation, sum(x * b) AS m FROM dx JOIN co ON co.variable = dx.variable AND co.lag = dx.lag GROUP BY ALL), re AS (SELECT fi.date, equation, value - m AS e FROM fi JOIN mp ON mp.series = equation AND mp.date = fi.date)"


def given_coefficients(panel):
    """Coefficients made by arithmetic of names and lags."""
    names = panel.select("model_id", F.col("series").alias("variable")).distinct()
    terms = names.withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2)))).unionByName(names.select("model_id").distinct().select("model_id", F.lit("const").alias("variable"), F.lit(0).alias("lag")))
    b = (F.length("equation") * 3 + F.length("variable") * 5 + F.col("lag") * 7) % 11 / 100.0 - 0.05
    return names.withColumnRenamed("variable", "equation").join(terms, "model_id").withColumn("b", b)


@query(f"WITH {_RES} SELECT 'm' AS model_id, a.equation, b.equation AS other, {r('covar_samp(a.e, b.e)', 4)} AS covariance FROM re a JOIN re b ON b.date = a.date GROUP BY ALL", digits=4)
def residual_covariance(s, d):
    panel = model_panel(s, d)
    return G.residual_covariance(G.residuals(panel, given_coefficients(panel), KEYS, 2), KEYS)


@query(f"WITH {IRF}, f AS (SELECT draw, shock, value AS first FROM irf WHERE h = 0 AND response = 'ASIA') SELECT irf.draw, response, irf.shock, h, {r('value')} AS value, CASE WHEN first <> 0 THEN {r('value / first')} END AS unit FROM irf JOIN f ON f.draw = irf.draw AND f.shock = irf.shock")
def irf_normalised(s, d):
    return G.normalised(responses(s, d), ["draw"], "ASIA")


@query(f"WITH {X.INDEX}, {DLOG}, sl AS (SELECT series, date, 100 * value AS y, lag(100 * value, 1) OVER (PARTITION BY series ORDER BY date) AS x, lag(100 * value, 3) OVER (PARTITION BY series ORDER BY date) AS x3 FROM dl), g AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM sl WHERE x3 IS NOT NULL GROUP BY 1) SELECT 'm' AS model_id, series AS equation, series AS variable, 1 AS lag, {r('b')} AS b FROM g UNION ALL SELECT 'm', series, 'const', 0, {r('a')} FROM g")
def sparse_lag_fit(s, d):
    """Each series on its own first lag and a constant, on the dates that three lags leave."""
    panel = model_panel(s, d)
    names = panel.select("series").distinct()
    own = names.select(F.col("series").alias("equation"), F.col("series").alias("variable"), F.lit(1).alias("lag"))
    terms = own.unionByName(names.select(F.col("series").alias("equation"), F.lit("const").alias("variable"), F.lit(0).alias("lag")))
    return G.sparse_fit(panel, KEYS, terms, 3)


@query()
def lag_comparison(s, d):
    return G.lag_comparison(model_panel(s, d), KEYS, (1, 2, 3))


@query()
def stationarity(s, d):
    level, change = X.index(s, d).withColumn("kind", F.lit("level")), dlog(s, d).select("series", "date", "value", F.lit("change").alias("kind"))
    return G.stationarity(level.select("series", "date", "value", "kind").unionByName(change), ["kind", "series"])


@query()
def prior_search(s, d):
    panel = X.line_changes(s, d)
    grid = s.createDataFrame([(0.1, 0.5), (0.4, 0.5)], "own double, cross double")
    ends = panel.groupBy("model_id").agg(F.max("date").alias("end"))
    origins = ends.select("model_id", F.explode(F.array(F.add_months("end", -12), F.add_months("end", -6))).alias("origin"))
    return G.prior_search(panel, KEYS, grid, origins, 1, 3, 40, 20, 5)


@query()
def completed_levels(s, d):
    """Log levels of which every seventh month of a series, and two series' last months, are missing: what the draws hold there."""
    return A.fan(M.completed(P.gapped_levels(s, d), P.gapped(s, d), KEYS), ["model_id", "series", "date"])


@query()
def conditional_forecast(s, d):
    """Each draw's path with one series' first three changes given, against the same draw's path without."""
    draws, panel = P.structural(s, d), X.line_changes(s, d)
    tail = P.ends(s, d)
    asked = panel.select("model_id").distinct().select("model_id", F.lit("N").alias("series"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("h"), F.lit(2.0).alias("value"))
    leg = lambda conditions, name: M.simulate(draws, tail, KEYS, 6, 7, conditions).withColumnRenamed("value", name)
    pairs = leg(None, "baseline").join(leg(asked, "scenario"), [*KEYS, "draw", "h", "series"])
    return N.pair_effect(pairs, ["model_id", "series", "h"])


@query()
def sign_restricted(s, d):
    impacts = M.sign_restricted_impacts(P.structural(s, d), KEYS, {("N", "N"): 1, ("A", "N"): 1}, 100, 3)
    return A.fan(impacts, ["model_id", "response", "shock"])


@query()
def replicated_statistics(s, d):
    panel, draws = X.line_changes(s, d), P.structural(s, d)
    whole = T.panels_of(draws, panel, KEYS).filter("draw = 0").drop("draw")
    return M.replicated_statistics(M.replicated(draws, whole, KEYS, 5), panel, KEYS)


@query()
def prior_blocks(s, d):
    """Each model's prior, searched by blocks and confirmed with more effort: the last stage's candidates in order."""
    blocks = {"minnesota": {"own": (0.1, 0.4)}, "outliers": {"outlier_years": (2.0, 8.0)}}
    stages = (G.Stage("screen", 12, 8, 1), G.Stage("confirm", 20, 10, 1, 3, 1))
    found = G.block_search(X.line_changes(s, d), KEYS, blocks, stages, workspace(s, "prior-search"), 1, 3, 5)
    return found.ranking.select("model_id", "own", "outlier_years", "crps", "rmse", "mae", "scores", "origins", "failures", "is_base", "crps_vs_base", "place")
