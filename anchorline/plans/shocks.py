"""Structural queries: one stored posterior feeds impacts, responses, shares, decompositions and total responses of every model."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.operators import fans as A
from anchorline.operators import models as M
from anchorline.operators import scenarios as N
from anchorline.operators import stats as Z
from anchorline.operators import structural as T
from anchorline.plans import posteriors as P
from anchorline.plans import proxies as X
from anchorline.plans.queries import model_panel, query, r

KEYS, HORIZON = ["model_id"], 12


def irf(s, d, unit=None):
    draws = P.structural(s, d)
    return T.responses(draws, T.impacts_at(draws, KEYS), KEYS, HORIZON, unit)


def parts(s, d):
    return T.decomposition(P.structural(s, d), X.line_changes(s, d), KEYS)


@query()
def structural_impacts(s, d):
    """Regular impacts at the sample's middle, and what outliers make of them."""
    middle = "1996-06-01"
    draws = P.structural(s, d)
    both = T.impacts_at(draws, KEYS, middle).withColumn("outliers", F.lit(False)).unionByName(T.impacts_at(draws, KEYS, middle, True).withColumn("outliers", F.lit(True)))
    return A.fan(both, ["model_id", "outliers", "response", "shock"])


@query()
def structural_irf(s, d):
    return A.fan(irf(s, d), ["model_id", "response", "shock", "h"], A.FAN, "cumulative")


@query(f"WITH {X.MODES} SELECT DISTINCT model_id, CAST(draw AS INTEGER) AS draw, series AS shock, 1.0 AS own FROM modes, (SELECT unnest(range(0, {P.DRAWS})) AS draw)")
def structural_irf_unit(s, d):
    """Of responses to shocks of size one, each series' own at once."""
    return irf(s, d, "own").filter("h = 0 and response = shock").select("model_id", "draw", "shock", F.col("value").alias("own"))


@query()
def structural_fevd(s, d):
    return A.fan(T.variance_shares(irf(s, d), KEYS), ["model_id", "response", "shock", "horizon"], A.FAN, "share")


@query(f"WITH {X.MODES} SELECT DISTINCT model_id, CAST(draw AS INTEGER) AS draw, series AS response, CAST(h AS INTEGER) AS horizon, 1.0 AS total FROM modes, (SELECT unnest(range(0, {P.DRAWS})) AS draw), (SELECT unnest(range(1, {HORIZON} + 2)) AS h)")
def structural_fevd_sums(s, d):
    shares = T.variance_shares(irf(s, d), KEYS)
    return shares.groupBy("model_id", "draw", "response", "horizon").agg(F.sum("share").alias("total"))


@query()
def structural_decomposition(s, d):
    """Mean and bands of each shock's part of each month's change, by what is regular and what outliers amplify."""
    long = parts(s, d).unpivot(["model_id", "draw", "date", "response", "shock"], ["regular", "outlier"], "kind", "value").filter("shock <> 'base' or kind = 'regular'")
    return A.fan(long, ["model_id", "date", "response", "shock", "kind"])


@query(f"WITH {X.MODES} SELECT mch.model_id, CAST(draw AS INTEGER) AS draw, mch.date, series AS response, {r('mch.value', 4)} AS value FROM mch JOIN mstart ON mstart.model_id = mch.model_id, (SELECT unnest(range(0, {P.DRAWS})) AS draw) WHERE mch.date >= mstart.start + INTERVAL {P.LAGS} MONTH", digits=4)
def structural_reconstruction(s, d):
    """Base and shocks' parts of each draw, summed: on observed cells the data."""
    seen = X.line_changes(s, d).filter("value is not null").select("model_id", "date", F.col("series").alias("response"))
    return T.reconstruction(parts(s, d), KEYS).join(seen, ["model_id", "date", "response"]).select("model_id", "draw", "date", "response", "value")


@query(f"WITH {X.MODES} SELECT DISTINCT model_id, CAST({P.DRAWS} AS BIGINT) AS draws, true AS exact FROM modes")
def structural_reconstruction_gaps(s, d):
    return T.reconstruction_gaps(parts(s, d), P.structural(s, d), X.line_changes(s, d), KEYS).select("model_id", "draws", "exact")


@query()
def structural_total_response(s, d):
    """Per cent by which a line number's total moves when a shock comes after the sample, by shock and month."""
    draws = P.structural(s, d)
    levels = X.line_levels(s, d).filter("value is not null")
    start = levels.groupBy("model_id", "series").agg(F.max_by("value", "date").alias("value"))
    weights = X.table(s, d, "lineitem").groupBy(F.concat(F.lit("line "), "l_linenumber").alias("model_id"), F.col("l_returnflag").alias("series")).agg(F.sum("l_quantity").alias("w"))
    quiet = T.quiet_paths(draws, X.line_changes(s, d), KEYS, HORIZON)
    return A.fan(T.total_response(quiet, irf(s, d), start, weights, KEYS), ["model_id", "shock", "h"], A.FAN, "effect")


@query()
def structural_volatility(s, d):
    draws = P.structural(s, d)
    both = T.volatility(draws, KEYS).withColumn("outliers", F.lit(True)).unionByName(T.volatility(draws, KEYS, False).withColumn("outliers", F.lit(False)))
    return A.fan(both, ["model_id", "series", "date", "outliers"], (0.16, 0.5, 0.84))


@query()
def structural_signs(s, d):
    """A decomposition by sign-restricted shocks: each draw's own rotation holds on all dates; how many draws have one, and how exact they are."""
    draws, panel = P.structural(s, d), X.line_changes(s, d)
    names = ["A", "N", "R"]
    impacts = T.sign_impacts_at(draws, KEYS, {(f"shock {k}", n, 0): 1 for k, n in enumerate(names)}, 300, 3, cumulative={("shock 0", names[0], 3): 1})
    return T.reconstruction_gaps(T.decomposition(draws, panel, KEYS, impacts), draws, panel, KEYS).select("model_id", "draws", "exact")


@query()
def structural_roots(s, d):
    draws = P.structural(s, d).filter("kind = 'b' and lag > 0")
    return A.fan(M.root_bands(M.companion_roots(draws, ["model_id", "draw"]), ["model_id", "draw"]), ["model_id", "band"], A.FAN, "modulus")


@query(f"WITH {X.MODES}, cells AS (SELECT DISTINCT model_id, series FROM modes) SELECT model_id, series, CAST(40 AS BIGINT) AS draws, true AS passed FROM cells")
def projection_gates(s, d):
    """Whether in every draw the smoother met what is observed of each series of models with gaps."""
    told = T.gates(P.gapped(s, d), KEYS, M.LEVEL_GATE)
    return told.groupBy("model_id", "series").agg(F.count("*").alias("draws"), F.bool_and("passed").alias("passed"))


@query()
def projection_errors(s, d):
    """In billionths of a billionth, and the month at which the largest error of a draw is most often."""
    told = T.gates(P.gapped(s, d), KEYS, M.LEVEL_GATE)
    of = lambda c: 1e18 * F.col(c)
    return told.groupBy("model_id", "series").agg(F.max(of("error")).alias("largest"), F.percentile(of("error"), 0.99).alias("p99"), F.max(of("adjustment")).alias("adjustment"), F.mode("at", True).alias("at"))


HD = f"(SELECT model_id, series, count(*) AS months FROM (SELECT m.model_id, m.series, unnest(generate_series(start + INTERVAL {P.LAGS} MONTH, hi, INTERVAL 1 MONTH)) AS date FROM (SELECT DISTINCT model_id, series FROM modes) m JOIN mstart ON mstart.model_id = m.model_id JOIN (SELECT model_id, max(date) AS hi FROM modes GROUP BY 1) e ON e.model_id = m.model_id) GROUP BY 1, 2)"


@query(f"WITH {X.MODES}, hd AS {HD}, n AS (SELECT model_id, count(*) AS n, max(months) AS months FROM hd GROUP BY 1) SELECT model_id, 'structural_volatility' AS record_type, n * months AS rows FROM n UNION ALL SELECT model_id, 'structural_irf', n * n * {HORIZON + 1} FROM n UNION ALL SELECT model_id, 'structural_fevd', n * n * {HORIZON + 1} FROM n UNION ALL SELECT model_id, 'structural_hd', n * (2 * n + 1) * months FROM n UNION ALL SELECT model_id, 'structural_total', n * {HORIZON + 1} FROM n")
def structural_jobs(s, d):
    """All structural jobs of the models as records of one table: how many of each type."""
    return records(s, d).groupBy("model_id", "record_type").agg(F.count("*").alias("rows"))


def records(s, d):
    """model_id, record_type, key (what the record is of), date or h, and the fan."""
    fans = {"structural_volatility": structural_volatility(s, d).filter("outliers"), "structural_irf": structural_irf(s, d), "structural_fevd": structural_fevd(s, d), "structural_hd": structural_decomposition(s, d), "structural_total": structural_total_response(s, d)}
    out = None
    for kind, df in fans.items():
        key = F.concat_ws("|", *[c for c in ("series", "response", "shock", "kind") if c in df.columns])
        step = F.col("h") if "h" in df.columns else F.col("horizon") - 1 if "horizon" in df.columns else F.lit(None).cast("int")
        part = df.select("model_id", F.lit(kind).alias("record_type"), key.alias("key"), F.col("date") if "date" in df.columns else F.lit(None).cast("date").alias("date"), step.alias("h"), *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("mean", "q16", "q50", "q84")])
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {X.MODES} SELECT model_id, CAST({P.DRAWS} AS BIGINT) AS draws, 1.0 AS stable, max(n) = count(DISTINCT series) AS whole FROM modes JOIN mn USING (model_id) GROUP BY 1")
def model_diagnostics(s, d):
    """Of each model: draws, the share of stable ones, and whether every equation has a spread at every date."""
    draws = P.structural(s, d)
    roots = M.spectral_radius(M.companion_roots(draws.filter("kind = 'b' and lag > 0"), ["model_id", "draw"]), ["model_id", "draw"])
    spread = draws.filter("kind = 'scale'").groupBy("model_id").agg((F.count("*") == F.count_distinct("draw") * F.count_distinct("equation") * F.count_distinct("variable")).alias("whole"))
    return roots.groupBy("model_id").agg(F.count("*").alias("draws"), F.avg(F.col("stable").cast("double")).alias("stable")).join(spread, "model_id")


@query()
def shock_scales(s, d):
    """One standard deviation of each shock at the sample's end, and the effective draws behind it."""
    ends = T.impacts_at(P.structural(s, d), KEYS).filter("response = shock").select("model_id", F.col("shock").alias("equation"), "draw", "value")
    return Z.parameter_summary(ends, ["model_id", "equation"]).join(M.effective_size(ends, ["model_id", "equation"]).drop("n"), ["model_id", "equation"])


# Regressors

SEASON = "sx AS (SELECT DISTINCT date, 'january' AS variable, 0 AS lag, CASE WHEN month(date) = 1 THEN 1.0 ELSE 0.0 END AS x FROM ds)"


def january(panel):
    return panel.select("model_id", "date").distinct().select("model_id", "date", F.lit("january").alias("variable"), (F.month("date") == 1).cast("double").alias("x"))


def _design_sql() -> str:
    from anchorline.plans.queries import DLOG, MP

    return f"WITH {X.INDEX}, {DLOG}, {MP}, {SEASON}"


@query(_design_sql() + f" SELECT 'm' AS model_id, date, variable, CAST(lag AS INTEGER) AS lag, {r('x')} AS x FROM (SELECT * FROM dx UNION ALL SELECT * FROM sx)")
def var_design_regressors(s, d):
    panel = model_panel(s, d)
    return M.design(panel, KEYS, 2, january(panel))


@query()
def regressor_coefficients(s, d):
    """What a January adds to each series of each line number, as the draws have it."""
    panel = X.line_changes(s, d)
    draws = P.stored(s, d, "season", lambda: M.gibbs(panel, KEYS, 1, 40, 20, 23, regressors=january(panel)))
    return Z.parameter_summary(draws.filter("kind = 'b' and variable = 'january'").withColumnRenamed("b", "value"), ["model_id", "equation"])


# Transfer of one aggregate's draws to another model

PAIRS, STEPS, START = 60, 6, "1998-06-01"
_PAIRS = f"pool AS (SELECT 'source' AS model, unnest(range(0, {X.DRAWS})) AS draw UNION ALL SELECT 'target', unnest(range(0, {P.DRAWS}))), rk AS (SELECT model, draw, row_number() OVER (PARTITION BY model ORDER BY (draw * 7919 + 5 * 104729) % 100003, draw) - 1 AS rank, count(*) OVER (PARTITION BY model) AS size FROM pool), pr AS (SELECT i AS pair_id, model, draw FROM (SELECT unnest(range(0, {PAIRS})) AS i), rk WHERE i % size = rank)"
_GROWTH = f"gr AS (SELECT draw, row_number() OVER (PARTITION BY draw ORDER BY date) AS h, 100 * (ln(value) - ln(before)) AS b, 100 * (ln(value) - ln(before)) + CASE WHEN first THEN 100 * ln(1 + draw / 1000.0) ELSE 0 END AS s FROM (SELECT draw, date, value, lag(value) OVER (PARTITION BY draw ORDER BY date) AS before, date = DATE '{START}' + INTERVAL 1 MONTH AS first FROM cube WHERE series = 'ASIA' AND date >= DATE '{START}') WHERE before IS NOT NULL)"


def pairs(s, d):
    """Draws of the regions' index, the source, and of the line numbers' models, the target, in pairs."""
    source = X.cube(s, d).select(F.lit("source").alias("model"), "draw").distinct()
    target = P.structural(s, d).filter("kind = 'phi'").select(F.lit("target").alias("model"), "draw").distinct()
    return A.draw_pairing(source.unionByName(target), PAIRS, 5)


def legs(s, d, paired):
    path = X.cube(s, d).filter("series = 'ASIA'").select("draw", "date", "value")
    moved = path.withColumn("value", F.col("value") * F.when(F.col("date") > F.lit(START).cast("date"), 1 + F.col("draw") / 1000.0).otherwise(1.0))
    mine = paired.filter("model = 'source'")
    return tuple(N.growth_conditions(p, mine, START, STEPS, "N") for p in (path, moved))


@query(f"WITH {X.CUBE}, {_PAIRS}, {_GROWTH} SELECT CAST(pair_id AS INTEGER) AS draw, 'N' AS series, CAST(h AS INTEGER) AS h, {r('b', 4)} AS baseline, {r('s', 4)} AS scenario FROM pr JOIN gr ON gr.draw = pr.draw WHERE model = 'source' AND h <= {STEPS}", digits=4)
def transfer_conditions(s, d):
    baseline, scenario = legs(s, d, pairs(s, d))
    return baseline.withColumnRenamed("value", "baseline").join(scenario.withColumnRenamed("value", "scenario"), ["draw", "series", "h"])


def transferred(s, d):
    paired = pairs(s, d)
    mine = paired.filter("model = 'target'").select("pair_id", "draw")
    tail = P.ends(s, d).join(mine, "draw").select("model_id", F.col("pair_id").cast("int").alias("draw"), "series", "back", "value")
    return N.transfer(N.paired_posterior(P.structural(s, d), mine), tail, KEYS, *legs(s, d, paired), STEPS, 31)


def stored_legs(s, d):
    return P.stored(s, d, "transfer", lambda: transferred(s, d).withColumn("kind", F.when(F.col("series").startswith("spread of "), "spread").otherwise("path"))).drop("kind")


@query(f"WITH {X.CUBE}, {_PAIRS}, {_GROWTH}, md AS (SELECT DISTINCT 'line ' || l_linenumber AS model_id FROM lineitem) SELECT model_id, CAST(pair_id AS INTEGER) AS draw, CAST(h AS INTEGER) AS h, {r('b', 4)} AS baseline, {r('s', 4)} AS scenario, {r('s - b', 4)} AS effect FROM md, pr JOIN gr ON gr.draw = pr.draw WHERE model = 'source' AND h <= {STEPS}", digits=4)
def transfer_effect(s, d):
    """The series that carries the source's draws follows them in both legs, so its effect is theirs."""
    return stored_legs(s, d).filter("series = 'N'").select("model_id", "draw", "h", "baseline", "scenario", (F.col("scenario") - F.col("baseline")).alias("effect"))


@query(f"WITH md AS (SELECT DISTINCT 'line ' || l_linenumber AS model_id FROM lineitem) SELECT model_id, CAST({PAIRS} AS BIGINT) AS pairs, true AS paired FROM md")
def transfer_pairing(s, d):
    return N.pairing_gap(stored_legs(s, d), KEYS).select("model_id", "pairs", "paired")


def line_weights(s, d):
    return X.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("series")).agg(F.sum("l_extendedprice").alias("w"))


@query()
def transfer_marginal(s, d):
    """Per cent by which the source's scenario moves each line number's total, and its series one by one."""
    held = stored_legs(s, d).filter("series not like 'spread of %'")
    own = A.fan(held.withColumn("effect", F.col("scenario") - F.col("baseline")), ["model_id", "series", "h"], A.FAN, "effect")
    total = A.fan(N.total_effect(held, line_weights(s, d), KEYS), ["model_id", "h"], A.FAN, "effect")
    return own.unionByName(total.withColumn("series", F.lit("total")))


@query()
def core_scenario(s, d):
    """The same without the series that carries the source, its weight dealt over the others."""
    held = stored_legs(s, d).filter("series not like 'spread of %'")
    return A.fan(N.total_effect(held, line_weights(s, d), KEYS, ["N"]), ["model_id", "h"], A.FAN, "effect")
