"""Queries of the tables for people, the scenarios, and the small operators of values and contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from anchorline.functions import scalar as S
from anchorline.operators import align as J
from anchorline.operators import calendar as T
from anchorline.operators import fans as A
from anchorline.operators import index as C
from anchorline.operators import models as M
from anchorline.operators import scenarios as N
from anchorline.operators import tables as Q
from anchorline.operators import validate as V
from anchorline.plans import proxies as X
from anchorline.plans.queries import IRF, fan_sql, query, r, responses
from anchorline.schemas import DISPLAY
from anchorline.session import workspace
from anchorline.sources import readers as I
from anchorline.sources import store

ORIGIN = "2000-06-01"
SERIES = ["series", "date"]

# Forecasts and nowcasts

FAN = f"f AS (SELECT series, date, {fan_sql('value')} FROM cube GROUP BY 1, 2)"
LABELS = f"lab AS (SELECT series, 'M+' || h AS label, CAST(h AS INTEGER) AS h, CAST(DATE '{ORIGIN}' + h * INTERVAL 1 MONTH AS DATE) AS target FROM (SELECT series, max(date) AS hi FROM cube GROUP BY 1), (SELECT unnest([1, 2, 3, 6, 12]) AS h) WHERE h <= 3 OR DATE '{ORIGIN}' + h * INTERVAL 1 MONTH <= hi)"


def fans(s, d):
    return A.fan(X.cube(s, d), SERIES)


@query(f"WITH {X.CUBE}, {FAN}, {LABELS}, l AS (SELECT series, max(date) AS latest_date, {r('max_by(value, date)', 2)} AS latest FROM idx WHERE date <= DATE '{ORIGIN}' GROUP BY 1) SELECT lab.series, target, label, h, mean, q05, q16, q50, q84, q95, n_draws, latest_date, latest FROM lab LEFT JOIN f ON f.series = lab.series AND f.date = target LEFT JOIN l ON l.series = lab.series", digits=2)
def forecast_summary(s, d):
    return Q.forecast_summary(X.index(s, d), fans(s, d), ["series"], ORIGIN)


def legs(s, d):
    """A baseline, a scenario that is higher by draw thousandths, and their draw-wise effect, as fans."""
    base = X.cube(s, d)
    scenario = base.withColumn("value", F.col("value") * (1 + F.col("draw") / 1000.0))
    return A.fan(base, SERIES), A.fan(scenario, SERIES), A.paired_fan(base, scenario, SERIES)


_E = "x AS (SELECT series, date, value, value * (1 + draw / 1000.0) AS other FROM cube), "


@query(f"WITH {X.CUBE}, {_E} b AS (SELECT series, date, {r('avg(value)', 2)} AS baseline_mean, {r('quantile_cont(value, 0.5)', 2)} AS baseline_q50 FROM x GROUP BY 1, 2), e AS (SELECT series, date, {r('avg(other)', 2)} AS scenario_mean, {r('quantile_cont(other, 0.5)', 2)} AS scenario_q50, {r('avg(other - value)', 2)} AS effect_mean, {r('quantile_cont(other - value, 0.5)', 2)} AS effect_q50 FROM x GROUP BY 1, 2) SELECT b.*, scenario_mean, scenario_q50, effect_mean, effect_q50 FROM b LEFT JOIN e ON e.series = b.series AND e.date = b.date", digits=2)
def effect_table(s, d):
    return Q.effect_table(*legs(s, d), ["series"])


@query(f"WITH {X.CUBE}, {FAN} SELECT f.*, {r('idx.value', 2)} AS observed, CASE WHEN idx.value IS NULL THEN 'nowcast' ELSE 'observed' END AS status FROM f LEFT JOIN idx ON idx.series = f.series AND idx.date = f.date AND (year(idx.date) * 12 + month(idx.date)) % 7 <> 3", digits=2)
def nowcast_table(s, d):
    seen = X.index(s, d).filter((F.year("date") * 12 + F.month("date")) % 7 != 3)
    return Q.nowcast_table(fans(s, d), seen, ["series"])


@query(f"WITH {X.CUBE}, {FAN} SELECT f.*, NULL::DOUBLE AS observed, 'nowcast' AS status FROM f WHERE (year(date) * 12 + month(date)) % 7 = 3", digits=2)
def nowcast_missing_only(s, d):
    seen = X.index(s, d).filter((F.year("date") * 12 + F.month("date")) % 7 != 3)
    return Q.nowcast_table(fans(s, d), seen, ["series"], missing_only=True)


@query(f"WITH {X.CUBE} SELECT series, date, {r('avg(value)', 2)} AS baseline, {r('avg(value * (1 + draw / 1000.0))', 2)} AS scenario FROM cube GROUP BY 1, 2", digits=2)
def merged_nowcasts(s, d):
    base, scenario, _ = legs(s, d)
    return Q.merged_nowcasts(base.withColumnRenamed("mean", "value"), scenario.withColumnRenamed("mean", "value"), ["series"])


@query(f"WITH {X.CUBE}, e AS (SELECT series, date, quantile_cont(value * (1 + draw / 1000.0) - value, 0.5) AS q FROM cube GROUP BY 1, 2) SELECT series, {r('min_by(q, date)', 2)} AS first, {r('max_by(q, date)', 2)} AS last, {r('max(q)', 2)} AS peak, max_by(date, q) AS peak_date FROM e GROUP BY 1", digits=2)
def scenario_kpis(s, d):
    return Q.kpis(legs(s, d)[2], ["series"])


@query(f"WITH {X.CUBE}, {FAN} SELECT series, date, {r('quantile_cont(value, 0.5)', 2)} AS shown FROM cube GROUP BY 1, 2", digits=2)
def statistic_column(s, d):
    return Q.statistic(fans(s, d), "median").select("series", "date", "shown")


@query(f"WITH {X.CUBE} SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS h, {r('quantile_cont(value, 0.84)', 2)} AS value FROM cube WHERE date > DATE '{ORIGIN}' GROUP BY series, date", digits=2)
def condition_from_quantile(s, d):
    return N.condition_from_quantile(fans(s, d), ["series"], "q84", ORIGIN)


# Conditions and indicators

def kind():
    return F.when(F.col("series") == "ASIA", "yoy_pct").when(F.col("series") == "EUROPE", "diff12").otherwise("level")


@query(f"WITH {X.INDEX}, t AS (SELECT a.series, a.date, a.value, CASE a.series WHEN 'ASIA' THEN 100 * (a.value / b.value - 1) WHEN 'EUROPE' THEN a.value - b.value ELSE a.value END AS shown FROM idx a LEFT JOIN idx b ON b.series = a.series AND a.date = b.date + INTERVAL 12 MONTH), z AS (SELECT *, (shown - avg(shown) OVER (PARTITION BY series)) / stddev_samp(shown) OVER (PARTITION BY series) AS z FROM t), m AS (SELECT series, max(date) AS date, max_by(value, date) AS value, max_by(shown, date) AS shown, max_by(z, date) AS z FROM z WHERE z IS NOT NULL GROUP BY 1) SELECT series, date, {r('value')} AS value, {r('shown')} AS shown, {r('z')} AS z, CASE WHEN z >= 1 THEN 'very high' WHEN z >= 0.5 THEN 'high' WHEN z >= -0.5 THEN 'normal' WHEN z >= -1 THEN 'low' ELSE 'very low' END AS regime FROM m")
def economic_conditions_transformed(s, d):
    scored = Q.scores(Q.transformed(X.index(s, d), ["series"], kind()), ["series"])
    return Q.latest_valid(scored, ["series"], "z", ["value", "shown", "z"]).withColumn("regime", S.regime(F.col("z")))


@query(f"WITH {X.INDEX}, c AS (SELECT series, date, CASE WHEN month(date) % 3 = 0 THEN NULL ELSE value END AS value FROM idx) SELECT series, date, {r('value')} AS value, CASE series WHEN 'ASIA' THEN {r('ln(value)')} WHEN 'EUROPE' THEN {r('value / 100')} ELSE {r('value')} END AS state FROM c")
def state_conditions(s, d):
    level = X.index(s, d).withColumn("value", F.when(F.month("date") % 3 != 0, F.col("value")))
    transform = F.when(F.col("series") == "ASIA", "logdiff").when(F.col("series") == "EUROPE", "percent_rate_diff").otherwise("diff")
    return N.state_conditions(level, transform, partial=True)


@query(f"WITH {X.INDEX}, l AS (SELECT series, max(date) AS date, max_by(value, date) AS driver FROM idx GROUP BY 1), g AS (SELECT series, CAST(date + h * INTERVAL 1 MONTH AS DATE) AS date, {r('driver')} AS driver FROM l, (SELECT unnest(range(1, 13)) AS h)) SELECT *, " + ", ".join(f"CASE WHEN month(date) = {m} THEN 1.0 ELSE 0.0 END AS m{m:02d}" for m in range(1, 12)) + " FROM g")
def future_regressors(s, d):
    last = X.index(s, d).groupBy("series").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return N.future_regressors(last, ["series"], 12)


SPREAD = "ot AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1), lt AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) AS value, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1), rest AS (SELECT ot.date, ot.value - lt.value AS value FROM ot JOIN lt ON lt.date = ot.date)"


def spread(s, d):
    """Each month's orders less the lines shipped in it, which may be negative, and the mean line price as published history."""
    total = X.sales(s, d).groupBy(F.trunc("date", "month").alias("date")).agg(F.sum("value").alias("value"))
    lines = X.table(s, d, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(F.sum("l_extendedprice").alias("shipped"), F.avg("l_extendedprice").alias("price"))
    both = total.join(lines, "date")
    return both.select("date", (F.col("value") - F.col("shipped")).alias("value")), lines.select("date", F.col("price").alias("value"))


@query(f"WITH {SPREAD} SELECT CAST(draw AS INTEGER) AS draw, rest.date, {r('rest.value', 2)} AS value FROM rest JOIN lt ON lt.date = rest.date, (SELECT unnest(range(0, 5)) AS draw) WHERE price > 0", digits=2)
def residual_paths(s, d):
    return N.observed_paths(*spread(s, d), 5)


@query(f"WITH {SPREAD}, held AS (SELECT date FROM rest WHERE month(date) <> 7) SELECT date FROM rest WHERE month(date) = 7 AND date > (SELECT min(date) FROM held) AND date < (SELECT max(date) FROM held)")
def overlap_gaps(s, d):
    series, history = spread(s, d)
    return N.overlap_gaps(series.filter("month(date) <> 7"), history)


# Taxes over draws

GAMMA = "px AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS i, avg(o_totalprice + length(o_orderpriority) * 1000) AS p FROM orders GROUP BY 1, 2)"


@query(f"WITH {GAMMA} SELECT series, CASE WHEN count(*) >= 6 THEN {r('sum(i * p) / sum(i * i)')} END AS gamma FROM px GROUP BY 1")
def tax_context(s, d):
    month = [F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")]
    orders = X.table(s, d, "orders")
    index = orders.groupBy(*month).agg(F.avg("o_totalprice").alias("value"))
    prices = orders.groupBy(*month).agg(F.avg(F.col("o_totalprice") + F.length("o_orderpriority") * 1000).alias("value"))
    return N.tax_context(index, prices, ["series"])


@query(f"WITH {X.TAX}, half AS (SELECT * FROM tax WHERE month(date) IN (1, 7)), g AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM half), DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS date) SELECT g.date, {r('vat')} AS vat, {r('excise')} AS excise FROM g ASOF JOIN half ON g.date >= half.date")
def applied_tax_path(s, d):
    half = X.tax(s, d).filter(F.month("date").isin(1, 7))
    grid = half.agg(F.min("date").alias("lo")).select(F.explode(F.sequence("lo", F.lit("2000-12-01").cast("date"), F.expr("interval 1 month"))).alias("date"))
    return N.applied_taxes(half, grid)


TAX_PAIR = f"tp AS (SELECT series, draw, cube.date, (value / 1000 + excise) * (1 + vat / 100) / 1.5 AS baseline, CASE WHEN cube.date >= DATE '{ORIGIN}' THEN (value / 1000 + excise + 5) * (1 + (vat + 2) / 100) / 1.5 ELSE (value / 1000 + excise) * (1 + vat / 100) / 1.5 END AS scenario FROM cube JOIN tax ON tax.date = cube.date)"


def tax_pairs(s, d):
    return N.tax_pair(X.cube(s, d).withColumn("value", F.col("value") / 1000), X.tax(s, d), F.lit(1.5), ORIGIN, 2.0, 5.0)


@query(f"WITH {X.CUBE}, {X.TAX}, {TAX_PAIR} SELECT series, date, {r('avg(scenario - baseline)', 3)} AS mean, " + ", ".join(f"{r(f'quantile_cont(scenario - baseline, {q})', 3)} AS q{round(100 * q):02d}" for q in A.FAN) + ", count(*) AS n_draws FROM tp GROUP BY 1, 2", digits=3)
def component_tax_scenario(s, d):
    return N.pair_effect(tax_pairs(s, d), SERIES)


@query(f"WITH {X.CUBE}, {X.TAX}, {TAX_PAIR}, m AS (SELECT series, draw FROM tp GROUP BY 1, 2 HAVING bool_and(baseline > 0 AND scenario > 0)), a AS (SELECT tp.series, tp.draw, idx.value / tp.baseline AS scale FROM tp JOIN idx ON idx.series = tp.series AND idx.date = tp.date WHERE tp.date = DATE '1998-12-01') SELECT tp.series, tp.draw, tp.date, {r('baseline * scale', 4)} AS baseline, {r('scenario * scale', 4)} AS scenario FROM tp JOIN m ON m.series = tp.series AND m.draw = tp.draw JOIN a ON a.series = tp.series AND a.draw = tp.draw", digits=4)
def pair_to_index(s, d):
    pairs = tax_pairs(s, d)
    leg = lambda name: pairs.select("series", "draw", "date", F.col(name).alias("value"))
    return N.rebased_pair(N.paired_draws(leg("baseline"), leg("scenario"), ["series"]), X.index(s, d), ["series"], "1998-12-01")


def _second(sql: str) -> str:
    """The chain's tables again, over cube2."""
    import re

    return re.sub(r"\b(dec|shr|rat|gg|anc|chain|terms|cube)\b", r"\g<1>2", sql)


_CHAIN = X.CHAIN_DRAWS.removeprefix(f"{X.CUBE}, ")
JOINT = f"{X.CUBE}, {X.TAX}, cube2 AS (SELECT cube.series, draw, cube.date, CASE WHEN cube.series IN ('ASIA', 'EUROPE') AND cube.date >= DATE '{ORIGIN}' THEN value * 1.1 ELSE value END AS value FROM cube), {_CHAIN}, {_second(_CHAIN)}"


@query(f"WITH {JOINT}, e AS (SELECT a.date, 100 * (b.value / a.value - 1) AS e FROM chain a JOIN chain2 b ON b.draw = a.draw AND b.date = a.date) SELECT date, {r('avg(e)', 4)} AS mean, " + ", ".join(f"{r(f'quantile_cont(e, {q})', 4)} AS q{round(100 * q):02d}" for q in A.FAN) + ", count(*) AS n_draws FROM e GROUP BY 1", digits=4)
def joint_scenario(s, d):
    """Two components that rise by a tenth from a month on: each draw's aggregate with them against the one without."""
    base = X.cube(s, d)
    moved = F.col("series").isin("ASIA", "EUROPE") & (F.col("date") >= F.lit(ORIGIN).cast("date"))
    # One pass of the chain over both legs.
    both = base.withColumn("leg", F.explode(F.array(F.lit("baseline"), F.lit("scenario")))).withColumn("value", F.when(moved & (F.col("leg") == "scenario"), F.col("value") * 1.1).otherwise(F.col("value")))
    chained = C.chain_link(both, X.weights(s, d), ["leg", "draw"])
    side = lambda x: F.max(F.when(F.col("leg") == x, F.col("value"))).alias(x)
    return N.pair_effect(chained.groupBy("draw", "date").agg(side("baseline"), side("scenario")), ["date"], relative=True)


_SHARE = "ts AS (SELECT series, draw, cube.date, value / 1000 AS pre, excise, (value / 1000 + excise) * (1 + vat / 100) AS gross FROM cube JOIN tax ON tax.date = cube.date)"


@query(f"WITH {X.CUBE}, {X.TAX}, {_SHARE} SELECT series, date, {r('avg(pre / gross)', 4)} AS pre_tax, {r('avg((pre + excise) / gross - pre / gross)', 4)} AS excise, {r('avg(1 - (pre + excise) / gross)', 4)} AS vat FROM ts GROUP BY 1, 2", digits=4)
def forecast_tax_shares(s, d):
    from anchorline.operators.tax import layer_shares

    joined = X.cube(s, d).join(X.tax(s, d), "date")
    shares = joined.select(*SERIES, *layer_shares(F.col("value") / 1000, F.col("vat"), F.col("excise")))
    return shares.groupBy(*SERIES).agg(F.avg("pre_tax").alias("pre_tax"), F.avg("excise").alias("excise"), F.avg("vat").alias("vat"))


# Aggregates and stored results

_TERMS = "k AS (SELECT a.series, a.date, 100 * (a.term - b.term) / b.total AS c FROM terms a JOIN terms b ON a.series = b.series AND a.date = b.date + INTERVAL 12 MONTH WHERE a.date = DATE '2000-06-01')"


@query(f"WITH {X.CHAIN_ONE}, {_TERMS} SELECT date, series, {r('c')} AS contribution, CAST(row_number() OVER (ORDER BY round(abs(c), 9) DESC, series) AS INTEGER) AS place FROM k QUALIFY place <= 3")
def top_contributions(s, d):
    parts = C.yoy_contributions(C.chain_terms(X.index(s, d), X.weights(s, d)))
    return Q.top_contributions(parts, F.lit("2000-06-01").cast("date"), 3)


@query(f"WITH {X.CHAIN_ONE}, l AS (SELECT date, value, lag(value) OVER (ORDER BY date) AS p FROM chain) SELECT 'all' AS series, max(date) AS date, {r('max_by(value, date)')} AS value, {r('max_by(value - p, date)')} AS change FROM l")
def aggregate_kpis(s, d):
    chain = C.chain_link(X.index(s, d), X.weights(s, d)).select(F.lit("all").alias("series"), "date", "value")
    return J.latest_change(chain, ["series"])


@query(f"WITH {X.INDEX}, u AS (SELECT series, date, CASE WHEN date <= DATE '{ORIGIN}' THEN 'history' ELSE 'fan' END AS record_type FROM idx) SELECT series, record_type, count(*) AS rows, min(date) AS first, max(date) AS last FROM u GROUP BY 1, 2")
def record_counts(s, d):
    tagged = X.index(s, d).withColumn("record_type", F.when(F.col("date") <= F.lit(ORIGIN).cast("date"), "history").otherwise("fan"))
    return Q.record_counts(tagged, ["series"])


_COLUMNS = ", ".join({"series": "series", "date": "CAST(date AS TIMESTAMP) AS date", "value": f"{r('value')} AS value", "record_type": "'history' AS record_type"}.get(f.name, f"CAST(NULL AS {({'boolean': 'BOOLEAN', 'double': 'DOUBLE', 'timestamp': 'TIMESTAMP'}).get(f.dataType.typeName(), 'VARCHAR')}) AS \"{f.name}\"") for f in DISPLAY)


@query(f"WITH {X.INDEX} SELECT {_COLUMNS} FROM idx")
def display_rows(s, d):
    return Q.as_display(X.index(s, d), DISPLAY, record_type="history")


@query(f"WITH {X.RUNS}, a AS (SELECT model_id, 'a' AS part, vintage FROM runs WHERE promoted = 1 UNION SELECT model_id, 'b', vintage FROM runs WHERE created > 40) SELECT model_id, count(DISTINCT vintage) AS vintages, count(DISTINCT part) AS parts FROM a GROUP BY 1 HAVING count(DISTINCT vintage) > 1")
def mixed_vintages(s, d):
    runs = X.runs(s, d)
    return N.mixed_vintages({"a": runs.filter("promoted = 1"), "b": runs.filter("created > 40")}, ["model_id"])


@query(f"WITH {IRF}, o AS (SELECT *, sum(value * value) OVER (PARTITION BY draw, response, shock ORDER BY h) AS own FROM irf), sh AS (SELECT *, own / sum(own) OVER (PARTITION BY draw, response, h) AS share FROM o) SELECT response, shock, h, {r('avg(value)', 3)} AS irf, {r('quantile_cont(value, 0.16)', 3)} AS q16, {r('quantile_cont(value, 0.84)', 3)} AS q84, {r('avg(share)', 3)} AS share FROM sh GROUP BY 1, 2, 3", digits=3)
def structural_records(s, d):
    """Responses and variance shares of each shock, side by side."""
    on = ["response", "shock", "h"]
    irf = responses(s, d)
    bands = A.fan(irf, on, (0.16, 0.84)).select(*on, F.col("mean").alias("irf"), "q16", "q84")
    return bands.join(M.variance_shares(irf, ["draw"]).groupBy(*on).agg(F.avg("share").alias("share")), on)


_BANDS = ", ".join(f"('{n}', {at!r})" for n, at in [("trend", 0.0), *[(f"{p:g}", 2 * 3.141592653589793 / p) for p in (12, 6, 4, 3, 2.4, 2)]])


@query(f"WITH ro AS (SELECT CAST(k AS INTEGER) AS draw, r_regionkey AS i, (k * 7 + r_regionkey * 5) % 24 * pi() / 24 + 0.01 AS angle, ((k * 11 + r_regionkey * 3) % 17) / 20.0 AS modulus FROM region, (SELECT unnest(range(0, 40)) AS k)), ba(band, place) AS (VALUES {_BANDS}) SELECT draw, band, {r('max(modulus)')} AS modulus FROM ro, ba WHERE abs(angle - place) <= pi() / 24 GROUP BY 1, 2")
def root_bands(s, d):
    k, i = F.col("draw"), F.col("r_regionkey")
    roots = X.table(s, d, "region").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("draw", ((k * 7 + i * 5) % 24 * F.pi() / 24 + 0.01).alias("angle"), ((k * 11 + i * 3) % 17 / 20.0).alias("modulus"))
    return M.root_bands(roots, ["draw"])


# Values, contracts, sources


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS value FROM orders")
def number_parse(s, d):
    key = F.col("o_orderkey") % 4
    raw = F.when(key == 0, F.col("o_totalprice").cast("string")).when(key == 1, "NaN").when(key == 2, "-Infinity").otherwise("#N/A")
    return X.table(s, d, "orders").select("o_orderkey", S.clean_number(raw).alias("value"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN {r('o_totalprice / (o_orderkey % 10 / 4.0 * 7.3)')} END AS value FROM orders")
def unit_conversion(s, d):
    return X.table(s, d, "orders").select("o_orderkey", S.convert(F.col("o_totalprice"), F.col("o_orderkey") % 10 / 4.0, 7.3).alias("value"))


@query("SELECT p_partkey, p_brand AS model_id, p_type AS vintage, 'r' || p_partkey AS run_id, 'base' AS forecast_name, CASE p_brand WHEN 'Brand#11' THEN 'first' ELSE p_brand END AS known_as FROM part")
def identity_parts(s, d):
    uri = F.concat(F.lit("forecast://"), "p_brand", F.lit("/"), "p_type", F.lit("/r"), F.col("p_partkey").cast("string"), F.lit("/base"))
    return X.table(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in S.identity(uri).items()], S.alias_of(F.col("p_brand"), {"Brand#11": "first"}).alias("known_as"))


@query("SELECT o_orderkey, printf('%+.2f', o_totalprice - 100000.0) AS signed, printf('%.2f to %.2f', o_totalprice, o_totalprice + 1.25) AS interval FROM orders")
def value_texts(s, d):
    x = F.col("o_totalprice")
    return X.table(s, d, "orders").select("o_orderkey", S.signed(F.round(x - 100000.0, 2)).alias("signed"), S.interval_text(x, F.round(x + 1.25, 2)).alias("interval"))


@query("WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(1 + o_orderkey % 14 AS INTEGER) AS m FROM orders) SELECT o_orderkey, greatest(3, m) AS monthly, greatest(26, CAST(floor(datediff('day', date_trunc('week', d) + INTERVAL 7 DAY, last_day(date_trunc('month', d) + (m - 1) * INTERVAL 1 MONTH)) / 7.0) AS INTEGER) + 1) AS weekly FROM o")
def horizon_rules(s, d):
    m = (1 + F.col("o_orderkey") % 14).cast("int")
    day = F.col("o_orderdate").cast("date")
    return X.table(s, d, "orders").select("o_orderkey", S.horizon_rule(day, m).alias("monthly"), S.horizon_rule(day, m, weekly=True).alias("weekly"))


@query(f"WITH {X.INDEX}, e AS (SELECT r_name AS series, CASE WHEN r_name = 'ASIA' THEN DATE '1990-01-01' ELSE DATE '1992-01-01' END AS expected FROM region WHERE r_name <> 'AFRICA' UNION ALL SELECT 'ATLANTIS', DATE '1992-01-01'), a AS (SELECT series, min(date) AS actual FROM idx GROUP BY 1) SELECT coalesce(e.series, a.series) AS series, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN actual = expected THEN 'ok' ELSE 'moved' END AS status FROM e FULL JOIN a ON a.series = e.series")
def start_contract(s, d):
    day = lambda x: F.lit(x).cast("date")
    expected = X.table(s, d, "region").filter("r_name <> 'AFRICA'").select(F.col("r_name").alias("series"), F.when(F.col("r_name") == "ASIA", day("1990-01-01")).otherwise(day("1992-01-01")).alias("expected"))
    expected = expected.unionByName(s.range(1).select(F.lit("ATLANTIS").alias("series"), day("1992-01-01").alias("expected")))
    return V.start_contract(X.index(s, d), expected, ["series"])


@query(f"WITH {X.RUNS} SELECT model_id, vintage, run_id, created + CASE WHEN created > 40 THEN 100 ELSE 0 END AS created, promoted FROM runs WHERE model_id <> 'Brand#11'")
def scenario_upsert(s, d):
    runs = X.runs(s, d)
    keys = ["model_id", "vintage", "run_id"]
    changed = J.upsert(runs, runs.filter("created > 40").withColumn("created", F.col("created") + 100), keys)
    return J.remove(changed, runs.filter("model_id = 'Brand#11'"), ["model_id"])


@query(f"WITH {X.RUNS}, k AS (SELECT model_id, vintage, run_id, promoted FROM runs WHERE created > 5), f AS (SELECT model_id, vintage, run_id FROM runs WHERE CAST(substr(run_id, 2) AS BIGINT) % 5 <> 0) SELECT coalesce(k.model_id, f.model_id) AS model_id, coalesce(k.vintage, f.vintage) AS vintage, coalesce(k.run_id, f.run_id) AS run_id, coalesce(promoted, 0) AS promoted, f.run_id IS NOT NULL AS present_on_disk FROM k FULL JOIN f ON f.run_id = k.run_id")
def registry_scan(s, d):
    runs = X.runs(s, d)
    return I.register_runs(runs.filter("created > 5"), runs.filter(F.substring("run_id", 2, 20).cast("long") % 5 != 0), ["model_id", "vintage", "run_id"])


@query("SELECT n_regionkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS position, CAST(n_nationkey AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS d0 FROM nation")
def json_cube(s, d):
    """Each region's nations as a cube of one dimension: a list in one region, a map by position in the next."""
    ranked = X.table(s, d, "nation").withColumn("p", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    values = F.array_sort(F.collect_list(F.struct("p", F.col("n_nationkey").cast("double").alias("v"))))
    cubes = ranked.groupBy(F.col("n_regionkey").alias("id")).agg(values.alias("values"))
    dense = F.to_json(F.struct(F.transform("values", lambda x: x["v"]).alias("value")))
    sparse = F.to_json(F.struct(F.map_from_entries(F.transform("values", lambda x: F.struct(x["p"].cast("string"), x["v"]))).alias("value")))
    return I.json_cube(cubes.select("id", F.when(F.col("id") % 2 == 0, dense).otherwise(sparse).alias("value")), [5])


@query(f"WITH {X.INDEX} SELECT 'eu' AS series, date, {r('value')} AS value FROM idx WHERE series = 'EUROPE' AND year(date) IN (1996, 1997) UNION ALL SELECT 'as', date, {r('value')} FROM idx WHERE series = 'ASIA' AND year(date) IN (1996, 1997)")
def ticker_rows(s, d):
    """A block with a row for each ticker and a column for each month, of which two tickers are asked for."""
    months = [f"{y}{m:02d}" for y in (1996, 1997) for m in range(1, 13)]
    block = X.index(s, d).groupBy("series").agg(*[F.max(F.when(F.date_format("date", "yyyyMM") == m, F.col("value"))).alias(m) for m in months])
    return I.ticker_rows(block, "series", {"EUROPE": "eu", "ASIA": "as"}).filter("value is not null")


@query(f"WITH {X.INDEX} SELECT unnest(['eu', 'as']) AS series, count(DISTINCT date) AS markers FROM idx WHERE year(date) = 1997")
def ticker_markers(s, d):
    """A block with a column for each ticker, in which a year has error markers."""
    wide = I.pivot_panel(X.index(s, d), ("EUROPE", "ASIA"))
    marked = wide.select("date", *[F.when(F.year("date") == 1997, "#N/A").otherwise(F.col(c).cast("string")).alias(c) for c in ("EUROPE", "ASIA")])
    return I.ticker_columns(marked, "date", {"EUROPE": "eu", "ASIA": "as"})[1]


@query(f"WITH {X.INDEX} SELECT series, date, {r('value')} AS value, {r('value - lag(value, 3) OVER (PARTITION BY series ORDER BY date)')} AS change FROM idx")
def lagged_differences(s, d):
    return T.change(X.index(s, d), ["series"], 3)


@query(f"WITH {X.INDEX}, w AS (SELECT year(date) AS year, series, 1000 * sum(value) / sum(sum(value)) OVER (PARTITION BY year(date)) AS w FROM sales GROUP BY 1, 2) SELECT CAST(year AS INTEGER) AS year, CASE WHEN series IN ('ASIA', 'EUROPE') THEN 'EURASIA' ELSE series END AS family, {r('sum(w)')} AS w, CASE WHEN year >= 1997 THEN abs(sum(sum(w)) OVER (PARTITION BY year) - 1000) <= 0.5 END AS identity FROM w GROUP BY 1, 2, year")
def model_weights(s, d):
    family = F.when(F.col("series").isin("ASIA", "EUROPE"), "EURASIA").otherwise(F.col("series"))
    return C.family_weights(X.weights(s, d), family, guarded_from=1997)


# Stored results


@query(f"WITH {X.CUBE} SELECT series, draw, date, {r('value')} AS value, 'm' AS model_id, 'v1' AS vintage, 'r1' AS run_id, 'base' AS forecast_name FROM cube")
def stored_paths(s, d):
    """A cube that is saved under two runs and read back for one of them."""
    root = workspace(s, "store")
    named = X.cube(s, d).withColumns({"model_id": F.lit("m"), "vintage": F.lit("v1"), "forecast_name": F.lit("base")})
    store.save(named.withColumn("run_id", F.explode(F.array(F.lit("r1"), F.lit("r2")))), root, "paths")
    return store.load(s, root, "paths", run_id="r1")


@query(f"WITH {X.INDEX} SELECT unnest(['series', 'date', 'value']) AS \"column\", unnest(['string', 'date', 'double']) AS type, (SELECT count(*) FROM idx) AS rows")
def table_manifest(s, d):
    root = workspace(s, "manifest")
    X.index(s, d).write.mode("overwrite").parquet(f"{root}/t")
    return store.manifest(s.read.parquet(f"{root}/t"))


@query(f"WITH {X.RUNS} SELECT model_id, vintage, run_id, created, CASE WHEN model_id = 'Brand#11' THEN 1 ELSE promoted END AS promoted FROM runs")
def stored_registry(s, d):
    """A registry of two versions; the second, with one model's runs promoted, is what is read."""
    root = workspace(s, "registry")
    store.commit_version(X.runs(s, d), root)
    store.commit_version(store.read_version(s, root).withColumn("promoted", F.when(F.col("model_id") == "Brand#11", 1).otherwise(F.col("promoted"))), root)
    return store.read_version(s, root)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'results/' || p_partkey WHEN 3 THEN '/elsewhere/x' ELSE CASE p_partkey % 4 WHEN 1 THEN 'results/' || p_partkey ELSE '/old/home/results/' || p_partkey END END AS portable, CASE WHEN p_partkey % 4 <> 3 THEN '/work/results/' || p_partkey END AS path FROM part")
def portable_references(s, d):
    key = F.col("p_partkey").cast("string")
    n = F.col("p_partkey") % 4
    path = F.when(n == 0, F.concat(F.lit("/work/results/"), key)).when(n == 1, F.concat(F.lit("results/"), key)).when(n == 2, F.concat(F.lit("/old/home/results/"), key)).otherwise("/elsewhere/x")
    return X.table(s, d, "part").select("p_partkey", store.portable(path, "/work").alias("portable"), store.resolved(path, "/work").alias("path"))
