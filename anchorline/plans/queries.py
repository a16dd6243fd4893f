"""A query for each operator over the proxy tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import scalar as S
from anchorline.operators import align as J
from anchorline.operators import calendar as T
from anchorline.operators import fans as A
from anchorline.operators import index as C
from anchorline.operators import models as M
from anchorline.operators import registry as R
from anchorline.operators import stats as Z
from anchorline.operators import tax as P
from anchorline.plans import proxies as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query by its function's name; doubles of both sides are rounded alike.

    Interpolated quantiles have few decimals, so they are rounded where ties are rare.
    """

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at ``digits`` places, without a negative zero; a little is added, so that no engine's noise decides a tie."""
    return df.select(*[(F.round(F.col(c) + 7.3105857 * 10.0 ** -(digits + 4), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"round({x} + 7.3105857e-{digits + 4}, {digits}) + 0.0"


FIVE = ", ".join(f"{r(f'quantile_cont({{v}}, {q})', 2)} AS q{round(100 * q):02d}" for q in A.FAN)


def fan_sql(value: str) -> str:
    return f"{r(f'avg({value})', 2)} AS mean, {FIVE.format(v=value)}, count({value}) AS n_draws"


# Index numbers and contributions


@query(f"WITH {X.CHAIN_ONE} SELECT date, {r('value')} AS value, {r('g')} AS g FROM chain")
def chain_link_index(s, d):
    return C.chain_link(X.index(s, d), X.weights(s, d))


@query(f"WITH {X.CHAIN_ONE} SELECT a.date, {r('100 * (a.value / b.value - 1)')} AS yoy FROM chain a JOIN chain b ON a.date = b.date + INTERVAL 12 MONTH")
def yoy_index(s, d):
    return T.growth_over(C.chain_link(X.index(s, d), X.weights(s, d)).select("date", "value"), [], 12).select("date", F.col("growth").alias("yoy"))


YOY = """SELECT {k} a.series, a.date, {c} AS contribution, {y} AS yoy FROM terms a JOIN terms b ON {on} a.series = b.series AND a.date = b.date + INTERVAL 12 MONTH"""
_C, _Y = r("100 * (a.term - b.term) / b.total"), r("100 * (a.total / b.total - 1)")


@query(f"WITH {X.CHAIN_ONE} " + YOY.format(k="", on="", c=_C, y=_Y))
def yoy_contributions(s, d):
    return C.yoy_contributions(C.chain_terms(X.index(s, d), X.weights(s, d)))


@query(f"WITH {X.CHAIN_DRAWS} SELECT draw, date, {r('value')} AS value, {r('g')} AS g FROM chain")
def drawwise_chain(s, d):
    return C.chain_link(X.cube(s, d), X.weights(s, d), ["draw"])


@query(f"WITH {X.CHAIN_DRAWS} " + YOY.format(k="a.draw,", on="a.draw = b.draw AND", c=_C, y=_Y))
def drawwise_contributions(s, d):
    return C.yoy_contributions(C.chain_terms(X.cube(s, d), X.weights(s, d), ["draw"]), ["draw"])


PUBLISHED = "pub AS (SELECT date, avg(value) AS value FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS date, value FROM sales) GROUP BY 1)"


def published(s, d):
    return X.sales(s, d).groupBy(F.trunc("date", "month").alias("date")).agg(F.avg("value").alias("value"))


@query(f"WITH {X.CHAIN_ONE}, {PUBLISHED} SELECT gg.date, {r('b.value * g')} AS rebuilt, {r('pub.value')} AS value, {r('b.value * g - pub.value')} AS error FROM gg JOIN pub b ON month(b.date) = 12 AND year(b.date) + 1 = gg.year JOIN pub ON pub.date = gg.date")
def annual_reanchored_error(s, d):
    return C.reanchored(X.index(s, d), X.weights(s, d), published(s, d))


@query(f"WITH {X.CHAIN_ONE}, {PUBLISHED}, e AS (SELECT b.value * g - pub.value AS error FROM gg JOIN pub b ON month(b.date) = 12 AND year(b.date) + 1 = gg.year JOIN pub ON pub.date = gg.date) SELECT 'all' AS suite, count(*) AS n, {r('max(abs(error))')} AS max_abs, {r('avg(abs(error))')} AS mae, {r('sqrt(avg(error * error))')} AS rmse, CASE WHEN max(abs(error)) <= 0.05 THEN 'pass' ELSE 'watch' END AS status FROM e")
def reconstruction_summary(s, d):
    return Z.error_summary(C.reanchored(X.index(s, d), X.weights(s, d), published(s, d)).withColumn("suite", F.lit("all")), ["suite"], 0.05)


@query(f"""WITH {X.CHAIN_ONE}, {PUBLISHED}, q AS (SELECT gg.date, b.value * g / pub.value AS ratio, row_number() OVER (ORDER BY gg.date DESC) AS back FROM gg JOIN pub b ON month(b.date) = 12 AND year(b.date) + 1 = gg.year JOIN pub ON pub.date = gg.date),
w AS (SELECT q.*, n AS "window" FROM q, (SELECT unnest([12, 24, 36]) AS n) WHERE back <= n), m AS (SELECT "window", median(ratio) AS mid, count(*) AS n FROM w GROUP BY 1)
SELECT 'all' AS suite, CAST(w."window" AS INTEGER) AS "window", CASE WHEN max(n) = w."window" THEN {r('max(abs(ratio / mid - 1))')} END AS drift, CASE WHEN max(n) = w."window" THEN max(abs(ratio / mid - 1)) > 0.01 END AS flagged FROM w JOIN m ON m."window" = w."window" GROUP BY w."window" """)
def comparability_windows(s, d):
    return Z.comparability(C.reanchored(X.index(s, d), X.weights(s, d), published(s, d)).withColumn("suite", F.lit("all")), ["suite"])


TWO = X.WEIGHTS.replace("idx AS (", "idx0 AS (", 1).replace("wts AS (", "wts0 AS (", 1)


@query(
    f"WITH {X.CHAIN_ONE}, "
    + "sub AS (SELECT * FROM idx WHERE series IN ('ASIA', 'EUROPE')), sdec AS (SELECT series, year(date) + 1 AS year, value AS december FROM sub WHERE month(date) = 12), "
    + "sshr AS (SELECT year, series, w / sum(w) OVER (PARTITION BY year) AS share FROM wts WHERE series IN ('ASIA', 'EUROPE')), "
    + "sg AS (SELECT year(sub.date) AS year, sub.date, sum(share * value / december) AS g FROM sub JOIN sdec ON sdec.series = sub.series AND sdec.year = year(sub.date) JOIN sshr ON sshr.series = sub.series AND sshr.year = year(sub.date) GROUP BY ALL HAVING count(*) = 2), "
    + "sa AS (SELECT year + 1 AS year, exp(sum(ln(g)) OVER (ORDER BY year)) AS anchor FROM sg WHERE month(date) = 12), "
    + "m AS (SELECT series, date, value FROM idx WHERE series NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'EURASIA', sg.date, 100 * coalesce(anchor, 1) * g FROM sg LEFT JOIN sa ON sa.year = sg.year UNION ALL SELECT 'EURASIA', make_date(CAST(min(year(date)) AS INTEGER), 12, 1), 100 FROM idx), "
    + "mw AS (SELECT year, CASE WHEN series IN ('ASIA', 'EUROPE') THEN 'EURASIA' ELSE series END AS series, sum(w) AS w FROM wts GROUP BY ALL), "
    + "md AS (SELECT series, year(date) + 1 AS year, value AS december FROM m WHERE month(date) = 12), ms AS (SELECT year, series, w / sum(w) OVER (PARTITION BY year) AS share FROM mw), "
    + "mg AS (SELECT year(m.date) AS year, m.date, sum(share * value / december) AS g FROM m JOIN md ON md.series = m.series AND md.year = year(m.date) JOIN ms ON ms.series = m.series AND ms.year = year(m.date) GROUP BY ALL HAVING count(*) = 4), "
    + "ma AS (SELECT year + 1 AS year, exp(sum(ln(g)) OVER (ORDER BY year)) AS anchor FROM mg WHERE month(date) = 12) "
    + f"SELECT mg.date, {r('100 * coalesce(anchor, 1) * g')} AS value, {r('g')} AS g FROM mg LEFT JOIN ma ON ma.year = mg.year"
)
def two_stage_chain(s, d):
    return C.two_stage_chain(X.index(s, d), X.weights(s, d), ["ASIA", "EUROPE"], "EURASIA")


@query(f"WITH {X.WEIGHTS} SELECT year, series, {r('w')} AS w, {r('w / sum(w) OVER (PARTITION BY year)')} AS share FROM wts WHERE series <> 'ASIA'")
def weight_renormalise(s, d):
    return C.renormalise(X.weights(s, d).filter("series <> 'ASIA'"))


@query(f"WITH {X.WEIGHTS} SELECT year, {r('sum(w)')} AS weight_sum, count(w) AS n, {r('sum(w) - 1000')} AS error, CASE WHEN year < 1997 THEN 'not guarded' WHEN abs(sum(w) - 1000) <= 0.5 THEN 'ok' ELSE 'broken' END AS status FROM wts GROUP BY year")
def weight_identity(s, d):
    return C.weight_identity(X.weights(s, d), guarded_from=1997)


@query(f"WITH {X.WEIGHTS} SELECT year, series, {r('w')} AS w FROM wts UNION ALL SELECT CAST(y AS INTEGER), series, {r('w')} FROM wts, (SELECT unnest(range(2002, 2005)) AS y) WHERE year = (SELECT max(year) FROM wts)")
def weight_carry_forward(s, d):
    return C.carry_weights(X.weights(s, d), 2004).select("year", "series", "w")


@query(f"WITH {X.WEIGHTS} SELECT year, series, {r('w')} AS w, {r('100 * w / sum(w) OVER (PARTITION BY year)')} AS pct FROM wts")
def weight_shares(s, d):
    return C.weight_shares(X.weights(s, d))


@query(f"WITH {X.CHAIN_ONE}, {PUBLISHED}, t2 AS (SELECT series, terms.date, term / total * pub.value AS term, pub.value AS total FROM terms JOIN pub ON pub.date = terms.date) " + YOY.format(k="", on="", c=_C, y=_Y).replace("terms a", "t2 a").replace("terms b", "t2 b"))
def official_rescaled_contrib(s, d):
    return C.official_contributions(C.chain_terms(X.index(s, d), X.weights(s, d)), published(s, d))


@query(f"WITH {X.INDEX}, p AS (SELECT i.series, i.date, i.value * 2 + 100 AS value FROM idx i), a AS (SELECT p.series, max(p.date) AS anchor_date, max_by(i.value / p.value, p.date) AS ratio FROM p JOIN idx i ON i.series = p.series AND i.date = p.date WHERE p.date < DATE '2000-01-01' GROUP BY 1) SELECT p.series, p.date, anchor_date, {r('p.value * ratio')} AS value FROM p JOIN a ON a.series = p.series")
def rebase_at_anchor(s, d):
    level = X.index(s, d)
    path = level.withColumn("value", F.col("value") * 2 + 100)
    return C.rebase_at_anchor(path, level, ["series"], F.lit("2000-01-01").cast("date"))


# Draws


@query(f"WITH {X.CUBE} SELECT series, date, {fan_sql('value')} FROM cube GROUP BY 1, 2", digits=2)
def fan_quantiles(s, d):
    return A.fan(X.cube(s, d), ["series", "date"])


@query(f"WITH {X.CUBE} SELECT series, date, CAST(p AS INTEGER) AS p, {r('list_extract(q, p)', 2)} AS value FROM (SELECT series, date, quantile_cont(value, {[i / 100 for i in range(1, 100)]}) AS q FROM cube GROUP BY 1, 2), (SELECT unnest(range(1, 100)) AS p)", digits=2)
def percentile_grid(s, d):
    return A.percentile_grid(X.cube(s, d), ["series", "date"])


@query(f"WITH {X.CUBE}, x AS (SELECT series, date, value * (1 + draw / 1000.0) - value AS e FROM cube) SELECT series, date, {fan_sql('e')} FROM x GROUP BY 1, 2", digits=2)
def paired_impact_fan(s, d):
    base = X.cube(s, d)
    return A.paired_fan(base, base.withColumn("value", F.col("value") * (1 + F.col("draw") / 1000.0)), ["series", "date"])


@query(f"WITH {X.CUBE} SELECT 'narrow' AS contract, series, date, {r('quantile_cont(value, 0.25)', 2)} AS low, {r('quantile_cont(value, 0.75)', 2)} AS high FROM cube GROUP BY ALL UNION ALL SELECT 'wide', series, date, {r('quantile_cont(value, 0.05)', 2)}, {r('quantile_cont(value, 0.95)', 2)} FROM cube GROUP BY ALL", digits=2)
def fan_compare_contracts(s, d):
    parts = [A.fan(X.cube(s, d), ["series", "date"], (lo, hi)).select(F.lit(name).alias("contract"), "series", "date", F.col(A.names([lo])[0]).alias("low"), F.col(A.names([hi])[0]).alias("high")) for name, lo, hi in (("narrow", 0.25, 0.75), ("wide", 0.05, 0.95))]
    return parts[0].unionByName(parts[1])


OKAY = "okay AS (SELECT draw, series FROM sparse GROUP BY 1, 2 HAVING bool_and(value > 0))"


@query(f"WITH {X.SPARSE}, {OKAY} SELECT series, draw FROM okay")
def admissible_draws(s, d):
    return A.admissible(X.sparse_cube(s, d), ["series"])


@query(f"WITH {X.SPARSE}, {OKAY} SELECT a.series, count(*) AS draws, count(okay.draw) AS kept, {r('1 - count(okay.draw) / count(*)')} AS rejected FROM (SELECT DISTINCT series, draw FROM sparse) a LEFT JOIN okay ON okay.series = a.series AND okay.draw = a.draw GROUP BY 1")
def rejection_rate(s, d):
    return A.rejection_rate(X.sparse_cube(s, d), ["series"])


POOLS = "pools AS (SELECT n_name AS model, draw FROM nation, (SELECT unnest(range(0, 40)) AS draw) WHERE draw < 20 + n_nationkey), ranked AS (SELECT model, draw, row_number() OVER (PARTITION BY model ORDER BY (draw * 7919 + 42 * 104729) % 100003, draw) - 1 AS rank, count(*) OVER (PARTITION BY model) AS size FROM pools), pair AS (SELECT i AS pair_id, r.model, r.draw FROM (SELECT unnest(range(0, 30)) AS i), ranked r WHERE i % size = rank)"


def pools(s, d):
    return X.table(s, d, "nation").select(F.col("n_name").alias("model"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw"), "n_nationkey").filter("draw < 20 + n_nationkey").select("model", "draw")


@query(f"WITH {POOLS} SELECT CAST(pair_id AS BIGINT) AS pair_id, model, CAST(draw AS INTEGER) AS draw FROM pair")
def draw_pairing(s, d):
    return A.draw_pairing(pools(s, d), 30, 42)


@query(f"WITH {POOLS} SELECT CAST(f.k AS BIGINT) AS pair_id, CAST(f.m AS BIGINT) AS middle, model, CAST(draw AS INTEGER) AS draw FROM (SELECT k, (k * 7 + 3) % 30 AS m FROM (SELECT unnest(range(0, 10)) AS k)) f JOIN pair ON pair.pair_id = f.m")
def pairing_composition(s, d):
    final = s.range(10).select(F.col("id").alias("pair_id"), ((F.col("id") * 7 + 3) % 30).alias("draw"))
    return A.compose_pairing(final, A.draw_pairing(pools(s, d), 30, 42))


@query(f"WITH {X.CUBE}, q AS (SELECT series, draw, row_number() OVER (PARTITION BY series ORDER BY draw) - 1 AS pos FROM (SELECT DISTINCT series, draw FROM cube)) SELECT series, draw FROM q WHERE pos IN (SELECT i * 49 // 11 FROM (SELECT unnest(range(0, 12)) AS i))")
def even_draw_subset(s, d):
    return A.even_subset(X.cube(s, d), 12, ["series"])


@query(f"WITH {POOLS} SELECT model, CAST(draw AS INTEGER) AS draw FROM ranked WHERE rank < 8")
def random_draw_subset(s, d):
    return A.random_subset(pools(s, d), 8, 42, ["model"])


@query(f"WITH {X.CUBE} SELECT series, date, {r('avg(CASE WHEN value > 150000 THEN 1.0 ELSE 0.0 END)')} AS share FROM cube GROUP BY 1, 2")
def share_above(s, d):
    return A.share_where(X.cube(s, d), ["series", "date"], F.col("value") > 150000)


@query(f"WITH {X.CUBE} SELECT series, {r('avg(value)', 2)} AS mean, {r('quantile_cont(value, 0.5)', 2)} AS median, {r('stddev_samp(value)', 2)} AS sd, {r('quantile_cont(value, 0.05)', 2)} AS q05, {r('quantile_cont(value, 0.95)', 2)} AS q95, count(*) AS n_draws FROM cube GROUP BY 1", digits=2)
def parameter_summary(s, d):
    return Z.parameter_summary(X.cube(s, d), ["series"])


@query(f"WITH {X.CUBE}, q AS (SELECT series, date, median(exp(ln(value) / 2)) AS q50, quantile_cont(exp(ln(value) / 2), 0.16) AS q16, quantile_cont(exp(ln(value) / 2), 0.84) AS q84 FROM cube GROUP BY 1, 2) SELECT series, date, {r('q16')} AS q16, {r('q50')} AS q50, {r('q84')} AS q84 FROM q")
def volatility_summary(s, d):
    return A.fan(X.cube(s, d).withColumn("value", F.exp(F.log("value") / 2)), ["series", "date"], (0.16, 0.5, 0.84)).drop("mean", "n_draws")


# Calendar


@query(f"WITH {X.DAILY} SELECT series, CAST(date_trunc('week', date) AS DATE) AS date, {r('avg(value)')} AS value, count(value) AS n FROM daily GROUP BY 1, 2")
def weekly_mean(s, d):
    return T.period_mean(X.daily(s, d), ["series"], "week")


@query(f"WITH {X.DAILY} SELECT series, CAST(date_trunc('week', date) AS DATE) AS date, {r('max_by(value, date)')} AS value FROM daily GROUP BY 1, 2")
def weekly_last(s, d):
    return T.period_last(X.daily(s, d), ["series"], "week")


@query(f"WITH {X.WEEKLY} SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, {r('avg(value)')} AS value, count(value) AS n FROM weekly GROUP BY 1, 2")
def monthly_mean(s, d):
    return T.period_mean(X.weekly(s, d), ["series"], "month")


HOLES = "holes AS (SELECT series, date, value FROM idx WHERE (year(date) * 12 + month(date)) % 7 <> 3), span AS (SELECT series, min(date) AS lo, max(date) AS hi FROM holes GROUP BY 1), grid AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM span), reg AS (SELECT grid.series, grid.date, value FROM grid LEFT JOIN holes ON holes.series = grid.series AND holes.date = grid.date)"


def holes(s, d):
    """The index without every seventh month."""
    return X.index(s, d).filter((F.year("date") * 12 + F.month("date")) % 7 != 3)


@query(f"WITH {X.INDEX}, {HOLES} SELECT series, date, {r('value')} AS value FROM reg")
def regular_calendar(s, d):
    return T.regularise(holes(s, d), ["series"])


@query(f"WITH {X.INDEX}, {HOLES} SELECT series, date FROM reg WHERE value IS NULL")
def calendar_gaps(s, d):
    return T.calendar_gaps(holes(s, d), ["series"])


@query(f"WITH {X.WEEKLY} SELECT series, CAST(date + INTERVAL 7 DAY AS DATE) AS date, {r('value')} AS value FROM weekly")
def label_shift(s, d):
    return T.label_shift(X.weekly(s, d), 1)


HALF = "half AS (SELECT date, vat AS value FROM tax WHERE month(date) IN (1, 7)), hg AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM half), DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS date), hs AS (SELECT hg.date, value, half.date AS src FROM hg ASOF JOIN half ON hg.date >= half.date), he AS (SELECT date, value, greatest(0, datediff('month', src, date) - 5) AS carried FROM hs)"


@query(f"WITH {X.TAX}, {HALF} SELECT 'vat' AS series, date, {r('value')} AS value, CAST(carried AS INTEGER) AS carried, CASE WHEN carried > 12 THEN 'error' WHEN carried > 6 THEN 'warn' ELSE 'ok' END AS status FROM he")
def semester_expand(s, d):
    half = X.tax(s, d).filter(F.month("date").isin(1, 7)).select(F.lit("vat").alias("series"), "date", F.col("vat").alias("value"))
    return T.semester_expand(half, ["series"], "2002-12-01")


@query(f"WITH {X.WEEKLY}, days AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date FROM weekly GROUP BY 1, 2) SELECT days.series, days.date, {r('weekly.value')} AS value FROM days ASOF LEFT JOIN weekly ON weekly.series = days.series AND days.date >= weekly.date")
def ffill_union(s, d):
    weekly = X.weekly(s, d)
    return T.forward_fill(weekly, ["series"], weekly.select("series", F.trunc("date", "month").alias("date")).distinct()).select("series", "date", "value")


@query(f"WITH {X.INDEX}, {HOLES} SELECT a.series, a.date, {r('coalesce(a.value, b.value + (c.value - b.value) * datediff($$day$$, b.date, a.date) / datediff($$day$$, b.date, c.date))').replace('$$', chr(39))} AS value FROM reg a ASOF LEFT JOIN holes b ON b.series = a.series AND a.date >= b.date ASOF LEFT JOIN holes c ON c.series = a.series AND a.date <= c.date")
def interior_interpolate(s, d):
    return T.interpolate_interior(T.regularise(holes(s, d), ["series"]), ["series"]).select("series", "date", "value")


MON = "SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value, count(value) AS n, (SELECT count(*) FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(weekly.date)) AS DATE), last_day(min(weekly.date)), INTERVAL 1 DAY)) AS x) WHERE isodow(x) = 1) AS expected FROM weekly GROUP BY 1, 2"


@query(f"WITH {X.WEEKLY}, cal AS (SELECT CAST(date_trunc('month', x) AS DATE) AS date, count(*) AS expected FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2010-12-31', INTERVAL 1 DAY)) AS x) WHERE isodow(x) = 1 GROUP BY 1), m AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value, count(value) AS n FROM weekly GROUP BY 1, 2) SELECT series, m.date, {r('value')} AS value, n, CAST(expected AS INTEGER) AS expected FROM m JOIN cal ON cal.date = m.date WHERE n = expected")
def complete_month_mean(s, d):
    return T.complete_month_mean(X.weekly(s, d), ["series"])


COVER = "cn AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS period, count(*) AS n FROM weekly GROUP BY 1, 2), cr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS back FROM cn), ce AS (SELECT series, greatest(round_even(quantile_cont(n, 0.5), 0), 1) AS expected FROM cr WHERE back BETWEEN 2 AND 25 GROUP BY 1), cov AS (SELECT cr.series, period, n, expected, n / expected AS ratio, n / expected >= 0.8 AS complete FROM cr JOIN ce ON ce.series = cr.series WHERE back = 1)"


@query(f"WITH {X.WEEKLY}, {COVER} SELECT series, period, n, {r('expected')} AS expected, {r('ratio')} AS ratio, complete FROM cov")
def period_coverage(s, d):
    return T.period_coverage(X.weekly(s, d), ["series"])


@query(f"WITH {X.WEEKLY}, {COVER}, m AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value FROM weekly GROUP BY 1, 2) SELECT m.series, m.date, CASE WHEN cov.series IS NULL THEN {r('value')} END AS value FROM m LEFT JOIN cov ON cov.series = m.series AND cov.period = m.date AND NOT complete")
def mask_partial(s, d):
    weekly = X.weekly(s, d)
    return T.mask_partial(T.period_mean(weekly, ["series"], "month").drop("n"), ["series"], T.period_coverage(weekly, ["series"]))


@query(f"WITH {X.WEEKLY}, p AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, count(value) AS k, avg(value) AS m, max_by(value, date) AS x FROM weekly GROUP BY 1, 2) SELECT series, date, {r('(k * m + (5 - k) * x) / 5')} AS mean, CASE WHEN k = 5 THEN 0 ELSE {r('4.0 / 25 * ((5 - k) * (6 - k) * (11 - 2 * k) / 6)')} END AS variance FROM p")
def partial_period_estimate(s, d):
    p = X.weekly(s, d).groupBy("series", F.trunc("date", "month").alias("date")).agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.max_by("value", "date").alias("x"))
    mean, var = T.partial_estimate(F.lit(5), F.col("k"), F.col("m"), F.col("x"), F.lit(4.0))
    return p.select("series", "date", mean.alias("mean"), var.alias("variance"))


@query(f"WITH {X.INDEX} SELECT series, date, CASE WHEN date <= DATE '2000-06-01' THEN 'observed' WHEN date < DATE '2000-09-01' THEN 'nowcast' ELSE 'forecast' END AS segment FROM idx")
def segment_labels(s, d):
    cut = lambda x: F.lit(x).cast("date")
    return X.index(s, d).select("series", "date", T.segment(F.col("date"), cut("2000-06-01"), cut("2000-09-01")).alias("segment"))


@query(f"WITH {X.INDEX}, e AS (SELECT series, max(date) AS hi FROM idx GROUP BY 1) SELECT series, 'M+' || h AS label, CAST(h AS INTEGER) AS h, CAST(DATE '2001-01-01' + h * INTERVAL 1 MONTH AS DATE) AS target FROM e, (SELECT unnest([1, 2, 3, 6, 12]) AS h) WHERE h <= 3 OR DATE '2001-01-01' + h * INTERVAL 1 MONTH <= hi")
def short_horizons(s, d):
    return T.horizons(X.index(s, d), ["series"], "2001-01-01")


@query(f"WITH {X.INDEX} SELECT series, date, {r('value')} AS value, CASE WHEN count(value) OVER w = 12 THEN {r('sum(value) OVER w')} END AS rolled FROM idx WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_sum_12(s, d):
    return T.rolling_sum(X.index(s, d), ["series"])


@query(f"WITH {X.INDEX}, p AS (SELECT * FROM idx WHERE date >= DATE '1998-01-01'), q AS (SELECT series, date, value * 3 AS value FROM idx), a AS (SELECT p.series, min(p.date) AS start, min_by(p.value / q.value, p.date) AS ratio FROM p JOIN q ON q.series = p.series AND q.date = p.date GROUP BY 1) SELECT q.series, q.date, CASE WHEN q.date < start THEN {r('q.value * ratio')} ELSE {r('p.value')} END AS value FROM q JOIN a ON a.series = q.series LEFT JOIN p ON p.series = q.series AND p.date = q.date")
def backward_splice(s, d):
    level = X.index(s, d)
    return T.backward_splice(level.filter("date >= '1998-01-01'"), level.withColumn("value", F.col("value") * 3), ["series"])


@query(f"WITH {X.INDEX}, g AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY series ORDER BY date)) AS lg FROM idx) SELECT series, date, {r('value')} AS value, {r('100 * exp(sum(coalesce(lg, 0)) OVER (PARTITION BY series ORDER BY date))')} AS level FROM g")
def growth_reanchor(s, d):
    return T.growth_reanchor(X.index(s, d), ["series"], F.lit(100.0))


@query(f"WITH {X.INDEX}, k AS (SELECT series, date, CASE WHEN date < DATE '2001-01-01' THEN value END AS value FROM idx), e AS (SELECT series, max_by(value, date) AS last, max(date) AS edge FROM k WHERE value IS NOT NULL GROUP BY 1) SELECT k.series, k.date, CASE WHEN k.date > edge THEN {r('last')} ELSE {r('value')} END AS value FROM k JOIN e ON e.series = k.series")
def carry_edge(s, d):
    return T.carry_edge(X.index(s, d).withColumn("value", F.when(F.col("date") < "2001-01-01", F.col("value"))), ["series"])


@query(f"WITH {X.INDEX} SELECT series, date, {r('value')} AS value, {r('ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY date))')} AS change FROM idx")
def log_differences(s, d):
    return T.change(X.index(s, d), ["series"], 1, "logdiff")


@query(f"WITH {X.INDEX} SELECT DISTINCT date, " + ", ".join(f"CASE WHEN month(date) = {m} THEN 1.0 ELSE 0.0 END AS m{m:02d}" for m in range(1, 12)) + " FROM idx")
def seasonal_dummies(s, d):
    return X.index(s, d).select("date").distinct().select("date", *S.seasonal_dummies(F.col("date")))


# Joins and sets


@query(f"WITH {X.INDEX}, t AS (SELECT series, CAST(max(date) + h * INTERVAL 1 MONTH + INTERVAL 9 DAY AS DATE) AS target FROM idx, (SELECT unnest([-12, -3, 0, 1]) AS h) GROUP BY series, h), m AS (SELECT t.series, target, date, value, abs(datediff('day', target, date)) AS days FROM t JOIN idx ON idx.series = t.series AND abs(datediff('day', target, date)) <= 20), b AS (SELECT *, row_number() OVER (PARTITION BY series, target ORDER BY days, date) AS k FROM m) SELECT t.series, t.target, b.date, {r('b.value')} AS value, CAST(b.days AS INTEGER) AS days FROM t LEFT JOIN b ON b.series = t.series AND b.target = t.target AND k = 1")
def nearest_target_join(s, d):
    level = X.index(s, d)
    ends = level.groupBy("series").agg(F.max("date").alias("end")).withColumn("h", F.explode(F.array(*[F.lit(h) for h in (-12, -3, 0, 1)])))
    return J.nearest(ends.select("series", F.date_add(F.add_months("end", F.col("h")), 9).alias("target")), level, ["series"])


@query(f"WITH {X.INDEX} SELECT date FROM idx GROUP BY 1 HAVING count(DISTINCT series) = 5")
def common_dates(s, d):
    return J.common_dates(X.index(s, d), ["series"])


@query(f"WITH {X.INDEX}, a AS (SELECT date, value FROM idx WHERE series = 'ASIA' AND date >= DATE '1996-01-01'), e AS (SELECT date, value FROM idx WHERE series = 'EUROPE') SELECT coalesce(a.date, e.date) AS date, {r('a.value')} AS asia, {r('e.value')} AS europe FROM a FULL JOIN e ON e.date = a.date")
def outer_align(s, d):
    level = X.index(s, d)
    return J.outer_align({"asia": level.filter("series = 'ASIA' and date >= '1996-01-01'"), "europe": level.filter("series = 'EUROPE'")})


@query("SELECT CAST(n_nationkey AS INTEGER) AS code, 'missing' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey + 1 FROM supplier) UNION ALL SELECT DISTINCT s_nationkey + 1, 'unexpected' FROM supplier WHERE s_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)")
def contract_code_diff(s, d):
    # Codes that count from 1 against a contract that counts from 0.
    found = X.table(s, d, "supplier").select((F.col("s_nationkey") + 1).alias("code"))
    return J.code_differences(found, X.table(s, d, "nation").select(F.col("n_nationkey").alias("code")), "code")


@query("SELECT CAST(ts AS DATE) AS date, event_type AS series, count(DISTINCT round(value, 0)) AS \"values\", count(*) AS rows FROM events GROUP BY 1, 2 HAVING count(DISTINCT round(value, 0)) > 1")
def dedupe_conflicts(s, d):
    rows = X.table(s, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("series"), F.round("value", 0).alias("value"))
    return J.dedupe(rows, ["date", "series"])[1]


@query(f"WITH {X.WEEKLY}, a AS (SELECT * FROM weekly WHERE date < DATE '1998-01-01'), b AS (SELECT series, date, value + 1 AS value FROM weekly WHERE date >= DATE '1997-01-01') SELECT series, date, {r('value')} AS value FROM a UNION ALL SELECT series, date, {r('value')} FROM b WHERE date >= DATE '1998-01-01'")
def union_first(s, d):
    weekly = X.weekly(s, d)
    return J.union_first([weekly.filter("date < '1998-01-01'"), weekly.filter("date >= '1997-01-01'").withColumn("value", F.col("value") + 1)], ["series", "date"])


@query(f"WITH {X.INDEX} SELECT series, date, {r('value')} AS value, 'kept' AS owner FROM idx WHERE series <> 'ASIA' UNION ALL SELECT series, date, {r('value * 2')}, 'new' FROM idx WHERE series = 'ASIA'")
def append_owned_rows(s, d):
    level = X.index(s, d).withColumn("owner", F.lit("kept"))
    new = level.filter("series = 'ASIA'").withColumn("value", F.col("value") * 2).withColumn("owner", F.lit("new"))
    return J.replace_owned(level, new, F.col("series") == "ASIA")


@query("WITH j AS (SELECT sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS x FROM orders) SELECT count(*) AS rows, CAST(sum(CAST('0x' || x[1:15] AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || x[16:30] AS BIGINT)) AS VARCHAR) AS signature FROM j")
def scenario_signature(s, d):
    return J.table_signature(X.table(s, d, "orders").select("o_orderkey", "o_orderstatus"))


@query(f"WITH {X.INDEX}, k AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY date) AS k FROM idx) SELECT series, date, {r('value')} AS value FROM k WHERE k <= 12")
def horizon_cap(s, d):
    return J.horizon_cap(X.index(s, d), ["series"], 12)


@query("WITH m AS (SELECT p_brand AS series, p_type AS metric, count(*) AS n FROM part GROUP BY 1, 2), f AS (SELECT *, list_position((SELECT list(t ORDER BY t) FROM (SELECT DISTINCT p_type AS t FROM part)), metric) AS p FROM m) SELECT series, metric, n FROM f QUALIFY p = min(p) OVER (PARTITION BY series)")
def preferred_metric(s, d):
    part = X.table(s, d, "part").select(F.col("p_brand").alias("series"), F.col("p_type").alias("metric"))
    # A metric's place in the order of preference is its own name here.
    order = part.select("metric", F.col("metric").alias("place")).distinct()
    return J.preferred(part.groupBy("series", "metric").agg(F.count("*").alias("n")), ["series"], "metric", order)


@query(f"WITH {X.INDEX}, l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS p FROM idx) SELECT series, max(date) AS date, {r('max_by(value, date)')} AS value, {r('max_by(value - p, date)')} AS change FROM l GROUP BY 1")
def latest_change(s, d):
    return J.latest_change(X.index(s, d), ["series"])


# Taxes

TAXED = "taxed AS (SELECT idx.series, idx.date, idx.value / 1000 AS idx, tax.vat, tax.excise FROM idx JOIN tax ON tax.date = idx.date)"


def taxed(s, d):
    """Index in thousands with the month's taxes."""
    return X.index(s, d).join(X.tax(s, d), "date").select("series", "date", (F.col("value") / 1000).alias("idx"), "vat", "excise")


@query(f"WITH {X.INDEX}, {X.TAX}, {TAXED} SELECT series, date, {r('1.5 * idx / (1 + vat / 100) - excise')} AS pre_tax FROM taxed")
def tax_pretax(s, d):
    return taxed(s, d).select("series", "date", P.pre_tax(F.col("idx"), F.lit(1.5), F.col("vat"), F.col("excise")).alias("pre_tax"))


@query(f"WITH {X.INDEX}, {X.TAX}, {TAXED} SELECT series, date, {r('(idx + excise) * (1 + vat / 100) / 1.5')} AS value FROM taxed")
def tax_reattribute(s, d):
    return taxed(s, d).select("series", "date", P.index_with_tax(F.col("idx"), F.lit(1.5), F.col("vat"), F.col("excise")).alias("value"))


@query(f"WITH {X.INDEX}, {X.TAX}, {TAXED} SELECT series, count(*) AS n, {r('max(abs((1.5 * idx / (1 + vat / 100) - excise + excise) * (1 + vat / 100) / 1.5 - idx))')} AS gap, max(abs((1.5 * idx / (1 + vat / 100) - excise + excise) * (1 + vat / 100) / 1.5 - idx)) <= 1e-10 * max(abs(idx)) AS within FROM taxed GROUP BY 1")
def tax_round_trip(s, d):
    t = taxed(s, d).withColumn("pre", P.pre_tax(F.col("idx"), F.lit(1.5), F.col("vat"), F.col("excise")))
    back = P.index_with_tax(F.col("pre"), F.lit(1.5), F.col("vat"), F.col("excise"))
    return t.groupBy("series").agg(F.count("*").alias("n"), F.max(F.abs(back - F.col("idx"))).alias("gap"), (F.max(F.abs(back - F.col("idx"))) <= 1e-10 * F.max(F.abs("idx"))).alias("within"))


@query(f"WITH {X.TAX} SELECT date, {r('vat')} AS vat, {r('excise')} AS excise, date >= DATE '2000-01-01' AS scenario_active, CASE WHEN date >= DATE '2000-01-01' THEN 7.0 ELSE {r('vat')} END AS scenario_vat, CASE WHEN date >= DATE '2000-01-01' THEN {r('excise + 5')} ELSE {r('excise')} END AS scenario_excise FROM tax")
def tax_scenario_overlay(s, d):
    return P.overlay(X.tax(s, d), "2000-01-01", F.lit(7.0), F.col("excise") + 5)


@query(f"WITH {X.INDEX}, l AS (SELECT series, max_by(value, date) AS value FROM idx GROUP BY 1) SELECT series, CAST(h AS INTEGER) AS h, CASE WHEN h BETWEEN 2 AND 5 THEN {r('value * 1.1')} END AS value FROM l, (SELECT unnest(range(1, 9)) AS h)")
def condition_path(s, d):
    last = X.index(s, d).groupBy("series").agg(F.max_by("value", "date").alias("value"))
    return P.condition_path(last, ["series"], 8, 2, 5, 10.0)


LAYERED = "lay AS (SELECT series, date, CASE WHEN told THEN greatest(0.0, least(1.0, pre / gross)) ELSE 0.0 END AS pre_tax, CASE WHEN told THEN greatest(0.0, least(1.0, (pre + excise) / gross)) - greatest(0.0, least(1.0, pre / gross)) ELSE 0.0 END AS excise, CASE WHEN told THEN 1 - greatest(0.0, least(1.0, (pre + excise) / gross)) ELSE 0.0 END AS vat, CASE WHEN told THEN 0.0 ELSE 1.0 END AS unsplit FROM (SELECT series, date, idx AS pre, excise, (idx + excise) * (1 + vat / 100) AS gross, (idx + excise) * (1 + vat / 100) > 0 AND series <> 'ASIA' AS told FROM taxed))"


def layered(s, d):
    """Layer shares; ASIA's can't be told."""
    t = taxed(s, d).withColumn("idx", F.when(F.col("series") != "ASIA", F.col("idx")))
    return t.select("series", "date", *P.layer_shares(F.col("idx"), F.col("vat"), F.col("excise")))


@query(f"WITH {X.INDEX}, {X.TAX}, {TAXED}, {LAYERED} SELECT series, date, {r('pre_tax')} AS pre_tax, {r('excise')} AS excise, {r('vat')} AS vat, {r('unsplit')} AS unsplit FROM lay")
def tax_layer_shares(s, d):
    return layered(s, d)


_SHARES = "j AS (SELECT terms.series, terms.date, term, total, coalesce(pre_tax, 0) AS pre_tax, coalesce(excise, 0) AS excise, coalesce(vat, 0) AS vat, coalesce(unsplit, 1) AS unsplit FROM terms LEFT JOIN lay ON lay.series = terms.series AND lay.date = terms.date)"
_LAYER = "k AS (SELECT a.series, a.date, a.unsplit = 0 AND b.unsplit = 0 AS told, " + ", ".join(f"100 * (a.term * a.{n} - b.term * b.{n}) / b.total AS {n}" for n in P.LAYERS[:-1]) + ", 100 * (a.term - b.term) / b.total AS whole FROM j a JOIN j b ON a.series = b.series AND a.date = b.date + INTERVAL 12 MONTH)"
_LONG = "lc AS (" + " UNION ALL ".join(f"SELECT series, date, '{n}' AS layer, CASE WHEN told THEN {n} ELSE 0 END AS contribution FROM k" for n in P.LAYERS[:-1]) + " UNION ALL SELECT series, date, 'unsplit', CASE WHEN told THEN 0 ELSE whole END FROM k)"


@query(f"WITH {X.CHAIN_ONE}, {X.TAX}, {TAXED}, {LAYERED}, {_SHARES}, {_LAYER}, {_LONG} SELECT series, date, layer, {r('contribution')} AS contribution FROM lc")
def tax_layer_contrib(s, d):
    return P.layer_contributions(C.chain_terms(X.index(s, d), X.weights(s, d)), layered(s, d))


@query(f"WITH {X.CHAIN_ONE}, {X.TAX}, {TAXED}, {LAYERED}, {_SHARES}, {_LAYER}, {_LONG} SELECT coalesce(series, 'total') AS series, " + ", ".join(r(f"sum(CASE WHEN layer = '{n}' THEN contribution END)") + f" AS {n}" for n in P.LAYERS) + f", {r('sum(contribution)')} AS total FROM lc WHERE date = DATE '2000-06-01' GROUP BY ROLLUP (series)")
def tax_matrix(s, d):
    parts = P.layer_contributions(C.chain_terms(X.index(s, d), X.weights(s, d)), layered(s, d))
    return P.layer_matrix(parts.filter("date = '2000-06-01'"))


@query(f"WITH {X.INDEX} SELECT series, date, {r('ln(value)')} AS state, {r('value')} AS back, {r('value / 100')} AS share FROM idx")
def log_state_transform(s, d):
    v = F.col("value")
    return X.index(s, d).select("series", "date", S.to_state(v, "logdiff").alias("state"), S.from_state(S.to_state(v, "logdiff"), "logdiff").alias("back"), S.to_state(v, "percent_rate_diff").alias("share"))


# Statistics

PAIR = "pr AS (SELECT idx.series, idx.date, idx.value, p.value AS proxy FROM idx JOIN idx p ON p.date = idx.date AND p.series = 'EUROPE')"


def pair(s, d):
    level = X.index(s, d)
    return level.join(level.filter("series = 'EUROPE'").select("date", F.col("value").alias("proxy")), "date")


@query(f"WITH {X.INDEX}, {PAIR} SELECT series, count(*) AS n, CASE WHEN count(*) >= 6 THEN {r('sum(proxy * value) / sum(proxy * proxy)')} END AS slope FROM pr GROUP BY 1")
def ols_no_intercept(s, d):
    return Z.ols_origin(pair(s, d), ["series"], "proxy", "value")


_LAG = "PARTITION BY series ORDER BY date"


@query(f"WITH {X.INDEX}, {PAIR}, m AS (SELECT series, date, value / proxy AS ratio, ln(value) - ln(lag(value) OVER ({_LAG})) AS dy, ln(proxy) - ln(lag(proxy) OVER ({_LAG})) AS dx, value - lag(value) OVER ({_LAG}) AS ay, proxy - lag(proxy) OVER ({_LAG}) AS ax, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM pr), o AS (SELECT series, count(dx) AS n, sum(dx * dy) / sum(dx * dx) AS beta, corr(dx, dy) AS corr, sqrt(avg((dy - dx) * (dy - dx))) AS rmse, sum(ax * ay) / sum(ax * ax) AS beta_abs, max_by(ratio, date) / min_by(ratio, date) - 1 AS drift, max(ratio) / min(ratio) - 1 AS \"range\", stddev_samp(CASE WHEN back <= 36 THEN ratio END) / avg(CASE WHEN back <= 36 THEN ratio END) AS recent_cv FROM m GROUP BY 1) SELECT series, n, {r('beta')} AS beta, {r('corr')} AS corr, {r('rmse')} AS rmse, {r('beta_abs')} AS beta_abs, {r('drift')} AS drift, {r(chr(34) + 'range' + chr(34))} AS \"range\", {r('recent_cv')} AS recent_cv, corr >= 0.5 AND abs(beta - 1) <= 0.5 AS passes FROM o")
def proxy_diagnostics(s, d):
    return Z.proxy_diagnostics(pair(s, d), ["series"])


@query(f"WITH {X.INDEX}, p AS (SELECT idx.series, idx.date, idx.value, a.value AS own, b.value AS cross_ FROM idx JOIN idx a ON a.date = idx.date AND a.series = 'EUROPE' JOIN idx b ON b.date = idx.date AND b.series = 'ASIA' WHERE idx.series NOT IN ('ASIA', 'EUROPE')), m AS (SELECT series, ln(value) - ln(lag(value) OVER ({_LAG})) AS y, ln(own) - ln(lag(own) OVER ({_LAG})) AS a, ln(cross_) - ln(lag(cross_) OVER ({_LAG})) AS b FROM p) SELECT series, {r('corr(y, a)')} AS own_corr, {r('corr(y, b)')} AS cross_corr, {r('corr(y, a) - corr(y, b)')} AS margin, CASE WHEN corr(y, a) - corr(y, b) > 0 THEN 'ok' ELSE 'swapped' END AS status FROM m GROUP BY 1")
def mapping_check(s, d):
    level = X.index(s, d)
    other = lambda x, n: level.filter(F.col("series") == x).select("date", F.col("value").alias(n))
    return Z.mapping_check(level.filter("series not in ('ASIA', 'EUROPE')").join(other("EUROPE", "own"), "date").join(other("ASIA", "cross"), "date"), ["series"])


@query(f"WITH {X.INDEX}, {HOLES}, e AS (SELECT series, min(date) AS lo, max(date) AS hi FROM holes WHERE series <> 'ASIA' OR date < DATE '2001-01-01' GROUP BY 1), v AS (SELECT series, date, CASE WHEN series <> 'ASIA' OR date < DATE '2001-01-01' THEN value END AS value FROM reg) SELECT v.series, count(value) AS n, min(lo) AS first, max(hi) AS last, count(*) FILTER (value IS NULL AND date > lo AND date < hi) AS internal_gaps, count(*) FILTER (value IS NULL AND date < lo) AS leading, count(*) FILTER (value IS NULL AND date > hi) AS trailing, {r('100.0 * count(value) / count(*)')} AS coverage FROM v JOIN e ON e.series = v.series GROUP BY 1")
def missingness_audit(s, d):
    cut = F.when((F.col("series") != "ASIA") | (F.col("date") < "2001-01-01"), F.col("value"))
    return Z.missingness(T.regularise(holes(s, d), ["series"]).withColumn("value", cut), ["series"])


DLOG = f"dl AS (SELECT series, date, value FROM (SELECT series, date, ln(value) - ln(lag(value) OVER ({_LAG})) AS value FROM idx) WHERE value IS NOT NULL)"


def dlog(s, d):
    return T.change(X.index(s, d), ["series"], 1, "logdiff").select("series", "date", F.col("change").alias("value")).filter("value is not null")


@query(f"WITH {X.INDEX}, {DLOG}, m AS (SELECT *, avg(value) OVER (PARTITION BY series) AS m, lag(value) OVER ({_LAG}) AS l FROM dl) SELECT series, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, {r('skewness(value)')} AS skew, {r('kurtosis(value)')} AS kurtosis, {r('sum((value - m) * (l - m)) / sum((value - m) * (value - m))')} AS acf1, {r('max(abs(value))')} AS max_abs FROM m GROUP BY 1")
def residual_diagnostics(s, d):
    return Z.residual_diagnostics(dlog(s, d), ["series"])


@query(f"WITH {X.INDEX}, {DLOG}, c AS (SELECT series, date, value - avg(value) OVER (PARTITION BY series) AS c FROM dl) " + " UNION ALL ".join(f"SELECT series, CAST({k} AS INTEGER) AS lag, {r('sum(c * l) / sum(c * c)')} AS acf FROM (SELECT series, c, lag(c, {k}) OVER ({_LAG}) AS l FROM c) GROUP BY 1" for k in range(1, 7)))
def acf(s, d):
    return Z.acf(dlog(s, d), ["series"], 6)


@query(f"WITH {X.INDEX}, v AS (SELECT date, exp(avg(ln((value / m) * (value / m)))) AS stress FROM (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM idx) GROUP BY 1), q AS (SELECT 'p10' AS regime, quantile_cont(stress, 0.1) AS t FROM v UNION ALL SELECT 'p50', quantile_cont(stress, 0.5) FROM v UNION ALL SELECT 'p90', quantile_cont(stress, 0.9) FROM v UNION ALL SELECT 'peak', max(stress) FROM v) SELECT regime, date FROM (SELECT regime, date, row_number() OVER (PARTITION BY regime ORDER BY round(abs(ln(stress) - ln(t)), 12), date) AS k FROM v, q) WHERE k = 1")
def joint_stress_regime(s, d):
    return Z.regime_dates(Z.joint_stress(X.index(s, d), ["series"]))


OUT = "oc AS (SELECT cube.series, cube.date, draw, cube.value / 1000 AS value, idx.value / 1000 AS outcome FROM cube JOIN idx ON idx.series = cube.series AND idx.date = cube.date)"


def outcomes(s, d):
    level = X.index(s, d).select("series", "date", (F.col("value") / 1000).alias("outcome"))
    return X.cube(s, d).withColumn("value", F.col("value") / 1000).join(level, ["series", "date"])


@query(f"WITH {X.CUBE}, {OUT}, k AS (SELECT *, row_number() OVER (PARTITION BY series, date ORDER BY value) AS i, count(*) OVER (PARTITION BY series, date) AS n FROM oc) SELECT series, date, {r('avg(abs(value - outcome)) - sum((2 * i - n - 1) * value / (n * n))')} AS crps FROM k GROUP BY 1, 2")
def crps(s, d):
    return Z.crps(outcomes(s, d), ["series", "date"])


@query(f"WITH {X.CUBE}, {OUT}, h AS (SELECT series, date, count(*) AS n, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) * pow(count(*), -0.2) AS h FROM oc GROUP BY 1, 2) SELECT oc.series, oc.date, {r('ln(sum(exp(-0.5 * pow((outcome - value) / h, 2)))) - ln(max(n) * max(h) * sqrt(2 * pi()))')} AS log_score FROM oc JOIN h ON h.series = oc.series AND h.date = oc.date GROUP BY 1, 2")
def log_score(s, d):
    return Z.log_score(outcomes(s, d), ["series", "date"])


@query(f"WITH {X.INDEX}, n AS (SELECT *, row_number() OVER ({_LAG}) AS i, lead(value, 3) OVER ({_LAG}) AS ahead FROM idx), a AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) - 1 AS back FROM n WHERE i >= 36 AND ahead IS NOT NULL) SELECT series, date, CAST(i AS INTEGER) AS i FROM a WHERE back % 2 = 0 AND back < 12")
def oos_origins(s, d):
    return Z.oos_origins(X.index(s, d), ["series"], 36, 3, 2, 6)


SCALES = f"sc AS (SELECT series, count(*) AS n, regr_slope(value, x) AS phi, sqrt((regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / (count(*) - 2)) AS sigma FROM (SELECT series, value, lag(value) OVER ({_LAG}) AS x FROM dl) WHERE x IS NOT NULL GROUP BY 1)"


@query(f"WITH {X.INDEX}, {DLOG}, {SCALES} SELECT series, n, {r('phi')} AS phi, {r('sigma')} AS sigma FROM sc")
def ar1_scales(s, d):
    return Z.ar1_scales(dlog(s, d), ["series"])


@query(f"WITH {X.INDEX}, {DLOG}, {SCALES} SELECT a.series AS equation, b.series AS variable, CAST(l AS INTEGER) AS lag, CASE WHEN a.series = b.series THEN {r('0.2 / l')} ELSE {r('0.2 / l * 0.5 * a.sigma / b.sigma')} END AS sd FROM sc a, sc b, (SELECT unnest(range(1, 4)) AS l)")
def minnesota_prior(s, d):
    return Z.minnesota_prior(Z.ar1_scales(dlog(s, d), ["series"]), 3)


@query(f"WITH {X.CUBE}, e AS (SELECT series, cube.date, abs(cube.value - idx.value) / 1000 AS error FROM cube JOIN idx USING (series, date)) SELECT series, {r('quantile_cont(error, 0.5)', 3)} AS median, {r('quantile_cont(error, 0.95)', 3)} AS p95, {r('quantile_cont(error, 0.99)', 3)} AS p99, {r('max(error)', 3)} AS max FROM e GROUP BY 1", digits=3)
def projection_sweep(s, d):
    e = outcomes(s, d).withColumn("error", F.abs(F.col("value") - F.col("outcome"))).withColumn("place", F.col("date"))
    return Z.projection_sweep(e, ["series"]).drop("at")


@query(f"WITH {X.CHAIN_ONE}, w AS (SELECT date, value FROM chain), p AS (SELECT date, sum(term) AS parts FROM terms GROUP BY 1) SELECT w.date, {r('abs(parts - value)')} AS gap FROM w JOIN p ON p.date = w.date")
def displayed_additivity(s, d):
    terms = C.chain_terms(X.index(s, d), X.weights(s, d)).select("date", F.col("term").alias("value"))
    return Z.additivity_gap(terms, C.chain_link(X.index(s, d), X.weights(s, d)).select("date", "value"))


# Registry


@query(f"WITH {X.RUNS} SELECT model_id, count(*) AS runs, count(DISTINCT vintage) AS vintages, count(*) FILTER (promoted = 1) AS promoted, max(vintage) AS latest FROM runs GROUP BY 1")
def run_coverage(s, d):
    return R.run_coverage(X.runs(s, d))


@query(f"WITH {X.RUNS} SELECT vintage, bool_or(model_id = 'Brand#11') AS \"Brand#11\", bool_or(model_id = 'Brand#22') AS \"Brand#22\" FROM runs GROUP BY 1")
def vintage_matrix(s, d):
    return R.vintage_matrix(X.runs(s, d), ["Brand#11", "Brand#22"])


@query(f"WITH {X.RUNS} SELECT vintage, CAST(row_number() OVER (ORDER BY vintage DESC) AS INTEGER) AS rank FROM (SELECT vintage FROM runs WHERE model_id IN ('Brand#11', 'Brand#22') GROUP BY 1 HAVING count(DISTINCT model_id) = 2)")
def common_vintage(s, d):
    return R.common_vintages(X.runs(s, d), ["Brand#11", "Brand#22"])


@query(f"WITH {X.RUNS}, k AS (SELECT model_id, vintage FROM runs WHERE run_id = 'r5') SELECT runs.model_id, runs.vintage, run_id, created, CASE WHEN k.model_id IS NULL THEN promoted WHEN run_id = 'r5' THEN 1 ELSE 0 END AS promoted FROM runs LEFT JOIN k ON k.model_id = runs.model_id AND k.vintage = runs.vintage")
def promote_run(s, d):
    return R.promote(X.runs(s, d), ["model_id", "vintage"], "r5")


@query(f"WITH {X.RUNS} SELECT model_id, vintage, sum(promoted) AS promoted FROM runs GROUP BY 1, 2 HAVING sum(promoted) > 1")
def promotion_conflicts(s, d):
    return R.promotion_conflicts(X.runs(s, d), ["model_id", "vintage"])


@query(f"WITH {X.RUNS} SELECT f.model_id, f.vintage, f.run_id, f.name, runs.created FROM (SELECT p_brand AS model_id, p_type AS vintage, 'r' || p_partkey AS run_id, p_name AS name FROM part) f JOIN runs ON runs.run_id = f.run_id AND runs.model_id = f.model_id AND runs.vintage = f.vintage WHERE promoted = 1")
def promoted_join(s, d):
    part = X.table(s, d, "part")
    return R.promoted_forecasts(X.runs(s, d), part.select(F.col("p_brand").alias("model_id"), F.col("p_type").alias("vintage"), F.concat(F.lit("r"), "p_partkey").alias("run_id"), F.col("p_name").alias("name")))


@query(f"WITH {X.RUNS} SELECT model_id, vintage, run_id, created, promoted FROM runs QUALIFY row_number() OVER (PARTITION BY model_id, vintage ORDER BY promoted DESC, created DESC, run_id) = 1")
def resolve_run(s, d):
    return R.resolve_run(X.runs(s, d), ["model_id", "vintage"])


@query(f"WITH {X.RUNS} SELECT model_id, vintage, run_id, created, promoted, CAST(row_number() OVER (PARTITION BY vintage ORDER BY model_id, created DESC, run_id) AS INTEGER) AS place FROM runs WHERE promoted = 1")
def promoted_order(s, d):
    return R.ordered_runs(X.runs(s, d))


@query(f"WITH {X.RUNS} SELECT run_id, file FROM runs, (SELECT unnest(['metadata.json', 'draws.parquet']) AS file) WHERE NOT (file = 'metadata.json' OR CAST(substr(run_id, 2) AS BIGINT) % 3 = 0)")
def missing_files(s, d):
    runs = X.runs(s, d)
    held = runs.select("run_id", F.lit("metadata.json").alias("file")).unionByName(runs.filter(F.substring("run_id", 2, 20).cast("long") % 3 == 0).select("run_id", F.lit("draws.parquet").alias("file")))
    return R.missing_files(runs, held, ["metadata.json", "draws.parquet"])


# Scalars and tables


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(s, d):
    from anchorline.sources.readers import flatten_json

    return flatten_json(X.table(s, d, "events"), "props", ["event_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def date_parse(s, d):
    orders = X.table(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.datediff("day", F.expr("date'1899-12-30'")).cast("string")).when(F.col("o_orderkey") % 3 == 1, F.col("day").cast("string")).otherwise("#N/A")
    return orders.select("o_orderkey", S.parse_date(raw).alias("date"))


@query("SELECT o_orderkey, len(regexp_extract_all(lower(o_orderpriority), '[a-z]+')) AS n, list_contains(regexp_extract_all(lower(o_orderpriority), '[a-z]+'), 'urgent') AS urgent, lower(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'))) AS text FROM orders")
def flag_tokens(s, d):
    tokens = S.flag_tokens(F.col("o_orderpriority"))
    return X.table(s, d, "orders").select("o_orderkey", F.size(tokens).cast("long").alias("n"), F.array_contains(tokens, "urgent").alias("urgent"), S.clean_text(F.col("o_orderpriority")).alias("text"))


@query(f"WITH {X.INDEX}, l AS (SELECT series, date, value, (value - avg(value) OVER (PARTITION BY series)) / stddev_samp(value) OVER (PARTITION BY series) AS z FROM idx), m AS (SELECT series, max(date) AS date, max_by(value, date) AS value, max_by(z, date) AS z FROM l GROUP BY 1) SELECT series, date, {r('value')} AS value, {r('z')} AS z, CASE WHEN z >= 1 THEN 'very high' WHEN z >= 0.5 THEN 'high' WHEN z >= -0.5 THEN 'normal' WHEN z >= -1 THEN 'low' ELSE 'very low' END AS regime FROM m")
def economic_conditions(s, d):
    z = X.index(s, d).withColumn("z", Z.z_score("value", ["series"]))
    return z.groupBy("series").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"), F.max_by("z", "date").alias("z")).withColumn("regime", S.regime(F.col("z")))


@query(f"WITH {X.WEIGHTS}, l AS (SELECT series, max_by(value, date) AS latest, max(date) AS date FROM idx GROUP BY 1), y AS (SELECT a.series, 100 * (a.value / b.value - 1) AS yoy FROM idx a JOIN l ON l.series = a.series AND l.date = a.date JOIN idx b ON b.series = a.series AND a.date = b.date + INTERVAL 12 MONTH), sh AS (SELECT series, max_by(pct, year) AS weight FROM (SELECT series, year, 100 * w / sum(w) OVER (PARTITION BY year) AS pct FROM wts) GROUP BY 1) SELECT l.series, l.date, {r('latest')} AS latest, {r('yoy')} AS yoy, {r('weight')} AS weight FROM l LEFT JOIN y ON y.series = l.series JOIN sh ON sh.series = l.series")
def outlook_overview(s, d):
    level = X.index(s, d)
    last = level.groupBy("series").agg(F.max_by("value", "date").alias("latest"), F.max("date").alias("date"))
    yoy = T.growth_over(level, ["series"]).select("series", "date", F.col("growth").alias("yoy"))
    share = C.weight_shares(X.weights(s, d)).groupBy("series").agg(F.max_by("pct", "year").alias("weight"))
    return last.join(yoy, ["series", "date"], "left").join(share, "series")


@query(f"WITH {X.CUBE}, f AS (SELECT series, date, avg(value) AS mean, quantile_cont(value, 0.5) AS q50 FROM cube GROUP BY 1, 2) SELECT series, date, 'history' AS record_type, {r('value', 2)} AS value, NULL::DOUBLE AS q50 FROM idx WHERE date <= DATE '2000-12-01' UNION ALL SELECT series, date, 'fan', {r('mean', 2)}, {r('q50', 2)} FROM f WHERE date > DATE '2000-12-01'", digits=2)
def export_rows(s, d):
    history = X.index(s, d).filter("date <= '2000-12-01'").select("series", "date", F.lit("history").alias("record_type"), "value")
    fan = A.fan(X.cube(s, d), ["series", "date"]).filter("date > '2000-12-01'").select("series", "date", F.lit("fan").alias("record_type"), F.col("mean").alias("value"), "q50")
    return history.unionByName(fan, allowMissingColumns=True)


@query(f"WITH {X.INDEX} SELECT date, " + ", ".join(r(f"max(CASE WHEN series = '{n}' THEN value END)") + f' AS "{n}"' for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM idx GROUP BY 1")
def pivot_panel(s, d):
    from anchorline.sources.readers import pivot_panel as pivot

    return pivot(X.index(s, d), ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))


@query(f"WITH {X.INDEX} SELECT series, date, {r('value')} AS value FROM idx")
def unpivot_block(s, d):
    from anchorline.sources.readers import pivot_panel as pivot
    from anchorline.sources.readers import unpivot_panel

    return unpivot_panel(pivot(X.index(s, d), ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))).filter("value is not null")


@query(f"WITH {X.INDEX}, {HOLES}, l AS (SELECT series, date, value, lag(date) OVER ({_LAG}) AS p FROM holes) SELECT series, count(*) FILTER (date = p) AS repeated, count(*) FILTER (date <> p AND date <> CAST(p + INTERVAL 1 MONTH AS DATE)) AS irregular, 0::BIGINT AS not_finite, count(*) FILTER (value <= 0) AS not_positive, count(value) = 0 AS all_null FROM l GROUP BY 1")
def panel_violations(s, d):
    from anchorline.operators.validate import panel_violations as violations

    return violations(holes(s, d), ["series"])


# Models


def model_panel(s, d):
    """Monthly log changes in per cent of all regions."""
    return dlog(s, d).select(F.lit("m").alias("model_id"), "series", "date", (100 * F.col("value")).alias("value"))


MP = "mp AS (SELECT series, date, 100 * value AS value FROM dl), ds AS (" + " UNION ALL ".join(f"SELECT date, series AS variable, {k} AS lag, x FROM (SELECT date, series, lag(value, {k}) OVER (PARTITION BY series ORDER BY date) AS x, lag(value, 2) OVER (PARTITION BY series ORDER BY date) AS whole FROM mp) WHERE whole IS NOT NULL" for k in (1, 2)) + "), dx AS (SELECT * FROM ds UNION ALL SELECT DISTINCT date, 'const', 0, 1.0 FROM ds)"


@query(f"WITH {X.INDEX}, {DLOG}, {MP} SELECT 'm' AS model_id, date, variable, CAST(lag AS INTEGER) AS lag, {r('x')} AS x FROM dx")
def var_design(s, d):
    return M.design(model_panel(s, d), ["model_id"], 2)


@query(f"WITH {X.INDEX}, {DLOG}, {MP}, co AS (SELECT e.series AS equation, v.variable, v.lag, (length(e.series) * 3 + length(v.variable) * 5 + v.lag * 7) % 11 / 100.0 - 0.05 AS b FROM (SELECT DISTINCT series FROM mp) e, (SELECT DISTINCT variable, lag FROM dx) v) SELECT 'm' AS model_id, date, equation, {r('sum(x * b)')} AS value FROM dx JOIN co ON co.variable = dx.variable AND co.lag = dx.lag GROUP BY ALL")
def one_step_fitted(s, d):
    panel = model_panel(s, d)
    names = panel.select("model_id", "variable" if "variable" in panel.columns else F.col("series").alias("variable")).distinct()
    terms = names.withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2)))).unionByName(names.select("model_id").distinct().select("model_id", F.lit("const").alias("variable"), F.lit(0).alias("lag")))
    b = (F.length("equation") * 3 + F.length("variable") * 5 + F.col("lag") * 7) % 11 / 100.0 - 0.05
    coefficients = names.withColumnRenamed("variable", "equation").join(terms, "model_id").withColumn("b", b)
    return M.fitted(panel, coefficients, ["model_id"], 2)


@query()
def var_fit(s, d):
    return M.fit(model_panel(s, d), ["model_id"], 2)


@query()
def companion_roots(s, d):
    return M.companion_roots(M.fit(model_panel(s, d), ["model_id"], 2), ["model_id"])


@query()
def irf_paths(s, d):
    panel = model_panel(s, d)
    impacts = panel.select("model_id", F.col("series").alias("response"), F.col("series").alias("shock")).distinct().withColumn("value", F.lit(1.0))
    return M.cumulative(M.impulse_responses(M.fit(panel, ["model_id"], 2), impacts, ["model_id"], 12), ["model_id"])


IRF = "irf AS (SELECT CAST(draw AS INTEGER) AS draw, a.r_name AS response, b.r_name AS shock, CAST(h AS INTEGER) AS h, ((draw * 31 + a.r_regionkey * 17 + b.r_regionkey * 13 + h * 7) % 101 - 50) / 100.0 AS value FROM region a, region b, (SELECT unnest(range(0, 20)) AS draw), (SELECT unnest(range(0, 13)) AS h))"


def responses(s, d):
    """Responses made by arithmetic of draw, regions and horizon; both tables have a row for each region."""
    region = X.table(s, d, "region")
    left, right = region.select(F.col("r_name").alias("response"), F.col("r_regionkey").alias("i")), region.select(F.col("r_name").alias("shock"), F.col("r_regionkey").alias("j"))
    grid = left.join(F.broadcast(right), F.lit(True)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(12))))
    return grid.select("draw", "response", "shock", "h", (((F.col("draw") * 31 + F.col("i") * 17 + F.col("j") * 13 + F.col("h") * 7) % 101 - 50) / 100.0).alias("value"))


@query(f"WITH {IRF} SELECT draw, response, shock, h, {r('value')} AS value, {r('sum(value) OVER (PARTITION BY draw, response, shock ORDER BY h)')} AS cumulative FROM irf")
def irf_cumulative(s, d):
    return M.cumulative(responses(s, d), ["draw"])


@query(f"WITH {IRF}, o AS (SELECT *, sum(value * value) OVER (PARTITION BY draw, response, shock ORDER BY h) AS own FROM irf) SELECT draw, response, shock, h, {r('own / sum(own) OVER (PARTITION BY draw, response, h)')} AS share FROM o")
def fevd_shares(s, d):
    return M.variance_shares(responses(s, d), ["draw"])


@query(f"WITH {X.WEIGHTS}, {IRF}, b AS (SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS h FROM idx), c AS (SELECT draw, response AS series, h, sum(value) OVER (PARTITION BY draw, response ORDER BY h) / 100 AS cumulative FROM irf WHERE shock = 'ASIA'), w AS (SELECT series, avg(w) AS w FROM wts GROUP BY 1) SELECT draw, date, {r('100 * (sum(w * value * exp(cumulative)) / sum(w * value) - 1)')} AS effect FROM b JOIN c ON c.series = b.series AND c.h = b.h JOIN w ON w.series = b.series GROUP BY 1, 2")
def nonlinear_response(s, d):
    from pyspark.sql import Window

    base = X.index(s, d).withColumn("h", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    irf = M.cumulative(responses(s, d), ["draw"]).filter("shock = 'ASIA'").select("draw", F.col("response").alias("series"), "h", (F.col("cumulative") / 100).alias("cumulative"))
    return M.nonlinear_response(base, irf, ["draw"], X.weights(s, d).groupBy("series").agg(F.avg("w").alias("w")))


@query(f"WITH {X.INDEX}, {DLOG}, {IRF}, e AS (SELECT series AS shock, date, value, (year(date) - 1995) * 12 + month(date) AS t FROM dl), p AS (SELECT draw, response, e.shock, e.t + h AS t, e.value * irf.value AS c FROM e JOIN irf ON irf.shock = e.shock ), s AS (SELECT draw, response, shock, t, sum(c) AS contribution FROM p GROUP BY ALL) SELECT s.draw, response, s.shock, s.t, d.date, {r('contribution')} AS contribution, 0.0 AS amplified FROM s JOIN (SELECT DISTINCT t, date FROM e) d ON d.t = s.t")
def historical_decomposition(s, d):
    e = dlog(s, d).select(F.col("series").alias("shock"), "date", "value", ((F.year("date") - 1995) * 12 + F.month("date")).cast("long").alias("t"))
    shocks = e.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return M.historical_decomposition(shocks, responses(s, d), ["draw"])


@query()
def gibbs_summary(s, d):
    from anchorline.plans.posteriors import two_chains

    return Z.parameter_summary(two_chains(s, d).withColumnRenamed("b", "value"), ["model_id", "kind", "equation", "variable", "lag"])


@query()
def effective_sizes(s, d):
    from anchorline.plans.posteriors import chains

    one = chains(s, d).filter("kind = 'phi'").withColumnRenamed("b", "value")
    return M.effective_size(one, ["model_id", "chain", "equation"])


@query()
def predictive_fan(s, d):
    from anchorline.plans.posteriors import chains, ends

    draws = chains(s, d)
    tail = draws.select("model_id", "chain").distinct().join(ends(s, d).filter("draw = 0").drop("draw"), "model_id")
    paths = M.simulate(draws, tail, ["model_id", "chain"], 6, 7)
    return A.fan(paths, ["model_id", "series", "h"])
