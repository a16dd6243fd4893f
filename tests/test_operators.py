"""Operators on small tables whose results are known."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions import scalar as S
from anchorline.operators import calendar as T
from anchorline.operators import fans as A
from anchorline.operators import index as C
from anchorline.operators import models as M
from anchorline.operators import tax as P
from anchorline.operators import validate as V


def month(y, m):
    return dt.date(y, m, 1)


def months(n, start=(2020, 1)):
    k = start[0] * 12 + start[1] - 1
    return [month((k + i) // 12, (k + i) % 12 + 1) for i in range(n)]


def test_chain_link_by_hand(spark):
    rng = np.random.default_rng(0)
    dates, x = months(36), 100 * np.exp(rng.normal(0, 0.02, (36, 2)).cumsum(0))
    w = {2021: (600, 400), 2022: (300, 700)}
    levels = spark.createDataFrame([(s, d, float(x[i, j])) for j, s in enumerate("ab") for i, d in enumerate(dates)], "series string, date date, value double")
    weights = spark.createDataFrame([(y, s, float(v)) for y, vs in w.items() for s, v in zip("ab", vs, strict=True)], "year int, series string, w double")
    level, expected = 100.0, {}
    for y in (2021, 2022):
        base = x[dates.index(month(y - 1, 12))]
        g = [(np.array(w[y]) / 1000) @ (x[dates.index(month(y, m))] / base) for m in range(1, 13)]
        expected |= {month(y, m + 1): level * v for m, v in enumerate(g)}
        level *= g[-1]
    got = {r["date"]: r["value"] for r in C.chain_link(levels, weights).collect()}
    assert got == pytest.approx(expected)
    parts = C.yoy_contributions(C.chain_terms(levels, weights)).groupBy("date").agg(F.sum("contribution").alias("c"), F.first("yoy").alias("yoy")).collect()
    assert parts and all(abs(r["c"] - r["yoy"]) < 1e-10 for r in parts)


def test_missing_component_ends_the_path(spark):
    dates = months(24)
    rows = [(s, d, 100.0) for s in "ab" for d in dates if not (s == "b" and d >= month(2021, 6))]
    levels = spark.createDataFrame(rows, "series string, date date, value double")
    weights = spark.createDataFrame([(2021, "a", 1.0), (2021, "b", 1.0)], "year int, series string, w double")
    assert C.chain_link(levels, weights).agg(F.max("date")).first()[0] == month(2021, 5)


def test_draw_with_a_bad_value_goes_whole(spark):
    rows = [(0, 1.0), (0, 2.0), (1, 1.0), (1, -1.0), (2, float("nan")), (3, None), (4, float("inf"))]
    paths = spark.createDataFrame(rows, "draw int, value double")
    assert [r["draw"] for r in A.admissible(paths).collect()] == [0]


def test_fan_is_linear_and_leaves_out_nan(spark):
    rows = [("a", float(i)) for i in range(11)] + [("a", float("nan")), ("a", None)]
    r = A.fan(spark.createDataFrame(rows, "series string, value double"), ["series"]).first()
    assert (r["mean"], r["q05"], r["q50"], r["q95"], r["n_draws"]) == pytest.approx((5, 0.5, 5, 9.5, 11))


def test_even_subset(spark):
    draws = spark.range(10).select(F.col("id").alias("draw"))
    assert sorted(r["draw"] for r in A.even_subset(draws, 4).collect()) == [0, 3, 6, 9]
    assert [r["draw"] for r in A.even_subset(draws, 1).collect()] == [0]
    assert A.even_subset(draws, 20).count() == 10


def test_months_with_four_and_five_mondays(spark):
    start = dt.date(2024, 1, 1)
    weeks = [("a", start + dt.timedelta(7 * i), float(i)) for i in range(12)]
    got = {r["date"]: (r["n"], r["expected"]) for r in T.complete_month_mean(spark.createDataFrame(weeks, "series string, date date, value double"), ["series"]).collect()}
    assert got == {month(2024, 1): (5, 5), month(2024, 2): (4, 4)}


def test_semester_edge_is_carried_and_told(spark):
    half = spark.createDataFrame([("v", month(2020, 1), 1.0), ("v", month(2020, 7), 2.0)], "series string, date date, value double")
    got = {r["date"]: (r["value"], r["carried"], r["status"]) for r in T.semester_expand(half, ["series"], "2021-12-01").collect()}
    assert got[month(2020, 6)] == (1.0, 0, "ok")
    assert got[month(2021, 6)] == (2.0, 6, "ok")
    assert got[month(2021, 7)] == (2.0, 7, "warn")
    assert T.semester_expand(half, ["series"], "2022-02-01").filter("status = 'error'").count() == 2


def test_partial_period(spark):
    mean, var = T.partial_estimate(F.lit(5), F.lit(3), F.lit(10.0), F.lit(20.0), F.lit(2.0))
    r = spark.range(1).select(mean.alias("m"), var.alias("v")).first()
    assert (r["m"], r["v"]) == pytest.approx((14.0, 2.0 / 25 * 5))


def test_interior_gap_is_filled_and_edges_are_not(spark):
    rows = [("a", d, v) for d, v in zip(months(5), (None, 1.0, None, 3.0, None), strict=True)]
    got = {r["date"]: r["value"] for r in T.interpolate_interior(spark.createDataFrame(rows, "series string, date date, value double"), ["series"]).collect()}
    assert got[month(2020, 1)] is None and got[month(2020, 5)] is None
    assert got[month(2020, 3)] == pytest.approx(1 + 2 * 29 / 60)


def test_unsplit_unless_both_months_can_be_told(spark):
    terms = spark.createDataFrame([("a", month(2020, 1), 50.0, 100.0), ("a", month(2021, 1), 60.0, 110.0)], "series string, date date, term double, total double")
    shares = spark.createDataFrame([("a", month(2021, 1), 0.5, 0.25, 0.25, 0.0)], "series string, date date, pre_tax double, excise double, vat double, unsplit double")
    got = {r["layer"]: r["contribution"] for r in P.layer_contributions(terms, shares).collect()}
    assert got == pytest.approx({"pre_tax": 0, "excise": 0, "vat": 0, "unsplit": 10.0})


def test_dates_and_numbers(spark):
    rows = [("45292", "1.5"), ("2024-01-01", "inf"), ("#N/A", "NaN"), ("rubbish", "x"), (None, None)]
    got = spark.createDataFrame(rows, "d string, x string").select(S.parse_date(F.col("d")).alias("d"), S.clean_number(F.col("x")).alias("x")).collect()
    assert [r["d"] for r in got] == [dt.date(2024, 1, 1), dt.date(2024, 1, 1), None, None, None]
    assert [r["x"] for r in got] == [1.5, None, None, None, None]


def test_violations(spark):
    rows = [("a", month(2020, 1), 1.0), ("a", month(2020, 1), 2.0), ("a", month(2020, 3), -1.0), ("a", month(2020, 4), float("inf"))]
    r = V.panel_violations(spark.createDataFrame(rows, "series string, date date, value double"), ["series"]).first()
    assert (r["repeated"], r["irregular"], r["not_finite"], r["not_positive"], r["all_null"]) == (1, 1, 1, 1, False)


def var_panel(spark, t=400):
    rng = np.random.default_rng(1)
    b = np.array([[0.5, 0.1], [0.0, 0.3]])
    z = np.zeros((t, 2))
    for i in range(1, t):
        z[i] = 0.2 + b @ z[i - 1] + rng.normal(0, 0.5, 2)
    rows = [("m", s, month(1950 + i // 12, i % 12 + 1), float(z[i, j])) for i in range(t) for j, s in enumerate("ab")]
    return z, b, spark.createDataFrame(rows, "model_id string, series string, date date, value double")


def test_fit_is_least_squares(spark):
    z, _, panel = var_panel(spark, 120)
    expected = np.linalg.lstsq(np.column_stack([z[:-1], np.ones(119)]), z[1:], rcond=None)[0]
    got = {(r["equation"], r["variable"]): r["b"] for r in M.fit(panel, ["model_id"], 1).collect()}
    assert got == pytest.approx({(e, v): expected[i, j] for j, e in enumerate("ab") for i, v in enumerate(("a", "b", "const"))})


def test_sampler_finds_the_coefficients_and_repeats(spark):
    _, b, panel = var_panel(spark)
    draws = M.gibbs(panel, ["model_id"], 1, 150, 50, 3).filter("kind = 'b' and lag = 1")
    mean = {(r["equation"], r["variable"]): r["m"] for r in draws.groupBy("equation", "variable").agg(F.avg("b").alias("m")).collect()}
    assert mean == pytest.approx({(e, v): b[i, j] for i, e in enumerate("ab") for j, v in enumerate("ab")}, abs=0.15)
    assert draws.agg(F.sum("b")).first()[0] == M.gibbs(panel, ["model_id"], 1, 150, 50, 3).filter("kind = 'b' and lag = 1").agg(F.sum("b")).first()[0]


def test_paths_do_not_depend_on_partitions(spark):
    _, _, panel = var_panel(spark, 120)
    posterior = M.gibbs(panel, ["model_id"], 1, 10, 5, 3)
    last = panel.groupBy("model_id", "series").agg(F.max_by("value", "date").alias("value")).withColumn("back", F.lit(0))
    one, two = (M.simulate(posterior.repartition(n), last, ["model_id"], 4, 9) for n in (1, 3))
    assert one.count() == 10 * 4 * 2 and one.exceptAll(two).isEmpty()


def test_each_chain_has_shocks_of_its_own(spark):
    _, _, panel = var_panel(spark, 120)
    posterior = M.gibbs(panel, ["model_id"], 1, 5, 5, 3)
    chains = posterior.withColumn("chain", F.explode(F.array(F.lit(0), F.lit(1))))
    last = panel.groupBy("model_id", "series").agg(F.max_by("value", "date").alias("value")).withColumn("back", F.lit(0)).withColumn("chain", F.explode(F.array(F.lit(0), F.lit(1))))
    paths = M.simulate(chains, last, ["model_id", "chain"], 3, 9)
    assert paths.count() == 2 * 5 * 3 * 2 == paths.select("value").distinct().count()


def test_no_unstable_draw_is_kept(spark):
    rows = [("m", dt.date(2000 + t // 12, t % 12 + 1, 1), "a", 1.2**t) for t in range(60)]
    panel = spark.createDataFrame(rows, "model_id string, date date, series string, value double")
    with pytest.raises(Exception, match="no stable draw"):
        M.gibbs(panel, ["model_id"], 1, 3, 0, 3, own=10.0).collect()


def test_impulse_responses(spark):
    rows = [("m", "a", "a", 1, 0.5), ("m", "a", "b", 1, 0.1), ("m", "b", "a", 1, 0.0), ("m", "b", "b", 1, 0.3)]
    coefficients = spark.createDataFrame(rows, "model_id string, equation string, variable string, lag int, b double")
    impacts = spark.createDataFrame([("m", "a", "a", 1.0), ("m", "b", "b", 2.0)], "model_id string, response string, shock string, value double")
    b, first = np.array([[0.5, 0.1], [0.0, 0.3]]), np.diag([1.0, 2.0])
    got = {(r["response"], r["shock"], r["h"]): r["value"] for r in M.impulse_responses(coefficients, impacts, ["model_id"], 3).collect()}
    assert got == pytest.approx({("ab"[i], "ab"[j], h): (np.linalg.matrix_power(b, h) @ first)[i, j] for i in range(2) for j in range(2) for h in range(4)})


def test_effective_size_of_white_noise(spark):
    x = np.random.default_rng(0).normal(size=2000)
    r = M.effective_size(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, draw int, value double"), ["k"]).first()
    assert 1000 < r["ess"] <= 2000
