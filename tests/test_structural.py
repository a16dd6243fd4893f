"""Structural analysis of a posterior: against matrix algebra of single draws, and against SQL over stored responses."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.operators import models as M
from anchorline.operators import scenarios as N
from anchorline.operators import structural as S

PANEL, KEYS = "model_id string, date date, series string, value double", ["model_id"]


@pytest.fixture(scope="module")
def made(spark):
    """Two models of two series with two lags and some missing values, and their posterior."""
    rows = []
    for k, model in enumerate(("m", "other")):
        rng = np.random.default_rng(k)
        z = np.zeros((80, 2))
        for t in range(2, 80):
            z[t] = 0.2 + np.array([[0.4, 0.1], [-0.2, 0.3]]) @ z[t - 1] + 0.2 * z[t - 2] + rng.standard_normal(2) @ np.array([[1, 0.5], [0, 1]]) * (6 if t == 40 else 1)
        z[30, 0] = z[31, 1] = z[79, 1] = np.nan
        dates = pd.date_range("2000-01-01", periods=80, freq="MS").date
        rows += [(model, dates[t], s, None if np.isnan(z[t, j]) else float(z[t, j])) for t in range(80) for j, s in enumerate("xy")]
    panel = spark.createDataFrame(rows, PANEL)
    return panel, M.gibbs(panel, KEYS, 2, 12, 10, 4, scales=True).cache()


def matrices_of(draws, model, draw):
    """Plain reading of a draw: lag matrices, constants, impact rows, deviations and outliers' widths by date."""
    rows = draws.filter(f"model_id = '{model}' and draw = {draw}").collect()
    at = {"x": 0, "y": 1}
    b, c, a = np.zeros((2, 2, 2)), np.zeros(2), np.eye(2)
    sd, width = {}, {}
    for r in rows:
        if r["kind"] == "b" and r["lag"]:
            b[r["lag"] - 1, at[r["equation"]], at[r["variable"]]] = r["b"]
        elif r["kind"] == "b":
            c[at[r["equation"]]] = r["b"]
        elif r["kind"] == "a":
            a[at[r["equation"]], at[r["variable"]]] = r["b"]
        elif r["kind"] in ("scale", "width"):
            (sd if r["kind"] == "scale" else width).setdefault(r["variable"], np.zeros(2))[at[r["equation"]]] = r["b"]
    dates = sorted(sd)
    return b, c, a, dates, np.array([sd[d] for d in dates]), np.array([width[d] for d in dates])


def data_of(panel, draws, model, draw):
    got = S.panels_of(draws, panel, KEYS).filter(f"model_id = '{model}' and draw = {draw}").toPandas()
    return got.pivot(index="date", columns="series", values="value").sort_index().to_numpy()


def test_impacts_at_a_date(made):
    _, draws = made
    b, c, a, dates, sd, width = matrices_of(draws, "other", 3)
    for at, outliers in ((None, False), (dates[38], False), (dates[38], True)):
        row = -1 if at is None else 38
        got = {(r["response"], r["shock"]): r["value"] for r in S.impacts_at(draws, KEYS, at, outliers).filter("model_id = 'other' and draw = 3").collect()}
        expected = np.linalg.inv(a) @ np.diag(sd[row] / (1 if outliers else width[row]))
        assert [got[r, s] for r in "xy" for s in "xy"] == pytest.approx(expected.ravel().tolist())
    with pytest.raises(Exception, match="no date of the sample"):
        S.impacts_at(draws, KEYS, "1990-01-01").count()


def test_decomposition_by_moving_averages(made):
    panel, draws = made
    b, c, a, dates, sd, width = matrices_of(draws, "m", 5)
    z = data_of(panel, draws, "m", 5)
    got = S.decomposition(draws, panel, KEYS).filter("model_id = 'm' and draw = 5").toPandas()
    outcomes, inverse = len(dates), np.linalg.inv(a)
    psi = [np.eye(2)]
    for h in range(1, outcomes):
        psi.append(b[0] @ psi[h - 1] + (b[1] @ psi[h - 2] if h > 1 else 0))
    v = np.array([a @ (z[t + 2] - c - b[0] @ z[t + 1] - b[1] @ z[t]) for t in range(outcomes)])
    base = [z[0], z[1]]
    for _ in range(outcomes):
        base.append(c + b[0] @ base[-1] + b[1] @ base[-2])
    cell = {(str(r.date), r.response, r.shock): (r.regular, r.outlier) for r in got.itertuples()}
    assert len(cell) == outcomes * 2 * 3
    for t in (0, 1, 17, 40, outcomes - 1):
        for i, response in enumerate("xy"):
            assert cell[dates[t], response, "base"] == pytest.approx((base[t + 2][i], 0.0), abs=1e-9)
            for j, shock in enumerate("xy"):
                whole = sum((psi[t - s] @ inverse[:, j])[i] * v[s, j] for s in range(t + 1))
                usual = sum((psi[t - s] @ inverse[:, j])[i] * v[s, j] / width[s, j] for s in range(t + 1))
                assert cell[dates[t], response, shock] == pytest.approx((usual, whole - usual), abs=1e-9)


def test_parts_sum_to_the_data_under_any_rotation(made):
    panel, draws = made
    impacts = S.sign_impacts_at(draws, KEYS, {("supply", "x", 0): -1, ("supply", "y", 1): 1, ("demand", "x", 0): 1}, 200, 3, cumulative={("demand", "y", 2): 1}).cache()
    assert impacts.select("model_id", "draw").distinct().count() > 12
    for r in impacts.collect():
        assert r["value"] * {"supply": -1, "demand": 1}[r["shock"]] > 0 or r["response"] != "x"
    parts = S.decomposition(draws, panel, KEYS, impacts)
    assert {r["shock"] for r in parts.select("shock").distinct().collect()} == {"base", "supply", "demand"}
    gaps = S.reconstruction_gaps(parts, draws, panel, KEYS).collect()
    assert len(gaps) == 2 and all(r["exact"] and r["gap"] <= S.RECONSTRUCTION for r in gaps)
    # A rotation deals the same covariance.
    recursive = S.impacts_at(draws, KEYS).toPandas()
    for (m, d), mine in impacts.toPandas().groupby(["model_id", "draw"]):
        square = lambda t: (lambda w: w @ w.T)(t.pivot(index="response", columns="shock", values="value").to_numpy())
        assert square(mine) == pytest.approx(square(recursive[(recursive["model_id"] == m) & (recursive["draw"] == d)]), rel=1e-8)


def test_shares_and_sums_by_sql_over_stored_responses(made, tmp_path):
    _, draws = made
    irf = S.responses(draws, S.impacts_at(draws, KEYS), KEYS, 8)
    irf.write.parquet(f"{tmp_path}/irf")
    S.variance_shares(irf, KEYS).write.parquet(f"{tmp_path}/fevd")
    duck = duckdb.connect()
    told = duck.sql(f"""WITH i AS (SELECT * FROM '{tmp_path}/irf/*.parquet'), f AS (SELECT * FROM '{tmp_path}/fevd/*.parquet'),
      c AS (SELECT *, sum(value) OVER w AS run, sum(value * value) OVER w AS own FROM i WINDOW w AS (PARTITION BY model_id, draw, response, shock ORDER BY h)),
      s AS (SELECT *, own / sum(own) OVER (PARTITION BY model_id, draw, response, h) AS share FROM c)
      SELECT count(*), max(abs(s.run - s.cumulative)), max(abs(s.share - f.share)), (SELECT max(abs(t - 1)) FROM (SELECT sum(share) AS t FROM f GROUP BY model_id, draw, response, horizon))
      FROM s JOIN f ON f.model_id = s.model_id AND f.draw = s.draw AND f.response = s.response AND f.shock = s.shock AND f.horizon = s.h + 1""").fetchall()[0]
    assert told[0] == 2 * 12 * 4 * 9 and max(told[1:]) < 1e-12
    b, *_ = matrices_of(draws, "m", 1)
    impact = np.array([[r["value"] for r in irf.filter(f"model_id = 'm' and draw = 1 and h = 0 and response = '{x}'").orderBy("shock").collect()] for x in "xy"])
    two = {(r["response"], r["shock"]): r["value"] for r in irf.filter("model_id = 'm' and draw = 1 and h = 2").collect()}
    assert [two[r, s] for r in "xy" for s in "xy"] == pytest.approx(((b[0] @ b[0] + b[1]) @ impact).ravel().tolist())


def test_units(made):
    _, draws = made
    impacts = S.impacts_at(draws, KEYS)
    own = S.responses(draws, impacts, KEYS, 2, "own").filter("h = 0").toPandas()
    assert own[own["response"] == own["shock"]]["value"].to_numpy() == pytest.approx(1.0)
    with pytest.raises(Exception, match="hardly moves"):
        S.responses(draws, impacts, KEYS, 2, "x").count()  # y's shock has no effect on x at once


def test_total_response_of_a_quiet_path(spark, made):
    panel, draws = made
    b, c, *_ = matrices_of(draws, "m", 2)
    z = data_of(panel, draws, "m", 2)
    irf = S.responses(draws, S.impacts_at(draws, KEYS), KEYS, 3).cache()
    start = spark.createDataFrame([(m, s, v) for m in ("m", "other") for s, v in (("x", 50.0), ("y", 80.0))], "model_id string, series string, value double")
    weights = start.select("model_id", "series", (F.col("value") / 10).alias("w"))
    got = {(r["shock"], r["h"]): r["effect"] for r in S.total_response(S.quiet_paths(draws, panel, KEYS, 3), irf, start, weights, KEYS).filter("model_id = 'm' and draw = 2").collect()}
    past, total = [z[-1], z[-2]], np.zeros(2)
    told = {(r["response"], r["shock"], r["h"]): r["cumulative"] for r in irf.filter("model_id = 'm' and draw = 2").collect()}
    for h in range(4):
        past = [c + b[0] @ past[0] + b[1] @ past[1], past[0]]
        total = total + past[0]
        level = np.array([5.0, 8.0]) * np.array([50.0, 80.0]) * np.exp(total / 100)
        for s in "xy":
            moved = level * np.exp(np.array([told["x", s, h], told["y", s, h]]) / 100)
            assert got[s, h] == pytest.approx(100 * (moved.sum() / level.sum() - 1))


def test_volatility_and_gates(made):
    _, draws = made
    *_, dates, sd, width = matrices_of(draws, "m", 0)
    for outliers, expected in ((True, sd), (False, sd / width)):
        got = S.volatility(draws, KEYS, outliers).filter("model_id = 'm' and draw = 0").toPandas().pivot(index="date", columns="series", values="value").to_numpy()
        assert got == pytest.approx(expected)
    told = S.gates(draws, KEYS, M.LEVEL_GATE).collect()
    assert len(told) == 2 * 12 * 2 and all(r["passed"] and r["error"] < 1e-9 for r in told)


def test_transfer_pairs_shocks_and_meets_both_legs(spark, made):
    panel, draws = made
    pairs = spark.createDataFrame([(k, k % 12) for k in range(20)], "pair_id long, draw int")
    paired = N.paired_posterior(draws, pairs)
    assert paired.filter("kind = 'phi'").count() == 20 * 2 * 2
    dates = pd.date_range("2006-08-01", periods=4, freq="MS").date
    source = spark.createDataFrame([(k, d, 100.0 + k + t) for k in range(12) for t, d in enumerate(dates)], "draw int, date date, value double")
    moved = source.withColumn("value", F.when(F.col("date") > dates[0], F.col("value") * 1.1).otherwise(F.col("value")))
    base, scenario = (N.growth_conditions(p, pairs, str(dates[0]), 3, "x") for p in (source, moved))
    tail = M.tail_of(S.panels_of(paired, panel, KEYS), [*KEYS, "draw"], 2)
    legs = N.transfer(paired, tail, KEYS, base, scenario, 3, 9).cache()
    assert all(r["paired"] and r["pairs"] == 20 and r["gap"] == 0 for r in N.pairing_gap(legs, KEYS).collect())
    for r in legs.filter("series = 'x'").collect():
        k, h = r["draw"] % 12, r["h"]
        assert r["baseline"] == pytest.approx(100 * np.log((100 + k + h) / (100 + k + h - 1)), abs=1e-8)
        assert r["scenario"] - r["baseline"] == pytest.approx(100 * np.log(1.1) if h == 1 else 0, abs=1e-8)
    assert legs.filter("series = 'y' and abs(scenario - baseline) > 1e-6").count() > 0
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "series string, w double")
    path = legs.filter("series not like 'spread%'")
    core = {(r["model_id"], r["draw"], r["h"]): r["effect"] for r in N.total_effect(path, weights, KEYS, ["x"]).collect()}
    only_y = path.filter("series = 'y' and h <= 2").groupBy("model_id", "draw").agg(F.sum("scenario").alias("s"), F.sum("baseline").alias("b")).collect()
    for r in only_y:
        assert core[r["model_id"], r["draw"], 2] == pytest.approx(100 * (np.exp((r["s"] - r["b"]) / 100) - 1))


def test_observed_paths_trim_and_refuse_gaps(spark):
    day = lambda k: pd.Timestamp("2020-01-01") + pd.DateOffset(months=k)
    table = lambda rows: spark.createDataFrame([(day(k).date(), v) for k, v in rows], "date date, value double")
    series = table([(0, 1.0), (1, -2.0), (2, 3.0), (3, 4.0), (4, None)])
    history = table([(1, 5.0), (2, 5.0), (3, 5.0), (5, 5.0)])
    got = sorted((r["draw"], str(r["date"])[:7], r["value"]) for r in N.observed_paths(series, history, 2).collect())
    assert got == [(d, m, v) for d in (0, 1) for m, v in (("2020-02", -2.0), ("2020-03", 3.0), ("2020-04", 4.0))]
    with pytest.raises(ValueError, match="2020-03"):
        N.observed_paths(series.filter("value <> 3"), history, 2)
    assert [str(r["date"])[:7] for r in N.overlap_gaps(series, table([(0, 1.0), (1, -1.0), (2, 0.0), (3, 1.0)])).collect()] == ["2020-02", "2020-03"]
