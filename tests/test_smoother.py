"""The simulation smoother against the joint normal of all dates; regressors of the models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.operators import models as M
from anchorline.operators import smoother as S

PANEL = "model_id string, date date, series string, value double"


def dense_moments(seen, guess, b, mean, a, spread, lags, levels, vague):
    """Mean and covariance of the missing cells: the panel is linear in its first dates and shocks, so all of it is one normal."""
    rows, n = seen.shape
    q = lags + levels
    known = ~np.isnan(seen)
    size = q * n + len(mean) * n
    slope, const = np.zeros((rows, n, size)), np.zeros((rows, n))
    for t in range(q):
        for j in range(n):
            slope[t, j, t * n + j] = 1.0
            const[t, j] = seen[t, j] if known[t, j] else guess[t, j]
    change = lambda t: (slope[t + 1] - slope[t], const[t + 1] - const[t]) if levels else (slope[t], const[t])
    for t in range(len(mean)):
        s, c = np.zeros((n, size)), mean[t].copy()
        s[:, q * n + t * n : q * n + (t + 1) * n] = np.linalg.inv(a) @ np.diag(spread[t])
        for k in range(lags):
            ds, dc = change(lags + t - 1 - k)
            m = b[k * n : (k + 1) * n].T
            s, c = s + m @ ds, c + m @ dc
        slope[q + t], const[q + t] = (slope[q + t - 1] + s, const[q + t - 1] + c) if levels else (s, c)
    var = np.concatenate([(~known[:q]).ravel() * np.tile(vague, q) ** 2, np.ones(len(mean) * n)])
    flat, at, late = slope.reshape(-1, size), known.ravel(), np.arange(rows * n) >= q * n
    cov = (flat * var) @ flat.T
    obs, mis = at & late, ~at
    gain = np.linalg.solve(cov[np.ix_(obs, obs)], cov[np.ix_(obs, mis)]).T
    return const.ravel()[mis] + gain @ (seen.ravel() - const.ravel())[obs], cov[np.ix_(mis, mis)] - gain @ cov[np.ix_(obs, mis)]


@pytest.mark.parametrize("levels", [False, True])
@pytest.mark.parametrize("lags", [1, 2])
@pytest.mark.parametrize("first", [False, True])
def test_draws_have_the_moments_of_the_joint_normal(levels, lags, first):
    rng = np.random.default_rng(1)
    n, rows = 2, 9
    b = np.concatenate([np.array([[0.5, -0.2], [0.1, 0.4]]) / (k + 1) for k in range(lags)])
    a, outcomes = np.array([[1.0, 0.0], [0.7, 1.0]]), rows - lags - levels
    mean, spread = 0.3 * rng.standard_normal((outcomes, n)), np.exp(0.3 * rng.standard_normal((outcomes, n)))
    whole = np.cumsum(rng.standard_normal((rows, n)), axis=0)
    seen = whole.copy()
    seen[4, 0] = seen[5, 0] = seen[5, 1] = seen[rows - 1, 1] = seen[rows - 2, 1] = np.nan
    if first:
        seen[1, 0] = np.nan
    vague, guess = np.full(n, 3.0), np.zeros_like(seen)
    out = np.array([S.draw_states(rng, seen, guess, b, mean, a, spread, lags, levels, vague).whole for _ in range(6000)])
    centre, cov = dense_moments(seen, guess, b, mean, a, spread, lags, levels, vague)
    mis = np.isnan(seen).ravel()
    got = out.reshape(len(out), -1)[:, mis]
    sd = np.sqrt(np.diag(cov))
    assert got.mean(0) == pytest.approx(centre, abs=5 * sd.max() / np.sqrt(6000))
    assert np.cov(got.T) == pytest.approx(cov, abs=0.08 * sd.max() ** 2)
    assert (out.reshape(len(out), -1)[:, ~mis] == seen.ravel()[~mis]).all()


def test_errors_of_observed_levels_are_tiny_and_told():
    rng = np.random.default_rng(2)
    seen = 1000 + np.cumsum(rng.standard_normal((150, 3)), axis=0)
    seen[rng.random(seen.shape) < 0.3] = np.nan
    seen[0] = 1000.0
    drawn = S.draw_states(rng, seen, np.nan_to_num(seen, nan=1000.0), 0.3 * np.eye(3, 3), np.zeros((148, 3)), np.eye(3), np.ones((148, 3)), 1, True, np.full(3, 100.0))
    assert 0 < drawn.level_error.max() < 1e-9 and drawn.change_error.max() < 1e-6 and drawn.change_error.shape == (149, 3)


def seasonal(n, seed):
    """Two series, the first with a lift of 3 each twelfth period and the second driven by what is known of the future."""
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2000-01-01", periods=n + 12, freq="MS")
    x = rng.standard_normal(n + 12)
    y = np.zeros((n, 2))
    for t in range(1, n):
        y[t] = np.array([[0.4, 0.0], [0.1, 0.3]]) @ y[t - 1] + [3.0 * (dates[t].month == 1), 2.0 * x[t]] + 0.5 * rng.standard_normal(2)
    panel = [("m", dates[t].date(), s, float(y[t, j])) for t in range(n) for j, s in enumerate("xy")]
    extra = [("m", d.date(), v, float(w), e) for d, driver in zip(dates, x, strict=True) for v, w, e in (("january", d.month == 1, "x"), ("driver", driver, "y"))]
    return panel, extra, n, dates


@pytest.fixture(scope="module")
def made(spark):
    panel, extra, n, dates = seasonal(240, 4)
    p = spark.createDataFrame(panel, PANEL)
    e = spark.createDataFrame(extra, "model_id string, date date, variable string, x double, equation string")
    return p, e, n, dates


def test_fit_with_regressors_of_single_equations(made):
    panel, extra, n, _ = made
    got = {(r["equation"], r["variable"], r["lag"]): r["b"] for r in M.fit(panel, ["model_id"], 1, regressors=extra, only={"january": ["x"], "driver": ["y"]}).collect()}
    assert got["x", "january", 0] == pytest.approx(3.0, abs=0.4) and got["y", "driver", 0] == pytest.approx(2.0, abs=0.15)
    assert ("y", "january", 0) not in got and ("x", "driver", 0) not in got
    wide = panel.toPandas().pivot(index="date", columns="series", values="value").to_numpy()
    jan = extra.filter("variable = 'january'").orderBy("date").toPandas()["x"].to_numpy()[1:n]
    b = np.linalg.lstsq(np.column_stack([wide[:-1], np.ones(n - 1), jan]), wide[1:, 0], rcond=None)[0]
    assert [got["x", "x", 1], got["x", "y", 1], got["x", "const", 0], got["x", "january", 0]] == pytest.approx(b.tolist())
    for r in M.fitted(panel, M.fit(panel, ["model_id"], 1, regressors=extra), ["model_id"], 1, regressors=extra).filter("equation = 'x' and month(date) = 1").collect():
        assert r["value"] > 1.0


def test_gibbs_finds_a_planted_season_and_forecasts_with_it(spark, made):
    panel, extra, n, dates = made
    draws = M.gibbs(panel, ["model_id"], 1, 60, 40, 3, regressors=extra).cache()
    means = {(r["equation"], r["variable"]): r["m"] for r in draws.filter("kind = 'b' and lag = 0").groupBy("equation", "variable").agg(F.avg("b").alias("m")).collect()}
    assert means.keys() == {("x", "const"), ("y", "const"), ("x", "january"), ("y", "driver")}
    assert means["x", "january"] == pytest.approx(3.0, abs=0.4) and means["y", "driver"] == pytest.approx(2.0, abs=0.2)
    ahead = extra.filter(F.col("date") > dates[n - 1].date()).withColumn("h", F.months_between("date", F.lit(str(dates[n - 1].date())).cast("date")).cast("int"))
    fan = {(r["series"], r["h"]): r["m"] for r in M.simulate(draws, M.tail_of(panel, ["model_id"], 1), ["model_id"], 12, 5, regressors=ahead).groupBy("series", "h").agg(F.avg("value").alias("m")).collect()}
    january = next(k for k in range(12) if dates[n + k].month == 1) + 1
    assert fan["x", january] > 2.0 and fan["x", january] > fan["x", january - 1 or january + 3] + 1.0
    with pytest.raises(Exception, match="lacks a period"):
        M.simulate(draws, M.tail_of(panel, ["model_id"], 1), ["model_id"], 12, 5, regressors=ahead.filter("h < 6")).count()
    with pytest.raises(Exception, match="lack dates"):
        M.gibbs(panel, ["model_id"], 1, 2, 2, 3, regressors=extra.filter("date < '2010-01-01'")).count()


def test_ragged_end_and_conditions_of_single_draws(spark):
    rng = np.random.default_rng(8)
    y = 100 + np.cumsum(rng.standard_normal((120, 2)), axis=0)
    y[118:, 1] = np.nan
    dates = pd.date_range("2000-01-01", periods=120, freq="MS").date
    panel = spark.createDataFrame([("m", dates[t], s, None if np.isnan(y[t, j]) else float(y[t, j])) for t in range(120) for j, s in enumerate("xy")], PANEL)
    draws = M.gibbs(panel, ["model_id"], 1, 20, 10, 3, levels=True).cache()
    gates = draws.filter("kind = 'projection'").agg(F.max("b").alias("worst"), F.count("*").alias("n")).first()
    assert gates["worst"] <= M.LEVEL_GATE and gates["n"] == 40
    # Each draw goes on from its own end, and meets its own condition.
    whole = M.completed(panel, draws, ["model_id"])
    changes = M.changes_of(whole, ["model_id", "draw"])
    tail = M.tail_of(changes, ["model_id", "draw"], 1)
    asked = draws.select("model_id", "draw").distinct().select("model_id", "draw", F.lit("x").alias("series"), F.lit(2).alias("h"), F.col("draw").cast("double").alias("value"))
    paths = M.simulate(draws, tail, ["model_id"], 3, 7, asked).filter("series = 'x' and h = 2").collect()
    assert len(paths) == 20 and all(r["value"] == pytest.approx(r["draw"], abs=1e-8) for r in paths)
