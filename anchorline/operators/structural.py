"""What a posterior says about shocks: impacts at a date, responses, variance shares, decompositions, total responses.

Each operator takes a stored posterior (rows of models.gibbs() with ``scales``) and sees one draw of one model at a time, so work
is dealt over draws. Decompositions are exact: the base path and the shocks' parts sum to the data of each draw.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.models import dealt, matrices

Keys = Sequence[str]
#: Largest difference between the data and the sum of a decomposition's parts.
RECONSTRUCTION = 1e-8


class Draw:
    """One draw's matrices: lags [lag, equation, variable], mean, impact rows, and the shocks' deviations by date."""

    def __init__(self, frame: pd.DataFrame) -> None:
        coefficients = frame[frame["kind"] == "b"]
        self.names, self.b = matrices(coefficients)
        self.flat = coefficients[coefficients["lag"] == 0].pivot(index="variable", columns="equation", values="b").reindex(columns=self.names).fillna(0.0)
        n = len(self.names)
        self.a = np.eye(n)
        for e, v, x in frame[frame["kind"] == "a"][["equation", "variable", "b"]].itertuples(index=False):
            self.a[self.names.index(e), self.names.index(v)] = x
        scale, width = (frame[frame["kind"] == k].pivot(index="variable", columns="equation", values="b").sort_index() for k in ("scale", "width"))
        self.dates = list(scale.index)
        self.full = scale.reindex(columns=self.names).to_numpy(float)
        self.regular = self.full / width.reindex(columns=self.names).to_numpy(float) if len(width) else self.full

    def impact(self, at: str | None, outliers: bool) -> np.ndarray:
        """Effects at once of one standard deviation of each shock at a date, the last if none is named."""
        if at is not None and at not in self.dates:
            raise ValueError(f"{at} is no date of the sample, {self.dates[0]} to {self.dates[-1]}")
        row = -1 if at is None else self.dates.index(at)
        return np.linalg.solve(self.a, np.diag((self.full if outliers else self.regular)[row]))

    def mean(self, extra: pd.DataFrame) -> np.ndarray:
        """What constant and regressors (date, variable, x) add at each date."""
        x = np.ones((len(self.dates), len(self.flat)))
        if len(self.flat) > 1:
            told = extra.assign(date=extra["date"].astype(str)).drop_duplicates(["date", "variable"]).pivot(index="date", columns="variable", values="x").reindex(self.dates)
            for i, v in enumerate(self.flat.index):
                x[:, i] = 1.0 if v == "const" else told[v].to_numpy(float)
        return x @ self.flat.to_numpy(float)


def of_draws(posterior: DataFrame, keys: Keys, kernel, columns: str, other: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """``kernel`` of each draw's rows (and of its rows of ``other``) as keys..., draw and ``columns``."""
    kinds, by = dict(posterior.dtypes), [*keys, "draw"]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int", columns])
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key, frame: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        made = kernel(frame, rest) if len(frame) else pd.DataFrame({c: [] for c in names})
        return made.assign(**dict(zip(by, key, strict=True)))[[*by, *names]]

    if other is None:
        return dealt(posterior, by).groupBy(*by).applyInPandas(lambda key, frame: run(key, frame, frame), schema)
    return dealt(posterior, by).groupBy(*by).cogroup(dealt(other, by).groupBy(*by)).applyInPandas(run, schema)


def long_matrix(names: Sequence[str], shocks: Sequence[str], m: np.ndarray) -> pd.DataFrame:
    i, j = (x.ravel() for x in np.indices(m.shape))
    return pd.DataFrame({"response": np.array(names, object)[i], "shock": np.array(shocks, object)[j], "value": m.ravel()})


def impacts_at(posterior: DataFrame, keys: Keys, at: str | None = None, outliers: bool = False) -> DataFrame:
    """keys..., draw, response, shock, value: effects of one standard deviation of each shock at a reference date, series in the order of
    their names. Outliers pass, so they are left out unless asked for. ValueError if the date is outside the sample."""

    def kernel(frame: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        one = Draw(frame)
        return long_matrix(one.names, one.names, one.impact(at, outliers))

    return of_draws(posterior.filter("kind in ('b', 'a', 'scale', 'width')"), keys, kernel, "response string, shock string, value double")


def sign_impacts_at(posterior: DataFrame, keys: Keys, signs: dict[tuple[str, str, int], int], tries: int, seed: int, at: str | None = None, cumulative: dict[tuple[str, str, int], int] | None = None) -> DataFrame:
    """keys..., draw, response, shock, value, tried: impacts at a date, rotated at random until responses have the signs.

    ``signs`` has +1 or -1 for (shock, response, horizon), ``cumulative`` the same for sums of responses up to a horizon; shocks are named
    by them, in order, and there is one for each series. A draw without an accepted rotation among ``tries`` has no rows.
    """
    rules = [(*k, s, False) for k, s in signs.items()] + [(*k, s, True) for k, s in (cumulative or {}).items()]
    shocks = list(dict.fromkeys(k[0] for k in rules))
    horizon = max(k[2] for k in rules)

    def kernel(frame: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        one = Draw(frame)
        if len(shocks) != len(one.names) or any(r not in one.names for _, r, *_ in rules):
            raise ValueError(f"signs name shocks {shocks} for series {one.names}")
        first, rng = one.impact(at, False), np.random.default_rng([seed, *"|".join(str(frame[k].iat[0]) for k in keys).encode(), int(frame["draw"].iat[0])])
        psi = responses_of(one.b, np.eye(len(shocks)), horizon)
        for tried in range(1, tries + 1):
            q, up = np.linalg.qr(rng.standard_normal(first.shape))
            impact = first @ (q * np.where(np.diag(up) < 0, -1, 1))
            path = psi @ impact
            sums = np.cumsum(path, axis=0)
            if all((sums if total else path)[h, one.names.index(r), shocks.index(s)] * sign > 0 for s, r, h, sign, total in rules):
                return long_matrix(one.names, shocks, impact).assign(tried=tried)
        return pd.DataFrame({"response": [], "shock": [], "value": [], "tried": []})

    return of_draws(posterior.filter("kind in ('b', 'a', 'scale', 'width')"), keys, kernel, "response string, shock string, value double, tried int")


def responses_of(b: np.ndarray, impact: np.ndarray, horizon: int) -> np.ndarray:
    out = [impact]
    for h in range(1, horizon + 1):
        out.append(sum(b[k] @ out[h - 1 - k] for k in range(min(len(b), h))))
    return np.stack(out)


def responses(posterior: DataFrame, impacts: DataFrame, keys: Keys, horizon: int, unit: str | None = None) -> DataFrame:
    """keys..., draw, response, shock, h, value, cumulative of each draw from its ``impacts``; with ``unit`` shocks are of the size that
    moves the series of their own name (or the one named, for all) by one at once. ValueError if that impact is nearly 0."""

    def kernel(frame: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        names, b = matrices(frame)
        wide = rest.pivot(index="response", columns="shock", values="value").reindex(index=names)
        if wide.empty:
            return pd.DataFrame({c: [] for c in ("response", "shock", "h", "value", "cumulative")})
        first = wide.to_numpy(float)
        if unit is not None:
            own = np.array([first[names.index(unit if unit != "own" else s), j] for j, s in enumerate(wide.columns)])
            if (np.abs(own) < 1e-12).any():
                raise ValueError("a shock hardly moves the series of its size")
            first = first / own
        cube = responses_of(b, first, horizon)
        h, i, j = (x.ravel() for x in np.indices(cube.shape))
        return pd.DataFrame({"response": np.array(names, object)[i], "shock": np.array(wide.columns, object)[j], "h": h, "value": cube.ravel(), "cumulative": np.cumsum(cube, axis=0).ravel()})

    return of_draws(posterior.filter("kind = 'b' and lag > 0"), keys, kernel, "response string, shock string, h int, value double, cumulative double", impacts)


def variance_shares(irf: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, response, shock, horizon (1 for the first), share: what a shock's squared responses up to a horizon are of all shocks' ones."""
    by = [*keys, "draw"]
    upto = Window.partitionBy(*by, "response", "shock").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    made = irf.withColumn("own", F.sum(F.col("value") * F.col("value")).over(upto))
    total = F.sum("own").over(Window.partitionBy(*by, "response", "h"))
    return made.select(*by, "response", "shock", (F.col("h") + 1).alias("horizon"), F.when(total > 0, F.col("own") / total).otherwise(0.0).alias("share"))


def panels_of(posterior: DataFrame, panel: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, date, series, value: the data, and each draw's own values where there are none."""
    drawn = posterior.filter("kind = 'missing'").select(*keys, "draw", F.to_date("variable").alias("date"), F.col("equation").alias("series"), F.col("b").alias("value"))
    draws = posterior.filter("kind = 'phi'").select(*keys, "draw").distinct()
    return panel.filter("value is not null").join(draws, list(keys)).select(*keys, "draw", "date", "series", "value").unionByName(drawn)


def decomposition(posterior: DataFrame, panel: DataFrame, keys: Keys, impacts: DataFrame | None = None, at: str | None = None, regressors: DataFrame | None = None) -> DataFrame:
    """keys..., draw, date, response, shock, regular, outlier: the data of each draw as the sum of a base path and of every shock's parts.

    The base (shock ``base``) goes on from the first dates without shocks. A shock's ``regular`` part is what it had been without
    outliers, ``outlier`` what they amplify. With sign-restricted ``impacts`` at the reference date ``at`` each draw's rotation holds
    on all dates, and draws without one are left out. RuntimeError if parts miss the data by more than RECONSTRUCTION.
    """
    by, signed = [*keys, "draw"], impacts is not None

    def kernel(frame: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        one = Draw(frame)
        n, names, p = len(one.names), one.names, len(one.b)
        data = rest[rest["role"] == "data"].pivot(index="date", columns="series", values="value").sort_index()[names]
        z, days = data.to_numpy(float), [str(d)[:10] for d in data.index]
        first = days.index(one.dates[0])
        turn, shocks = np.eye(n), names
        told = rest[rest["role"] == "impact"]
        if signed:
            if told.empty:
                return pd.DataFrame({c: [] for c in ("date", "response", "shock", "regular", "outlier")})
            wide = told.pivot(index="series", columns="shock", values="value").reindex(index=names)
            turn, shocks = np.linalg.solve(one.impact(at, False), wide.to_numpy(float)), list(wide.columns)
        mean = one.mean(rest[rest["role"] == "regressor"].rename(columns={"series": "variable", "value": "x"}))
        outcomes = len(one.dates)
        z = z[first - p : first + outcomes]
        # Of each date: the base and the shocks' regular and whole parts, side by side.
        parts = np.zeros((outcomes + p, n, 1 + 2 * n))
        parts[:p, :, 0] = z[:p]
        inverse = np.linalg.inv(one.a)
        for t in range(outcomes):
            fitted = mean[t] + sum(one.b[k] @ z[p + t - 1 - k] for k in range(p))
            whole, usual = (inverse * one.full[t]) @ turn, (inverse * one.regular[t]) @ turn
            e = np.linalg.solve(whole, z[p + t] - fitted)
            now = sum(one.b[k] @ parts[p + t - 1 - k] for k in range(p))
            now[:, 0] += mean[t]
            now[:, 1 : n + 1] += usual * e
            now[:, n + 1 :] += whole * e
            parts[p + t] = now
        base, regular, whole = parts[p:, :, 0], parts[p:, :, 1 : n + 1], parts[p:, :, n + 1 :]
        gap = np.abs(base + whole.sum(2) - z[p:]).max()
        if gap > RECONSTRUCTION:
            raise RuntimeError(f"the parts of draw {frame['draw'].iat[0]} miss the data by {gap:.1e}")
        t, i, j = (x.ravel() for x in np.indices((outcomes, n, n + 1)))
        cube = np.concatenate([base[:, :, None], regular], axis=2)
        extra = np.concatenate([np.zeros((outcomes, n, 1)), whole - regular], axis=2)
        return pd.DataFrame({"date": pd.to_datetime(np.array(one.dates, object)[t]).date, "response": np.array(names, object)[i], "shock": np.array(["base", *shocks], object)[j], "regular": cube.ravel(), "outlier": extra.ravel()})

    blank = F.lit(None).cast("string")
    rest = panels_of(posterior, panel, keys).select(*by, F.lit("data").alias("role"), "date", "series", blank.alias("shock"), "value")
    if signed:
        rest = rest.unionByName(impacts.select(*by, F.lit("impact").alias("role"), F.lit(None).cast("date").alias("date"), F.col("response").alias("series"), "shock", "value"))
    if regressors is not None:
        draws = posterior.filter("kind = 'phi'").select(*by).distinct()
        rest = rest.unionByName(draws.join(regressors, list(keys)).select(*by, F.lit("regressor").alias("role"), "date", F.col("variable").alias("series"), blank.alias("shock"), F.col("x").alias("value")))
    return of_draws(posterior.filter("kind in ('b', 'a', 'scale', 'width')"), keys, kernel, "date date, response string, shock string, regular double, outlier double", rest)


def reconstruction(parts: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, date, response, value: the sum of a decomposition's parts."""
    return parts.groupBy(*keys, "draw", "date", "response").agg(F.sum(F.col("regular") + F.col("outlier")).alias("value"))


def reconstruction_gaps(parts: DataFrame, posterior: DataFrame, panel: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draws, gap, exact: the largest distance of a model's parts from its data, over all draws and dates."""
    data = panels_of(posterior, panel, keys).withColumnsRenamed({"series": "response", "value": "data"})
    both = reconstruction(parts, keys).join(data, [*keys, "draw", "date", "response"])
    gap = F.max(F.abs(F.col("value") - F.col("data")))
    return both.groupBy(*keys).agg(F.count_distinct("draw").alias("draws"), gap.alias("gap"), (gap <= RECONSTRUCTION).alias("exact"))


def quiet_paths(posterior: DataFrame, panel: DataFrame, keys: Keys, horizon: int, at: str | None = None) -> DataFrame:
    """keys..., draw, h, series, value: each draw's path from a date on if no shock came, h = 0 being the first period after it.

    ValueError for a model with regressors, whose future the path would need.
    """

    def kernel(frame: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        names, b = matrices(frame)
        if not set(frame[frame["lag"] == 0]["variable"]) <= {"const"}:
            raise ValueError("a path without shocks needs a model without regressors")
        const = frame[frame["variable"] == "const"].set_index("equation")["b"].reindex(names).to_numpy(float)
        data = rest.pivot(index="date", columns="series", values="value").sort_index()[names]
        days = [str(d)[:10] for d in data.index]
        end = len(days) if at is None else days.index(at) + 1
        past, out = list(data.to_numpy(float)[max(0, end - len(b)) : end][::-1]), []
        for _ in range(horizon + 1):
            past = [const + sum(b[k] @ past[k] for k in range(len(b))), *past[: len(b) - 1]]
            out.append(past[0])
        h, i = (x.ravel() for x in np.indices((horizon + 1, len(names))))
        return pd.DataFrame({"h": h, "series": np.array(names, object)[i], "value": np.stack(out).ravel()})

    return of_draws(posterior.filter("kind = 'b'"), keys, kernel, "h int, series string, value double", panels_of(posterior, panel, keys))


def total_response(quiet: DataFrame, irf: DataFrame, start: DataFrame, weights: DataFrame, keys: Keys, unit: float = 100.0) -> DataFrame:
    """keys..., draw, shock, h, effect: per cent by which a weighted total of levels moves.

    ``start`` (keys..., series, value) are the levels before h = 0; each draw's ``quiet`` changes (log changes times ``unit``) lead on from
    there, and with a shock the levels are the exponential of the cumulative responses higher. ``weights`` are keys..., series, w.
    """
    upto = Window.partitionBy(*keys, "draw", "series").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    level = quiet.withColumn("sum", F.sum("value").over(upto)).join(start.withColumnRenamed("value", "level0"), [*keys, "series"]).join(weights, [*keys, "series"])
    level = level.select(*keys, "draw", "h", "series", (F.col("w") * F.col("level0") * F.exp(F.col("sum") / unit)).alias("base"))
    told = irf.select(*[F.col(c).alias(c) for c in (*keys, "draw", "h", "shock", "cumulative")], F.col("response").alias("series"))
    moved = level.join(told, [*keys, "draw", "h", "series"])
    sums = moved.groupBy(*keys, "draw", "shock", "h").agg(F.sum("base").alias("base"), F.sum(F.col("base") * F.exp(F.col("cumulative") / unit)).alias("shocked"))
    return sums.select(*keys, "draw", "shock", "h", (100 * (F.col("shocked") / F.col("base") - 1)).alias("effect"))


def volatility(posterior: DataFrame, keys: Keys, outliers: bool = True) -> DataFrame:
    """keys..., draw, date, series, value: the deviation of each date's shock, with or without the outliers' part."""
    rows = lambda kind: posterior.filter(F.col("kind") == kind).select(*keys, "draw", F.to_date("variable").alias("date"), F.col("equation").alias("series"), F.col("b").alias("value"))
    full = rows("scale")
    if outliers:
        return full
    on = [*keys, "draw", "date", "series"]
    return full.join(rows("width").withColumnRenamed("value", "width"), on).select(*on, (F.col("value") / F.col("width")).alias("value"))


def gates(posterior: DataFrame, keys: Keys, gate: float) -> DataFrame:
    """keys..., draw, series, error, at (place of the worst date), adjustment, passed: how near the smoother came to what is observed."""
    kinds = {"projection": "error", "projection at": "at", "adjustment": "adjustment"}
    rows = posterior.filter(F.col("kind").isin(*kinds)).groupBy(*keys, "draw", F.col("equation").alias("series"))
    wide = rows.agg(*[F.max(F.when(F.col("kind") == k, F.col("b"))).alias(v) for k, v in kinds.items()])
    return wide.withColumn("at", F.col("at").cast("int")).withColumn("passed", F.col("error") <= gate)
