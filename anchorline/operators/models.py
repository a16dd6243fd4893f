"""Vector autoregressions: designs, fits and structural paths as relations, with small matrix kernels per model or draw.

What grows with the data (design rows, cross products, draws, horizons) stays in tables; a kernel only sees one model's
cross products, or one draw's coefficients. Coefficients are rows (keys..., equation, variable, lag, b); lag 0 and the
variable ``const`` are the intercept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.smoother import VAGUE, draw_states

Keys = Sequence[str]


def dealt(df: DataFrame, keys: Keys) -> DataFrame:
    """``df`` over four tasks a core, by ``keys``: groups are small in bytes and long in work, so what coalesces partitions by their bytes
    must not put them together. Grouping by the keys then needs no other shuffle. Columns are named anew, so that frames of one
    origin can be grouped side by side."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def design(panel: DataFrame, keys: Keys, lags: int, regressors: DataFrame | None = None) -> DataFrame:
    """keys..., date, variable, lag, x: every regressor of a date whose lags are all there; ``const`` is 1.

    ``regressors`` (keys..., date, variable, x) have lag 0; of a date that has them but no lags there is nothing.
    """
    w = Window.partitionBy(*keys, "series").orderBy("date")
    lagged = panel.select(*keys, "date", F.col("series").alias("variable"), F.array(*[F.lag("value", k).over(w) for k in range(1, lags + 1)]).alias("x"))
    whole = lagged.filter(~F.exists("x", lambda v: v.isNull()))
    long = whole.select(*keys, "date", "variable", F.posexplode("x").alias("lag", "x")).withColumn("lag", F.col("lag") + 1)
    const = whole.select(*keys, "date").distinct().select(*keys, "date", F.lit("const").alias("variable"), F.lit(0).alias("lag"), F.lit(1.0).alias("x"))
    if regressors is not None:
        given = regressors.select(*keys, "date", "variable", F.lit(0).alias("lag"), "x").dropDuplicates([*keys, "date", "variable"])
        long = long.unionByName(given.join(const.select(*keys, "date"), [*keys, "date"], "left_semi"))
    return long.unionByName(const)


def cross_products(panel: DataFrame, keys: Keys, lags: int, regressors: DataFrame | None = None) -> DataFrame:
    """Sums over dates of the products of all pairs of regressors, and of regressors with outcomes (named |y).

    A date's regressors are one array, so its products are made in one row and summed before they are shuffled.
    """
    x = design(panel, keys, lags, regressors).select(*keys, "date", F.concat_ws("|", "variable", F.lpad(F.col("lag").cast("string"), 2, "0")).alias("name"), "x")
    y = panel.filter("value is not null").select(*keys, "date", F.concat("series", F.lit("|y")).alias("name"), F.col("value").alias("x"))
    row = F.collect_list(F.struct("name", "x"))
    is_y = lambda v: v["name"].endswith("|y")
    at = x.unionByName(y).groupBy(*keys, "date").agg(row.alias("row"))
    at = at.select(*keys, F.filter("row", lambda v: ~is_y(v)).alias("left"), "row").filter("size(left) > 0")
    # Only dates on which all regressors are there.
    at = at.withColumn("most", F.max(F.size("left")).over(Window.partitionBy(*keys))).filter("size(left) = most")
    pairs = F.flatten(F.transform("left", lambda a: F.transform("row", lambda b: F.struct(a["name"].alias("name"), b["name"].alias("other"), (a["x"] * b["x"]).alias("s")))))
    return at.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, F.col("p.name").alias("name"), F.col("p.other").alias("other")).agg(F.sum("p.s").alias("s"))


def fit(panel: DataFrame, keys: Keys, lags: int, ridge: float = 0.0, regressors: DataFrame | None = None, only: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """keys..., equation, variable, lag, b: least squares of every equation, from the cross products of each model.

    ``only`` names the equations that a regressor is in; a regressor that it does not name is in all.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="name", columns="other", values="s")
        names = list(wide.index)
        outcomes = [c for c in wide.columns if c.endswith("|y")]
        xx = wide[names].to_numpy(float)
        rows = []
        for eq in outcomes:
            mine = [i for i, n in enumerate(names) if not (only and n.endswith("|00") and n[:-3] in only and eq[:-2] not in only[n[:-3]])]
            b = np.linalg.solve(xx[np.ix_(mine, mine)] + ridge * np.eye(len(mine)), wide[eq].to_numpy(float)[mine])
            rows += [(eq[:-2], *names[i].rsplit("|", 1), v) for i, v in zip(mine, b, strict=True)]
        out = pd.DataFrame(rows, columns=["equation", "variable", "lag", "b"]).astype({"lag": int})
        for k in keys:
            out[k] = frame[k].iat[0]
        return out

    sums = cross_products(panel, keys, lags, regressors)
    kinds = dict(panel.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "equation string, variable string, lag int, b double"])
    return sums.groupBy(*keys).applyInPandas(solve, schema)


def fitted(panel: DataFrame, coefficients: DataFrame, keys: Keys, lags: int, draws: Keys = (), regressors: DataFrame | None = None) -> DataFrame:
    """keys..., draws..., date, equation, value: the one-step mean as a sparse product of design and coefficients."""
    x = design(panel, keys, lags, regressors)
    return x.join(coefficients, [*keys, "variable", "lag"]).groupBy(*keys, *draws, "date", "equation").agg(F.sum(F.col("x") * F.col("b")).alias("value"))


def matrices(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The variables in order, and the lag matrices [lag, equation, variable]."""
    names = sorted(frame["equation"].unique())
    at = {n: i for i, n in enumerate(names)}
    rows = frame[frame["lag"] > 0]
    out = np.zeros((int(rows["lag"].max()), len(names), len(names)))
    out[rows["lag"] - 1, rows["equation"].map(at), rows["variable"].map(at)] = rows["b"]
    return names, out


def companion_roots(coefficients: DataFrame, keys: Keys) -> DataFrame:
    """keys..., modulus, angle of the companion matrix's roots, a row each."""

    def roots(frame: pd.DataFrame) -> pd.DataFrame:
        names, b = matrices(frame)
        n, p = len(names), len(b)
        m = np.zeros((n * p, n * p))
        m[:n] = np.concatenate(list(b), axis=1)
        m[n:, :-n] = np.eye(n * (p - 1))
        z = np.linalg.eigvals(m)
        return pd.DataFrame({**{k: frame[k].iat[0] for k in keys}, "modulus": np.abs(z), "angle": np.abs(np.angle(z))})

    kinds = dict(coefficients.dtypes)
    return coefficients.groupBy(*keys).applyInPandas(roots, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "modulus double, angle double"]))


def spectral_radius(roots: DataFrame, keys: Keys) -> DataFrame:
    return roots.groupBy(*keys).agg(F.max("modulus").alias("radius"), (F.max("modulus") < 1).alias("stable"))


def root_bands(roots: DataFrame, draw_keys: Keys, periods: Sequence[float] = (12, 6, 4, 3, 2.4, 2)) -> DataFrame:
    """Largest modulus of each draw within pi/24 of the angle of each period; the trend's angle is 0."""
    bands = F.array(F.struct(F.lit("trend").alias("band"), F.lit(0.0).alias("at")), *[F.struct(F.lit(f"{p:g}").alias("band"), F.lit(2 * np.pi / p).alias("at")) for p in periods])
    near = roots.withColumn("b", F.explode(bands)).filter(F.abs(F.col("angle") - F.col("b.at")) <= np.pi / 24)
    return near.groupBy(*draw_keys, F.col("b.band").alias("band")).agg(F.max("modulus").alias("modulus"))


def impulse_responses(coefficients: DataFrame, impacts: DataFrame, keys: Keys, horizons: int) -> DataFrame:
    """keys..., response, shock, h, value: the moving-average recursion of each model or draw from its impact matrix.

    ``impacts`` has keys..., response, shock, value at h = 0.
    """

    def paths(key, frame: pd.DataFrame, impact: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        names, b = matrices(frame)
        first = impact.pivot(index="response", columns="shock", values="value").reindex(index=names).fillna(0)
        theta = [first.to_numpy(float)]
        for h in range(1, horizons + 1):
            theta.append(sum(b[k] @ theta[h - 1 - k] for k in range(min(len(b), h))))
        cube = np.stack(theta)
        shape = cube.shape
        h, i, j = (x.ravel() for x in np.indices(shape))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "response": np.array(names)[i], "shock": np.array(first.columns)[j], "h": h, "value": cube.ravel()})

    kinds = dict(coefficients.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "response string, shock string, h int, value double"])
    return coefficients.groupBy(*keys).cogroup(impacts.groupBy(*keys)).applyInPandas(paths, schema)


def cumulative(irf: DataFrame, keys: Keys) -> DataFrame:
    w = Window.partitionBy(*keys, "response", "shock").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return irf.withColumn("cumulative", F.sum("value").over(w))


def variance_shares(irf: DataFrame, keys: Keys) -> DataFrame:
    """keys..., response, shock, h, share: squared responses summed up to h, over the sum of all shocks' ones."""
    w = Window.partitionBy(*keys, "response", "shock").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    made = irf.withColumn("own", F.sum(F.col("value") * F.col("value")).over(w))
    return made.withColumn("share", F.col("own") / F.sum("own").over(Window.partitionBy(*keys, "response", "h"))).select(*keys, "response", "shock", "h", "share")


def nonlinear_response(levels: DataFrame, irf: DataFrame, keys: Keys, weights: DataFrame) -> DataFrame:
    """keys..., date, effect in percent of the weighted total when each series moves by exp(its cumulative response).

    ``levels`` (series, date, h, value) are the base path, ``irf`` has keys..., series, h, cumulative; ``weights`` series, w.
    """
    both = levels.join(irf, ["series", "h"]).join(weights, "series")
    moved = both.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.col("value")).alias("base"), F.sum(F.col("w") * F.col("value") * F.exp("cumulative")).alias("shocked"))
    return moved.select(*keys, "date", (100 * (F.col("shocked") / F.col("base") - 1)).alias("effect"))


def historical_decomposition(shocks: DataFrame, irf: DataFrame, keys: Keys, outlier: str | None = None) -> DataFrame:
    """keys..., response, date, shock, contribution (and its part by outlier scales): past shocks times their responses.

    ``shocks`` has keys..., shock, t (period number), date, value and, if named, the scale by which an outlier widened it.
    """
    dates = shocks.select(*keys, "t", "date").distinct()
    regular = F.col("value") / F.col(outlier) if outlier else F.col("value")
    parts = shocks.select(*keys, "shock", F.col("t").alias("t0"), F.col("value").alias("e"), regular.alias("regular"))
    moved = parts.join(irf.select(*keys, "shock", "response", "h", F.col("value").alias("r")), [*keys, "shock"]).withColumn("t", F.col("t0") + F.col("h"))
    summed = moved.groupBy(*keys, "response", "shock", "t").agg(F.sum(F.col("e") * F.col("r")).alias("contribution"), F.sum((F.col("e") - F.col("regular")) * F.col("r")).alias("amplified"))
    return summed.join(dates, [*keys, "t"])


# The seven normals (probability, mean, variance) that stand for the log of a squared normal.
MIXTURE = np.array(
    [
        (0.00730, -10.12999, 5.79596),
        (0.10556, -3.97281, 2.61369),
        (0.00002, -8.56686, 5.17950),
        (0.04395, 2.77786, 0.16735),
        (0.34001, 0.61942, 0.64009),
        (0.24566, 1.79518, 0.34023),
        (0.25750, -1.08819, 1.26261),
    ]
)
OUTLIER_SCALES = np.arange(2, 21)
#: Draws of an equation's coefficients among which one has to be stable.
REDRAWS = 1000


def log_volatility(rng: np.random.Generator, y: np.ndarray, h: np.ndarray, phi: float, first_var: float = 10.0) -> np.ndarray:
    """A random-walk log variance given squared residuals: mixture states, a forward filter, backward draws."""
    u = np.log(y * y + max(1e-12, 1e-6 * float(np.median(y * y))))
    p, m, v = MIXTURE[:, 0], MIXTURE[:, 1] - 1.2704, MIXTURE[:, 2]
    logs = np.log(p) - 0.5 * np.log(v) - 0.5 * (u[:, None] - h[:, None] - m) ** 2 / v
    prob = np.exp(logs - logs.max(1, keepdims=True))
    s = (prob.cumsum(1) < rng.random(len(u))[:, None] * prob.sum(1, keepdims=True)).sum(1)
    mean, var = np.empty(len(u)), np.empty(len(u))
    a, q = float(u.mean()), first_var
    for t in range(len(u)):
        q += phi
        gain = q / (q + v[s[t]])
        a, q = a + gain * (u[t] - m[s[t]] - a), q * (1 - gain)
        mean[t], var[t] = a, q
    out = np.empty(len(u))
    out[-1] = mean[-1] + np.sqrt(var[-1]) * rng.standard_normal()
    for t in range(len(u) - 2, -1, -1):
        gain = var[t] / (var[t] + phi)
        out[t] = mean[t] + gain * (out[t + 1] - mean[t]) + np.sqrt(var[t] * (1 - gain)) * rng.standard_normal()
    return out


#: Largest error, relative to a level, by which the smoother may miss an observed one.
LEVEL_GATE = 1e-6
#: The prior: tightness on a series' own lags and, relative to it, on others' ones; how it tightens with the lag; deviation of a constant
#: and variance of an impact in units of the series' spread; yearly scale and degrees of freedom of the log variances' steps, their
#: variance before the first date; years between outliers, and years of observations that this is worth.
PRIOR = {"own": 0.2, "cross": 0.5, "decay": 1.0, "const": 10.0, "impact_var": 10.0, "phi": 0.6, "phi_df": 4.0, "h0_var": 10.0, "outlier_years": 4.0, "outlier_strength": 10.0}


class Kept:
    """Values of all draws by kind: one array a kind, and the names of its places."""

    def __init__(self) -> None:
        self.names: dict[str, tuple[list, list, list]] = {}
        self.values: dict[str, list[np.ndarray]] = {}

    def add(self, kind: str, places: list[tuple[str, str, int]], values: np.ndarray) -> None:
        if kind not in self.names:
            self.names[kind], self.values[kind] = tuple(map(list, zip(*places, strict=True))) if places else ([], [], []), []
        self.values[kind].append(np.array(values, float).ravel())

    def frame(self, extra: dict) -> pd.DataFrame:
        parts = []
        for kind, (equation, variable, lag) in self.names.items():
            made = np.stack(self.values[kind])
            d, m = made.shape
            parts.append(pd.DataFrame({"draw": np.repeat(np.arange(d), m), "kind": kind, "equation": np.tile(np.array(equation, object), d), "variable": np.tile(np.array(variable, object), d), "lag": np.tile(np.array(lag, int), d), "b": made.ravel()}))
        return pd.concat(parts, ignore_index=True).assign(**extra)


def regressor_matrix(extra: pd.DataFrame, dates: pd.Index, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of rows (date, variable, x, equation or none): the variables, their values by date, and which equation has which of them.

    ValueError is raised where a date lacks one.
    """
    if extra.empty:
        return [], np.zeros((len(dates), 0)), np.zeros((0, len(names)), bool)
    own = extra[["variable", "equation"]].drop_duplicates() if "equation" in extra.columns else extra[["variable"]].drop_duplicates().assign(equation=None)
    wide = extra.drop_duplicates(["date", "variable"]).pivot(index="date", columns="variable", values="x").reindex(dates)
    if wide.isna().to_numpy().any():
        raise ValueError(f"regressors {list(wide.columns[wide.isna().any()])} lack dates")
    variables = list(wide.columns)
    enters = np.zeros((len(variables), len(names)), bool)
    for v, e in own.itertuples(index=False):
        enters[variables.index(v), slice(None) if e is None or e != e else names.index(e)] = True
    return variables, wide.to_numpy(float), enters


def gibbs(
    panel: DataFrame, keys: Keys, lags: int, draws: int, burn: int, seed: int, own: float | None = None, cross: float | None = None, prior: dict[str, float] | None = None, periods: int = 12, levels: bool = False, scales: bool = False, regressors: DataFrame | None = None, regressor_sd: float = 10.0, failures: bool = False
) -> DataFrame:
    """keys..., draw, kind, equation, variable, lag, b: posterior draws of a VAR with volatility that moves and outliers.

    The model's values are those of ``panel``, or with ``levels`` their changes. Missing values from the first date on which all
    series have one, ragged ends included, are drawn in every sweep by the smoother, so that all observed ones hold exactly; kind ``missing`` has them, its variable being the date, ``projection``
    and ``adjustment`` the largest error of a draw's levels and changes before that, at their date. RuntimeError is raised if a level's is
    above LEVEL_GATE. ``regressors`` (keys..., date, variable, x, and equation, null for all) add to the mean of their equations; their
    coefficients have lag 0, mean 0 and ``regressor_sd`` times the series' spread over the regressor's own as deviation. ``prior`` replaces
    values of PRIOR (as do ``own`` and ``cross`` theirs), and columns of ``panel`` by those names replace them for their model; ``periods`` are those of a year.

    With ``scales`` kind ``scale`` has each date's standard deviation of a shock, outliers included, and ``width`` the outliers' part.
    A chain is one sequence of draws, so each model and chain (``keys``) is a task of its own, seeded by the seed and the
    key's text. Kinds: ``b`` coefficients (lag 0 the intercept), ``a`` impact rows, ``h`` last log variances, ``phi``,
    ``outlier`` probabilities. Draws whose roots lie outside the unit circle are drawn again, up to REDRAWS times an equation;
    RuntimeError is raised if none is stable, and for a series that never changes. With ``failures`` a chain that fails is one row of kind ``error``, its reason the variable.
    """
    kinds = dict(panel.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int, kind string, equation string, variable string, lag int, b double"])
    given = PRIOR | {k: v for k, v in (("own", own), ("cross", cross)) if v is not None} | (prior or {})

    def chain(frame: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="date", columns="series", values="value").sort_index()
        wide = wide[wide.notna().all(axis=1).cummax()].astype(float)
        names, seen = list(wide.columns), wide.to_numpy(float)
        gaps = np.argwhere(np.isnan(seen))
        whole = wide.interpolate(limit_direction="forward").to_numpy(float)
        z = np.diff(whole, axis=0) if levels else whole
        n, days = z.shape[1], [str(d)[:10] for d in wide.index]
        added, outside, enters = regressor_matrix(extra, wide.index[len(wide) - len(z) + lags :], names)
        design_of = lambda z: np.concatenate([z[lags - k : len(z) - k] for k in range(1, lags + 1)] + [np.ones((len(z) - lags, 1)), outside], axis=1)
        y, x = z[lags:], design_of(z)
        t, k = x.shape
        rng = np.random.default_rng([seed, *"|".join(str(frame[c].iat[0]) for c in keys).encode()])
        scale = np.array([np.std(np.diff(z[:, i])) for i in range(n)])
        if not (scale > 0).all():
            raise RuntimeError(f"{[x for x, v in zip(names, scale, strict=True) if not v > 0]} never change")
        sd = np.empty((k, n))
        told = {c: float(frame[c].iat[0]) if c in frame.columns else v for c, v in given.items()}
        for j in range(n):
            for lag in range(1, lags + 1):
                row = slice((lag - 1) * n, lag * n)
                sd[row, j] = told["own"] / lag ** told["decay"] * np.where(np.arange(n) == j, 1, told["cross"] * scale[j] / scale)
            sd[n * lags, j] = told["const"] * scale[j]
            sd[n * lags + 1 :, j] = regressor_sd * scale[j] / np.maximum(outside.std(axis=0), 1e-12)
        inside = np.concatenate([np.ones((n * lags + 1, n), bool), enters])
        b = np.zeros((k, n))
        for j in range(n):
            b[inside[:, j], j] = np.linalg.lstsq(x[:, inside[:, j]], y[:, j], rcond=None)[0]
        a, h, phi = np.eye(n), np.tile(np.log(np.var(y - x @ b, axis=0) + 1e-12), (t, 1)), np.full(n, told["phi"] / periods)
        rare, strength = 1 / (told["outlier_years"] * periods), told["outlier_strength"] * periods
        o, po = np.ones((t, n)), np.full(n, rare)
        variables = [*[(v, lag) for lag in range(1, lags + 1) for v in names], ("const", 0), *[(v, 0) for v in added]]
        kept = Kept()
        for it in range(draws + burn):
            if len(gaps):
                drawn = draw_states(rng, seen, whole, b, x[:, n * lags :] @ b[n * lags :], a, o * np.exp(h / 2), lags, levels, VAGUE * scale)
                whole = drawn.whole
                if drawn.level_error.max() > LEVEL_GATE:
                    raise RuntimeError(f"the smoother misses an observed value by {drawn.level_error.max():.1e}")
                z = np.diff(whole, axis=0) if levels else whole
                y, x = z[lags:], design_of(z)
            for j in range(n):
                # Equation j given the others: what is left of every equation that holds its residual.
                mine = inside[:, j]
                xj = x[:, mine]
                prec, lin = np.diag(1 / sd[mine, j] ** 2), np.zeros(xj.shape[1])
                e = y - x @ b
                e[:, j] = 0
                left = e @ a.T + np.outer(y[:, j], a[:, j])
                for i in range(j, n):
                    w = 1 / (o[:, i] ** 2 * np.exp(h[:, i]))
                    prec += a[i, j] ** 2 * (xj * w[:, None]).T @ xj
                    lin += a[i, j] * (xj.T @ (w * left[:, i]))
                low = np.linalg.cholesky(prec)
                centre = np.linalg.solve(low.T, np.linalg.solve(low, lin))
                for _ in range(REDRAWS):
                    b[mine, j] = centre + np.linalg.solve(low.T, rng.standard_normal(len(centre)))
                    top = np.zeros((n * lags, n * lags))
                    top[:n], top[n:, :-n] = b[: n * lags].T, np.eye(n * (lags - 1))
                    if np.abs(np.linalg.eigvals(top)).max() < 1:
                        break
                else:
                    raise RuntimeError(f"no stable draw of equation {names[j]} in {REDRAWS}")
            e = y - x @ b
            for i in range(1, n):
                w = 1 / (o[:, i] ** 2 * np.exp(h[:, i]))
                prec = (e[:, :i] * w[:, None]).T @ e[:, :i] + np.diag((scale[:i] / scale[i]) ** 2 / told["impact_var"])
                low = np.linalg.cholesky(prec)
                centre = np.linalg.solve(low.T, np.linalg.solve(low, -(e[:, :i] * w[:, None]).T @ e[:, i]))
                a[i, :i] = centre + np.linalg.solve(low.T, rng.standard_normal(i))
            u = e @ a.T
            for i in range(n):
                h[:, i] = log_volatility(rng, u[:, i] / o[:, i], h[:, i], phi[i], told["h0_var"])
                phi[i] = (told["phi"] / periods * told["phi_df"] + np.sum(np.diff(h[:, i]) ** 2)) / rng.chisquare(told["phi_df"] + 2 + t - 1)
                grid = np.concatenate(([1.0], OUTLIER_SCALES))
                chance = np.concatenate(([1 - po[i]], np.full(len(OUTLIER_SCALES), po[i] / len(OUTLIER_SCALES))))
                r = u[:, i] / np.exp(h[:, i] / 2)
                prob = chance / grid * np.exp(-0.5 * (r[:, None] / grid) ** 2)
                pick = (prob.cumsum(1) < rng.random(t)[:, None] * prob.sum(1, keepdims=True)).sum(1)
                o[:, i] = grid[np.minimum(pick, len(grid) - 1)]
                hits = int((o[:, i] > 1).sum())
                po[i] = rng.beta(strength * rare + hits, strength * (1 - rare) + t - hits)
            if it >= burn:
                kept.add("b", [(names[j], v, lag) for r, (v, lag) in enumerate(variables) for j in range(n) if inside[r, j]], b[inside])
                kept.add("a", [(names[i], names[j], 0) for i in range(n) for j in range(i)], a[np.tril_indices(n, -1)])
                for kind, v in (("h", h[-1]), ("phi", phi), ("outlier", po)):
                    kept.add(kind, [(x, x, 0) for x in names], v)
                if scales:
                    places = [(x, d, 0) for d in days[len(days) - t :] for x in names]
                    kept.add("scale", places, o * np.exp(h / 2))
                    kept.add("width", places, o)
                if len(gaps):
                    kept.add("missing", [(names[j], days[at], 0) for at, j in gaps], whole[gaps[:, 0], gaps[:, 1]])
                    # A draw's worst places: as many rows as series.
                    kept.add("projection", [(x, "level", 0) for x in names], drawn.level_error.max(axis=0))
                    kept.add("projection at", [(x, "level", 0) for x in names], drawn.level_error.argmax(axis=0))
                    if levels:
                        kept.add("adjustment", [(x, "change", 0) for x in names], drawn.change_error.max(axis=0))
        return kept.frame({c: frame[c].iat[0] for c in keys})

    def tried(frame: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        try:
            return chain(frame, extra)
        except (RuntimeError, np.linalg.LinAlgError) as error:
            if not failures:
                raise
            return pd.DataFrame({**{c: [frame[c].iat[0]] for c in keys}, "draw": [0], "kind": ["error"], "equation": [""], "variable": [str(error)], "lag": [0], "b": [0.0]})

    if regressors is None:
        return dealt(panel, keys).groupBy(*keys).applyInPandas(lambda frame: tried(frame, pd.DataFrame()), schema)
    return dealt(panel, keys).groupBy(*keys).cogroup(dealt(regressors, keys).groupBy(*keys)).applyInPandas(tried, schema)


def completed(panel: DataFrame, posterior: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, series, date, value: each draw's panel, of which what was missing is drawn."""
    drawn = posterior.filter("kind = 'missing'").select(*keys, "draw", F.col("equation").alias("series"), F.to_date("variable").alias("date"), F.col("b").alias("value"))
    draws = posterior.select(*keys, "draw").distinct()
    seen = panel.filter("value is not null").select(*keys, "series", "date", "value")
    return seen.join(draws, list(keys)).select(*keys, "draw", "series", "date", "value").unionByName(drawn)


def changes_of(levels: DataFrame, keys: Keys) -> DataFrame:
    """keys..., series, date, value: each level less the one before it."""
    before = F.lag("value").over(Window.partitionBy(*keys, "series").orderBy("date"))
    return levels.select(*keys, "series", "date", (F.col("value") - before).alias("value")).filter("value is not null")


def tail_of(panel: DataFrame, keys: Keys, n: int) -> DataFrame:
    """keys..., series, back (0 the last date), value of the last n dates."""
    w = Window.partitionBy(*keys, "series").orderBy(F.desc("date"))
    return panel.withColumn("back", F.row_number().over(w) - 1).filter(F.col("back") < n).select(*keys, "series", "back", "value")


def moving_average(b: np.ndarray, horizon: int) -> np.ndarray:
    """Responses of h periods' values to a shock of the first: [h, equation, shocked]."""
    n = b.shape[1]
    out = [np.eye(n)]
    for h in range(1, horizon):
        out.append(sum(b[k] @ out[h - 1 - k] for k in range(min(len(b), h))))
    return np.stack(out)


def conditioned(path: np.ndarray, b: np.ndarray, impacts: np.ndarray, steps: np.ndarray, series: np.ndarray, wanted: np.ndarray, levels: bool) -> np.ndarray:
    """``path`` (horizon, series) moved by the least standard shocks that make it meet the conditions, which it then does exactly.

    Given the path's own shocks this is a draw of the paths that meet them (Matheron's rule), so a path without conditions and
    one with them share all randomness. ``impacts`` are each period's effects of standard shocks; ``levels`` are sums of values.
    """
    horizon, n = path.shape
    psi = moving_average(b, horizon)
    effect = np.zeros((horizon, n, horizon, n))
    for t in range(horizon):
        for s in range(t + 1):
            effect[t, :, s] = psi[t - s] @ impacts[s]
    felt, held = (np.cumsum(effect, axis=0), np.cumsum(path, axis=0)) if levels else (effect, path)
    rows = felt[steps - 1, series].reshape(len(steps), -1)
    z = rows.T @ np.linalg.lstsq(rows @ rows.T, wanted - held[steps - 1, series], rcond=None)[0]
    return path + (effect.reshape(horizon * n, -1) @ z).reshape(horizon, n)


def simulate(posterior: DataFrame, tail: DataFrame, keys: Keys, horizon: int, seed: int, conditions: DataFrame | None = None, levels: bool = False, regressors: DataFrame | None = None, spreads: bool = False) -> DataFrame:
    """keys..., draw, h, series, value: a path of each draw from the last observed values.

    Each draw of each of ``keys`` is a group with a random stream of its own, so paths do not depend on how draws are dealt
    over tasks, and a baseline and a scenario of one seed and the same keys share their shocks. ``tail`` has keys..., series,
    back (0 the last), value, and draw if the draws have tails of their own. ``conditions`` (keys..., series, h, value, and
    draw if draws have their own; any periods and series, null is none) hold exactly; with ``levels`` they are for the sum of the
    values from h = 1 on. ``regressors`` (keys..., h, variable, x) are those of the fit; ValueError is raised if one lacks a period. With ``spreads`` the deviations that
    a draw's shocks had are rows of the series "spread of ..." as well, by which two runs can be told to be paired.
    """
    kinds = dict(posterior.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int, h int, series string, value double"])

    def paths(key, frame: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        if frame.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        start = last[last["role"] == "tail"].pivot(index="back", columns="series", values="value").sort_index()
        fixed = last[(last["role"] == "asked") & last["value"].notna()]
        coefficients = frame[frame["kind"] == "b"]
        names, b = matrices(coefficients)
        at = {x: i for i, x in enumerate(names)}
        mean = future_mean(coefficients, last[last["role"] == "regressor"], names, horizon)
        one = {kind: frame[frame["kind"] == kind].set_index("equation")["b"].reindex(names).to_numpy(float) for kind in ("h", "phi", "outlier")}
        a = np.eye(len(names))
        for e, v, x in frame[frame["kind"] == "a"][["equation", "variable", "b"]].itertuples(index=False):
            a[at[e], at[v]] = x
        rng = np.random.default_rng([seed, *"|".join(map(str, key[:-1])).encode(), int(key[-1])])
        past = [start[names].to_numpy(float)[k] for k in range(len(b))]
        h, path, impacts, deviations = one["h"].copy(), [], [], []
        for step in range(horizon):
            h = h + np.sqrt(one["phi"]) * rng.standard_normal(len(names))
            wide = np.where(rng.random(len(names)) < one["outlier"], rng.choice(OUTLIER_SCALES, len(names)), 1)
            deviations.append(wide * np.exp(h / 2))
            impacts.append(np.linalg.solve(a, np.diag(deviations[-1])))
            now = mean[step] + sum(b[k] @ past[k] for k in range(len(b))) + impacts[-1] @ rng.standard_normal(len(names))
            past = [now, *past[:-1]]
            path.append(now)
        path = np.stack(path)
        if len(fixed):
            path = conditioned(path, b, np.stack(impacts), -fixed["back"].to_numpy(int), fixed["series"].map(at).to_numpy(int), fixed["value"].to_numpy(float), levels)
        out = [(*key, step + 1, x, v) for step in range(horizon) for x, v in zip(names, path[step], strict=True)]
        if spreads:
            out += [(*key, step + 1, f"spread of {x}", v) for step in range(horizon) for x, v in zip(names, deviations[step], strict=True)]
        return pd.DataFrame(out, columns=[*keys, "draw", "h", "series", "value"])

    # The tail, the conditions and the regressors are a few rows of each of the keys.
    draws = posterior.filter("kind = 'phi'").select(*keys, "draw").distinct()

    def given(df: DataFrame, role: str) -> DataFrame:
        own = df if "draw" in df.columns else draws.join(df, list(keys))
        return own.select(*keys, F.col("draw").cast("int").alias("draw"), F.lit(role).alias("role"), "series", "back", "value")

    tails = given(tail, "tail")
    if conditions is not None:
        tails = tails.unionByName(given(conditions.withColumn("back", -F.col("h")), "asked"))
    if regressors is not None:
        tails = tails.unionByName(given(regressors.select(*keys, F.col("variable").alias("series"), (-F.col("h")).alias("back"), F.col("x").alias("value")), "regressor"))
    by = [*keys, "draw"]
    return dealt(posterior.filter("kind in ('b', 'a', 'h', 'phi', 'outlier')"), by).groupBy(*by).cogroup(dealt(tails, by).groupBy(*by)).applyInPandas(paths, schema)


def future_mean(coefficients: pd.DataFrame, given: pd.DataFrame, names: list[str], horizon: int) -> np.ndarray:
    """What constant and regressors (series the variable, back = -h, value) add to each equation in the periods ahead."""
    flat = coefficients[coefficients["lag"] == 0].pivot(index="variable", columns="equation", values="b").reindex(columns=names).fillna(0.0)
    x = np.ones((horizon, len(flat)))
    for i, v in enumerate(flat.index):
        if v != "const":
            mine = given[given["series"] == v].set_index("back")["value"].reindex([-h for h in range(1, horizon + 1)]).to_numpy(float)
            if np.isnan(mine).any():
                raise ValueError(f"regressor {v} lacks a period ahead")
            x[:, i] = mine
    return x @ flat.to_numpy(float)


def replicated(posterior: DataFrame, panel: DataFrame, keys: Keys, seed: int) -> DataFrame:
    """keys..., draw, date, series, value: a panel from each draw of gibbs() with ``scales``, that begins with the observed values
    and has each date's own scales."""
    kinds = dict(posterior.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int, date date, series string, value double"])

    def panels(key, frame: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        if frame.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        coefficients = frame[frame["kind"] == "b"]
        names, b = matrices(coefficients)
        const = coefficients[coefficients["variable"] == "const"].set_index("equation")["b"].reindex(names).to_numpy(float)
        scale = frame[frame["kind"] == "scale"].pivot(index="variable", columns="equation", values="b").sort_index()[names]
        a = np.eye(len(names))
        for e, v, x in frame[frame["kind"] == "a"][["equation", "variable", "b"]].itertuples(index=False):
            a[names.index(e), names.index(v)] = x
        rng = np.random.default_rng([seed, *"|".join(map(str, key[:-1])).encode(), int(key[-1])])
        start = seen.pivot(index="date", columns="series", values="value").sort_index()[names]
        start = start[start.index.astype(str) < scale.index[0]].to_numpy(float)[-len(b) :]
        past, out = list(start[::-1]), []
        for date, spread in zip(scale.index, scale.to_numpy(float), strict=True):
            now = const + sum(b[k] @ past[k] for k in range(len(b))) + np.linalg.solve(a, spread * rng.standard_normal(len(names)))
            past = [now, *past[:-1]]
            out += [(*key, pd.Timestamp(date).date(), x, v) for x, v in zip(names, now, strict=True)]
        return pd.DataFrame(out, columns=[*keys, "draw", "date", "series", "value"])

    seen = posterior.select(*keys, "draw").distinct().join(panel.select(*keys, "date", "series", "value"), list(keys))
    by = [*keys, "draw"]
    return dealt(posterior, by).groupBy(*by).cogroup(dealt(seen, by).groupBy(*by)).applyInPandas(panels, schema)


def replicated_statistics(replicas: DataFrame, panel: DataFrame, keys: Keys) -> DataFrame:
    """keys..., series, statistic, observed, mean, share: mean, spread and largest value of the panel's series against those of
    replicated() ones on the same dates, and the share of draws that are above the observed."""
    figures = lambda df, by: df.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("max")).unpivot(list(by), ["mean", "sd", "max"], "statistic", "x")
    dates = replicas.select(*keys, "series", "date").distinct()
    own = figures(panel.join(dates, [*keys, "series", "date"]), [*keys, "series"]).withColumnRenamed("x", "observed")
    both = figures(replicas, [*keys, "draw", "series"]).join(own, [*keys, "series", "statistic"])
    return both.groupBy(*keys, "series", "statistic").agg(F.first("observed").alias("observed"), F.avg("x").alias("mean"), F.avg((F.col("x") > F.col("observed")).cast("double")).alias("share"))


def recursive_impacts(posterior: DataFrame, keys: Keys) -> DataFrame:
    """keys..., draw, response, shock, value: the effect of one standard deviation of each shock, series in their order of name."""
    kinds = dict(posterior.dtypes)

    def effects(frame: pd.DataFrame) -> pd.DataFrame:
        names, first = impact_matrix(frame)
        i, j = (x.ravel() for x in np.indices(first.shape))
        return pd.DataFrame({**{k: frame[k].iat[0] for k in [*keys, "draw"]}, "response": np.array(names)[i], "shock": np.array(names)[j], "value": first.ravel()})

    return posterior.groupBy(*keys, "draw").applyInPandas(effects, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int, response string, shock string, value double"]))


def impact_matrix(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    h = frame[frame["kind"] == "h"].set_index("equation")["b"].sort_index()
    names = list(h.index)
    a = np.eye(len(names))
    for e, v, x in frame[frame["kind"] == "a"][["equation", "variable", "b"]].itertuples(index=False):
        a[names.index(e), names.index(v)] = x
    return names, np.linalg.solve(a, np.diag(np.exp(h.to_numpy(float) / 2)))


def sign_restricted_impacts(posterior: DataFrame, keys: Keys, signs: dict[tuple[str, str], int], tries: int, seed: int, horizons: int = 1) -> DataFrame:
    """keys..., draw, response, shock, value, tried: impacts rotated at random until responses up to ``horizons`` have the signs.

    ``signs`` gives +1 or -1 for (response, shock). A draw without an accepted rotation among ``tries`` has no rows, so what is
    returned tells the share of accepted draws; nothing is relaxed.
    """
    kinds = dict(posterior.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "draw int, response string, shock string, value double, tried int"])

    def rotated(frame: pd.DataFrame) -> pd.DataFrame:
        names, first = impact_matrix(frame)
        psi = moving_average(matrices(frame[frame["kind"] == "b"])[1], horizons)
        rng = np.random.default_rng([seed, *"|".join(str(frame[k].iat[0]) for k in keys).encode(), int(frame["draw"].iat[0])])
        for tried in range(1, tries + 1):
            q, up = np.linalg.qr(rng.standard_normal(first.shape))
            impact = first @ (q * np.where(np.diag(up) < 0, -1, 1))
            path = psi @ impact
            # A shock's sign is free: it is turned if that meets its own signs.
            for shock in {s for _, s in signs}:
                mine = [(names.index(r), sign) for (r, s), sign in signs.items() if s == shock]
                if all((path[:, r, names.index(shock)] * sign <= 0).all() for r, sign in mine):
                    path[:, :, names.index(shock)] *= -1
                    impact[:, names.index(shock)] *= -1
            if all((path[:, names.index(r), names.index(s)] * sign >= 0).all() for (r, s), sign in signs.items()):
                i, j = (x.ravel() for x in np.indices(impact.shape))
                return pd.DataFrame({**{k: frame[k].iat[0] for k in [*keys, "draw"]}, "response": np.array(names)[i], "shock": np.array(names)[j], "value": impact.ravel(), "tried": tried})
        return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return dealt(posterior, [*keys, "draw"]).groupBy(*keys, "draw").applyInPandas(rotated, schema)


def effective_size(draws: DataFrame, keys: Keys) -> DataFrame:
    """keys..., n, ess, mcse: n over the autocorrelation time, summed in pairs until a pair is negative."""

    def sizes(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("draw")["value"].to_numpy(float)
        n, c = len(x), x - x.mean()
        power = np.abs(np.fft.rfft(c, 2 * n)) ** 2
        acf = np.fft.irfft(power)[:n] / max(float(c @ c), 1e-300)
        tau = -1.0
        for k in range(0, n - 1, 2):
            pair = acf[k] + acf[k + 1]
            if pair < 0:
                break
            tau += 2 * pair
        ess = n / max(tau, 1.0)
        return pd.DataFrame({**{k: [frame[k].iat[0]] for k in keys}, "n": [n], "ess": [ess], "mcse": [x.std(ddof=1) / np.sqrt(ess) if n > 1 else 0.0]})

    kinds = dict(draws.dtypes)
    return draws.groupBy(*keys).applyInPandas(sizes, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n long, ess double, mcse double"]))
