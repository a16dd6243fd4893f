"""Missing values of one model's panel, drawn by a state-space simulation smoother.

The state is the companion form of the autoregression and, where levels are observed, the last level. A filter runs forward over
what is observed of a simulated panel's distance from the data, a smoother back and forward again; the sum of its path and of the
simulated one is a draw of all that is missing, at the start, inside and at a ragged end alike. Each date keeps its gain and its
innovation alone, so memory is linear in dates and does not depend on how many values are missing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Standard deviations of a missing value of the first dates, in those of the series' changes.
VAGUE = 100.0


class Drawn(NamedTuple):
    whole: np.ndarray  # the panel, of which what was observed is as it was
    level_error: np.ndarray  # [date, series], relative: how far the smoother's own values are from observed ones
    change_error: np.ndarray  # how far the changes moved when observed values were put back


def companion(b: np.ndarray, n: int, lags: int, levels: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition of the state [values, lagged values..., level] and the loading of a date's shocks on it."""
    m = n * lags + n * levels
    move, load = np.zeros((m, m)), np.zeros((m, n))
    move[:n, : n * lags] = b[: n * lags].T
    move[n : n * lags, : n * (lags - 1)] = np.eye(n * (lags - 1))
    load[:n] = np.eye(n)
    if levels:
        move[n * lags :, : n * lags] = move[:n, : n * lags]
        move[n * lags :, n * lags :] = load[n * lags :] = np.eye(n)
    return move, load


def first_state(n: int, lags: int, levels: bool) -> np.ndarray:
    """The state before the first outcome as a linear map of the first lags (and one more, for levels) dates of the panel."""
    q = lags + levels
    out = np.zeros((n * lags + n * levels, q * n))
    for k in range(lags):
        at, row = slice(k * n, (k + 1) * n), q - 1 - k
        out[at, row * n : (row + 1) * n] = np.eye(n)
        if levels:
            out[at, (row - 1) * n : row * n] = -np.eye(n)
    if levels:
        out[n * lags :, (q - 1) * n :] = np.eye(n)
    return out


def draw_states(rng: np.random.Generator, seen: np.ndarray, guess: np.ndarray, b: np.ndarray, mean: np.ndarray, a: np.ndarray, spread: np.ndarray, lags: int, levels: bool, vague: np.ndarray) -> Drawn:
    """A draw of ``seen`` (dates, series), whose missing values are NaN, given the model.

    ``mean`` (outcomes, series) is what constant and regressors add, ``spread`` the shocks' standard deviations, ``a`` the matrix that
    turns residuals into shocks. Missing values of the first dates have ``guess`` as their mean and ``vague`` as their deviation.
    """
    n, q = seen.shape[1], lags + levels
    move, load = companion(b, n, lags, levels)
    inverse = np.linalg.inv(a)
    known = ~np.isnan(seen)
    base = n * lags if levels else 0
    outcomes = len(mean)

    start = first_state(n, lags, levels)
    free = (~known[:q]).ravel() * np.tile(vague, q)
    expected = start @ np.where(known[:q], seen[:q], guess[:q]).ravel()
    p_first = (start * free**2) @ start.T
    # A panel of the same model without means, and what is observed of the data less of it.
    fake = start @ (free * rng.standard_normal(q * n))
    shocks = (rng.standard_normal((outcomes, n)) * spread) @ inverse.T
    fakes = np.empty((outcomes + 1, len(fake)))
    fakes[0] = fake
    for t in range(outcomes):
        fakes[t + 1] = move @ fakes[t] + load @ shocks[t]

    state, p = expected, p_first
    kept = []
    for t in range(outcomes):
        state = move @ state + load @ mean[t]
        cov = (inverse * spread[t] ** 2) @ inverse.T
        p = move @ p @ move.T + load @ cov @ load.T
        at = base + np.flatnonzero(known[q + t])
        gain = told = None
        if len(at):
            left = seen[q + t, at - base] - fakes[t + 1, at] - state[at]
            cross = p[at]
            both = np.linalg.solve(cross[:, at], np.column_stack([cross, left]))
            gain, told = both[:, :-1].T, both[:, -1]
            state = state + gain @ left
            p = p - gain @ cross
            p = (p + p.T) / 2
        kept.append((at, gain, told, cov))
    r = np.zeros(len(state))
    moved = np.empty((outcomes, n))
    for t in range(outcomes - 1, -1, -1):
        at, gain, told, cov = kept[t]
        if len(at):
            pull = told - gain.T @ r
            r = r.copy()
            r[at] += pull
        moved[t] = cov @ (load.T @ r)
        r = move.T @ r
    state = expected + p_first @ r
    whole = np.empty_like(seen)
    # The first dates from the first state: levels are the last one less the changes after it.
    begin = state + fakes[0]
    if levels:
        whole[q - 1] = begin[base:]
        for k in range(lags):
            whole[q - 2 - k] = whole[q - 1 - k] - begin[k * n : (k + 1) * n]
    else:
        whole[:q] = begin.reshape(lags, n)[::-1]
    for t in range(outcomes):
        state = move @ state + load @ (mean[t] + moved[t])
        whole[q + t] = (state + fakes[t + 1])[base : base + n]
    error = np.where(known, np.abs(whole - np.where(known, seen, 0)) / np.maximum(1, np.abs(np.where(known, seen, 0))), 0)
    exact = np.where(known, seen, whole)
    change = np.abs(np.diff(exact, axis=0) - np.diff(whole, axis=0)) if levels else np.zeros((0, n))
    return Drawn(exact, error, change)
