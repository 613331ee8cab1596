"""Damped additive smoothing with a weekly season, fitted by likelihood on every series whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEASON, SHORTEST = 7, 14
#: Bounds of the weights of level, trend and season, and of the damping.
LEAST, MOST = np.array([1e-4, 0.0, 0.0, 0.8]), np.array([0.9999, 1.0, 1.0, 0.98])
#: Starts that are followed, and steps at most.
STARTS, STEPS = 4, 40


def states(y: np.ndarray, p: np.ndarray, season: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(errors of each value, last (level, trend, seasonal), one-step predictions of the first) for parameter rows ``p``.

    Level and season begin with the first week's mean and its deviations, the trend with zero;
    a value that is not known has no error and leaves the state to its prediction.
    """
    alpha, beta, gamma, phi = p.T
    first = y[: max(1, season)]
    start = float(np.nanmean(first)) if not np.isnan(first).all() else float(np.nanmean(y))
    level, trend = np.full(len(p), start), np.zeros(len(p))
    seasonal = [np.full(len(p), d) for d in np.nan_to_num(first - start)] if season else [0.0]
    errors, shown = np.zeros((len(y), len(p))), np.empty(len(y))
    for t, value in enumerate(y.tolist()):
        s = seasonal[t % len(seasonal)]
        damped = phi * trend
        ahead = level + damped
        shown[t] = (ahead + s)[0]
        if value != value:
            level, trend = ahead, damped
            continue
        error = value - s - ahead
        errors[t] = error
        before, level = level, ahead + alpha * error
        trend = damped + beta * (level - before - damped)
        if season:
            seasonal[t % season] = s + gamma * (value - level - s)
    return errors, (level, trend, np.array(seasonal)), shown


def starts(season: int) -> np.ndarray:
    grid = np.array(np.meshgrid((0.1, 0.2, 0.4, 0.6, 0.8), (0.0, 0.05, 0.2), (0.05, 0.2) if season else (0.0,), (0.9, 0.98))).reshape(4, -1).T
    return grid


def fit(y: np.ndarray) -> tuple[np.ndarray, float]:
    """(parameters, sum of squares): the mode of the Gaussian likelihood, which is the least sum of squares.

    Damped least-squares steps (Levenberg and Marquardt) within the bounds, from the best
    points of a grid and all in step. A step counts only if it lowers the sum, so the result is never worse than the grid.
    """
    season = SEASON if len(y) >= SHORTEST else 0
    grid = starts(season)
    sums = lambda p: np.square(states(y, p, season)[0]).sum(axis=0)
    loss = sums(grid)
    order = np.argsort(loss, kind="stable")[:STARTS]
    at, best = grid[order], loss[order]
    free = np.array([0, 1, 2, 3] if season else [0, 1, 3])
    damping, still = np.full(len(at), 1e-2), np.zeros(len(at), int)
    for _ in range(STEPS):
        nudge = np.where(at[:, free] + 1e-5 > MOST[free], -1e-5, 1e-5)
        near = np.repeat(at[:, None, :], len(free) + 1, axis=1)
        for j, k in enumerate(free):
            near[:, j + 1, k] += nudge[:, j]
        errors = states(y, near.reshape(-1, 4), season)[0].reshape(len(y), len(at), -1)
        tried = at.copy()
        for i in range(len(at)):
            slope = (errors[:, i, 1:] - errors[:, i, :1]) / nudge[i]
            gram, pull = slope.T @ slope, slope.T @ errors[:, i, 0]
            # a parameter at its bound that would leave it stays there
            open_ = ~(((at[i, free] <= LEAST[free]) & (pull > 0)) | ((at[i, free] >= MOST[free]) & (pull < 0)))
            some = free[open_]
            if len(some):
                g = gram[np.ix_(open_, open_)]
                tried[i, some] -= np.linalg.lstsq(g + damping[i] * np.diag(np.diag(g) + 1e-12), pull[open_], rcond=None)[0]
        tried = np.clip(tried, LEAST, MOST)
        found = sums(tried)
        better = found < best
        still = np.where(better & (best - found > 1e-10 * (best + 1e-12)), 0, still + 1)
        at, best = np.where(better[:, None], tried, at), np.where(better, found, best)
        damping = np.where(better, damping / 5, damping * 8)
        if (still >= 6).all():
            break
    return at[np.argmin(best)], float(best.min())


def forecast(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(fitted values, forecasts, sigma); sigma is 1 where the fit leaves nothing."""
    season = SEASON if len(y) >= SHORTEST else 0
    p, loss = fit(y)
    _, (level, trend, seasonal), shown = states(y, p[None], season)
    steps = np.cumsum(p[3] ** np.arange(1, horizon + 1))
    ahead = [seasonal[(len(y) + h) % season, 0] if season else 0.0 for h in range(horizon)]
    sigma = float(np.sqrt(loss / max(1, (~np.isnan(y)).sum())))
    return shown, level[0] + steps * trend[0] + np.array(ahead), sigma if sigma > 1e-4 else 1.0


def smoothing_models(rows: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """(series, n, alpha, beta, gamma, phi, level, trend, season, sigma) of each series, fitted from its first day to its last.

    ``season`` holds the weekly effects from the day behind the last on, and is empty for a
    series under two weeks. Several rows of a day are its mean; days that are missing, and null
    values, leave the state to its prediction; rows without a day are left out, and so is a
    series without values. A series' days are one group in one task.
    """
    kind = dict(rows.dtypes)[series]
    names = ["n", "alpha", "beta", "gamma", "phi", "level", "trend", "season", "sigma"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame.dropna(subset=["y"])
        if known.empty:
            return frame.iloc[:0].reindex(columns=[series, *names]).astype(object)
        days = known["ds"].to_numpy().astype("datetime64[D]").astype(np.int64)
        y = np.full(days.max() - days.min() + 1, np.nan)
        y[days - days.min()] = known["y"].to_numpy(float)
        season = SEASON if len(y) >= SHORTEST else 0
        p, loss = fit(y)
        _, (level, trend, seasonal), _ = states(y, p[None], season)
        weekly = [float(seasonal[(len(y) + h) % season, 0]) for h in range(season)]
        found = [len(known), *map(float, p), float(level[0]), float(trend[0]), weekly, float(np.sqrt(loss / len(known)))]
        return pd.DataFrame([[frame[series].iloc[0], *found]], columns=[series, *names])

    schema = f"`{series}` {kind}, n long, alpha double, beta double, gamma double, phi double, level double, trend double, season array<double>, sigma double"
    one = rows.filter(F.col(day).isNotNull()).groupBy(series, F.col(day).cast("date").alias("ds")).agg(F.avg(F.col(value).cast("double")).alias("y"))
    return one.groupBy(series).applyInPandas(run, schema)
