"""A structural trend: growth with sparse changepoints, weekly waves and regressors, fitted by a proximal Newton method.

The curve is a link of a continuous piecewise-linear function (logistic between floor and cap,
linear, or flat), plus waves and regressors. Changes of slope have a Laplace prior, so most
are exactly zero; the rest has normal priors. Each series is fitted on its own, in one Arrow
group of its days.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Places where the slope may change, spread over the first share of the history.
CHANGEPOINTS, CHANGE_RANGE = 25, 0.8
#: Scales of the priors: slope changes (Laplace); slope and offset, waves and regressors (normal).
CHANGE_SCALE, GROWTH_SCALE, WAVE_SCALE = 0.05, 5.0, 10.0
WEEKLY_ORDER, SHORTEST_WEEKLY = 3, 14
#: The interval's share, and how many futures it is read from.
WIDTH, FUTURES = 0.8, 1000


@dataclass
class Problem:
    """Design of one series: ``growth`` columns are the offset, the slope and the slope changes; ``extra`` waves and regressors."""

    growth: np.ndarray
    extra: np.ndarray
    cap: float
    logistic: bool

    def curve(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trend, its derivative by the linear function) for the growth weights."""
        z = self.growth @ w[: self.growth.shape[1]]
        if not self.logistic:
            return z, np.ones_like(z)
        share = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return self.cap * share, self.cap * share * (1 - share)

    def fitted(self, w: np.ndarray) -> np.ndarray:
        return self.curve(w)[0] + self.extra @ w[self.growth.shape[1] :]

    def jacobian(self, w: np.ndarray) -> np.ndarray:
        return np.column_stack((self.growth * self.curve(w)[1][:, None], self.extra))


def penalties(problem: Problem) -> tuple[np.ndarray, np.ndarray]:
    """(normal precisions, Laplace rates) of all weights."""
    g, e = problem.growth.shape[1], problem.extra.shape[1]
    normal, laplace = np.zeros(g + e), np.zeros(g + e)
    normal[: min(g, 2)] = 1 / GROWTH_SCALE**2
    laplace[2:g] = 1 / CHANGE_SCALE
    normal[g:] = 1 / WAVE_SCALE**2
    return normal, laplace


def objective(problem: Problem, y: np.ndarray, w: np.ndarray, sigma: float) -> float:
    normal, laplace = penalties(problem)
    return float(np.square(y - problem.fitted(w)).sum() / (2 * sigma**2) + normal @ w**2 / 2 + laplace @ np.abs(w))


def _descend(gram: np.ndarray, slope: np.ndarray, w: np.ndarray, laplace: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Minimises slope.(v - w) + (v - w).gram.(v - w) / 2 + laplace.|v| by coordinate descent."""
    v, pull = w.copy(), slope.copy()
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(v)):
            h = gram[j, j]
            aim = v[j] - pull[j] / h
            new = np.sign(aim) * max(0.0, abs(aim) - laplace[j] / h)
            if new != v[j]:
                pull += gram[:, j] * (new - v[j])
                largest = max(largest, abs(new - v[j]) * np.sqrt(h))
                v[j] = new
        if largest < 1e-9:
            break
    return v


def fit(problem: Problem, y: np.ndarray, start: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """(weights, sigma) at a mode of the posterior, sigma and weights in turn."""
    normal, laplace = penalties(problem)
    w = start.copy()
    sigma = max(float(np.std(y - problem.fitted(w))), 1e-3)
    for _ in range(steps):
        before = objective(problem, y, w, sigma)
        jac = problem.jacobian(w)
        slope = -jac.T @ (y - problem.fitted(w)) / sigma**2 + normal * w
        gram = jac.T @ jac / sigma**2 + np.diag(normal + 1e-8)
        aim, length = _descend(gram, slope, w, laplace), 1.0
        while length > 1e-6 and objective(problem, y, w + length * (aim - w), sigma) > before:
            length /= 2
        moved = w + length * (aim - w) if length > 1e-6 else w
        gain = before - objective(problem, y, moved, sigma)
        w = moved
        last, sigma = sigma, max(float(np.sqrt(np.mean(np.square(y - problem.fitted(w))))), 1e-3)
        if gain < 1e-9 * (1 + abs(before)) and abs(sigma - last) < 1e-7:
            break
    return w, sigma


def changepoints(n: int) -> np.ndarray:
    """Places (shares of the history) where the slope may change."""
    most = min(CHANGEPOINTS, max(0, int(n * CHANGE_RANGE) - 1))
    return np.linspace(0, CHANGE_RANGE, most + 1)[1:]


def design(t: np.ndarray, weekday: np.ndarray | None, places: np.ndarray, regressors: np.ndarray, cap: float, growth: str) -> Problem:
    columns = [np.ones_like(t)] + ([] if growth == "flat" else [t, *[np.maximum(0, t - s) for s in places]])
    waves = [] if weekday is None else [f(2 * np.pi * k * weekday / 7) for k in range(1, WEEKLY_ORDER + 1) for f in (np.sin, np.cos)]
    extra = np.column_stack([*waves, *regressors.T]) if waves or regressors.size else np.zeros((len(t), 0))
    return Problem(np.column_stack(columns), extra, cap, growth == "logistic")


def futures(problem: Problem, w: np.ndarray, sigma: float, t: np.ndarray, places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of simulated curves: behind the history slopes change as often, and by as much, as they did."""
    rng = np.random.default_rng(seed)
    g = problem.growth.shape[1]
    z = np.tile(problem.growth @ w[:g], (FUTURES, 1))
    mean_change = float(np.abs(w[2:g]).mean()) if g > 2 else 0.0
    ahead = float(t.max()) - 1
    if mean_change > 0 and ahead > 0:
        counts = rng.poisson(places * ahead, FUTURES)
        for k in np.flatnonzero(counts):
            at = 1 + rng.uniform(0, ahead, counts[k])
            z[k] += np.maximum(0, t[:, None] - at[None, :]) @ rng.laplace(0, mean_change, counts[k])
    trend = problem.cap / (1 + np.exp(-np.clip(z, -40, 40))) if problem.logistic else z
    drawn = trend + problem.extra @ w[g:] + rng.normal(0, sigma, z.shape)
    return np.quantile(drawn, (1 - WIDTH) / 2, axis=0), np.quantile(drawn, (1 + WIDTH) / 2, axis=0)


def structural_fit(days: np.ndarray, y: np.ndarray, horizon: int, low: float, high: float, growth: str = "logistic", regressors: np.ndarray | None = None, seed: int = 0) -> pd.DataFrame:
    """One series: ``days`` whole numbers ascending, ``y`` with NaN where unknown (masked or to come), ``horizon`` days behind the last.

    Columns day, yhat, yhat_lower, yhat_upper, trend, change (of the slope at that day, a year of history
    as the unit), all within ``low`` and ``high``; regressors are standardised over the history,
    and zero (before that) on days that are added.
    """
    extra = np.zeros((len(days), 0)) if regressors is None else np.asarray(regressors, float)
    future = days[-1] + np.arange(1, horizon + 1)
    all_days, known = np.concatenate((days, future)), np.flatnonzero(~np.isnan(y))
    extra = np.vstack((extra, np.zeros((horizon, extra.shape[1]))))
    spread = extra[known].std(axis=0)
    extra = (extra - extra[known].mean(axis=0)) / np.where(spread > 0, spread, 1)
    first, span = days[known[0]], max(1, days[known[-1]] - days[known[0]])
    t = (all_days - first) / span
    seen = np.clip(y[known], low + 0.1, high - 0.1) if high - low > 0.3 else y[known]
    scale = max(float(np.abs(seen - low).max()), 1e-9) if growth == "logistic" else max(float(np.abs(seen).max()), 1e-9)
    base = low if growth == "logistic" else 0.0
    places = changepoints(len(known)) if growth != "flat" else np.zeros(0)
    whole = design(t, all_days if len(known) >= SHORTEST_WEEKLY else None, places, extra, (high - base) / scale, growth)
    part = Problem(whole.growth[known], whole.extra[known], whole.cap, whole.logistic)
    aim = (seen - base) / scale
    linear = np.log(np.clip(aim / whole.cap, 0.01, 0.99) / (1 - np.clip(aim / whole.cap, 0.01, 0.99))) if whole.logistic else aim
    start = np.zeros(whole.growth.shape[1] + whole.extra.shape[1])
    start[: min(2, whole.growth.shape[1])] = np.linalg.lstsq(part.growth[:, :2], linear, rcond=None)[0]
    w, sigma = fit(part, aim, start)
    lower, upper = futures(whole, w, sigma, t, len(places), seed)
    change = np.zeros(len(all_days))
    for place, weight in zip(places, w[2 : 2 + len(places)]):
        change[np.argmin(np.abs(t - place))] += weight
    out = {"day": all_days, "yhat": whole.fitted(w), "yhat_lower": lower, "yhat_upper": upper, "trend": whole.curve(w)[0]}
    out = {k: v if k == "day" else np.clip(base + scale * v, low, high) for k, v in out.items()}
    return pd.DataFrame(out | {"change": change})


def default_bounds(y: np.ndarray) -> tuple[float, float]:
    """Floor and cap of a series by the generic rule."""
    least, most = float(np.nanmin(y)), float(np.nanmax(y))
    low = min(max(0.0, 0.8 * least), max(0.0, least - 0.5)) if least >= 0 else 1.2 * least
    return low, max(1.25 * most, low + 5)


def structural_forecast(rows: DataFrame, series: str, day: str, value: str, horizon: int, growth: str = "logistic", regressors: tuple[str, ...] = (), bounds: tuple[float, float] | None = None) -> DataFrame:
    """(series, ds, yhat, yhat_lower, yhat_upper, trend, change, is_forecast): history and ``horizon`` days behind each series' last day.

    Null values are masked days: they are predicted, not fitted. Regressors are filled forward,
    then backward. Several rows of a day are its mean; rows without a day are left out; a
    series without values is left out, and one with a single value repeats it. A series' days
    are one group in one task.
    """
    kind = dict(rows.dtypes)[series]
    names = ["ds", "yhat", "yhat_lower", "yhat_upper", "trend", "change", "is_forecast"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[series].iloc[0]
        frame = frame.sort_values("ds")
        y = frame["y"].to_numpy(float)
        if np.isnan(y).all():
            return frame.iloc[:0].reindex(columns=[series, *names]).astype(object)
        days = frame["ds"].to_numpy().astype("datetime64[D]").astype(np.int64)
        low, high = bounds or default_bounds(y)
        if (~np.isnan(y)).sum() == 1:
            all_days = np.concatenate((days, days[-1] + np.arange(1, horizon + 1)))
            flat = np.full(len(all_days), np.clip(np.nanmean(y), low, high))
            found = pd.DataFrame({"day": all_days, "yhat": flat, "yhat_lower": flat, "yhat_upper": flat, "trend": flat, "change": 0.0})
        else:
            extra = frame[[f"r{k}" for k in range(len(regressors))]].astype(float).ffill().bfill().fillna(0).to_numpy()
            found = structural_fit(days, y, horizon, low, high, growth, extra, zlib.crc32(str(key).encode()))
        found["ds"] = [d.astype(object) for d in found["day"].to_numpy().astype("datetime64[D]")]
        found["is_forecast"] = np.arange(len(found)) >= len(days)
        found[series] = key
        return found[[series, *names]]

    schema = f"`{series}` {kind}, ds date, yhat double, yhat_lower double, yhat_upper double, trend double, change double, is_forecast boolean"
    one = rows.filter(F.col(day).isNotNull()).groupBy(series, F.col(day).cast("date").alias("ds")).agg(F.avg(F.col(value).cast("double")).alias("y"), *[F.avg(F.col(r).cast("double")).alias(f"r{k}") for k, r in enumerate(regressors)])
    return one.groupBy(series).applyInPandas(run, schema)
