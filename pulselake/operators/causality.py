"""Granger tests over several lags and stationarity, per series, from published definitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Response-surface coefficients of the Dickey-Fuller p-value with a constant (fixed values):
#: below and above the switch point, and where the surface ends.
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
SWITCH, LOWEST, HIGHEST = -1.61, -18.83, 2.74


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_tail(f: float, n: int, d: int) -> float:
    """P(F > f) with n and d degrees of freedom."""
    return beta_tail(d / 2, n / 2, d / (d + n * f)) if f > 0 else 1.0


def _residual(x: np.ndarray, y: np.ndarray) -> float:
    weights, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(np.square(y - x @ weights).sum())


def granger(cause: np.ndarray, effect: np.ndarray, max_lag: int) -> tuple[int, float, float]:
    """(lag, F, p) of the lag with the least p-value, the first on ties; (1, 0, 1) without variance."""
    if len(effect) < 4 or cause.std() == 0 or effect.std() == 0:
        return 1, 0.0, 1.0
    best = (1, 0.0, 1.0)
    for lag in range(1, min(max_lag, max(1, (len(effect) - 2) // 3)) + 1):
        y, t = effect[lag:], len(effect) - lag
        own = np.column_stack([np.ones(t)] + [effect[lag - k : -k] for k in range(1, lag + 1)])
        both = np.column_stack([own] + [cause[lag - k : -k] for k in range(1, lag + 1)])
        left = t - 2 * lag - 1
        less, full = _residual(own, y), _residual(both, y)
        if left <= 0 or full <= 0:
            continue
        f = max(0.0, (less - full) / lag) / (full / left)
        p = f_tail(f, lag, left)
        if p < best[2]:
            best = (lag, f, p)
    return best


def granger_audit(rows: DataFrame, pairs: list[tuple[str, str]], series: str, order: str, max_lag: int = 2, level: float = 0.05) -> DataFrame:
    """One row per series and (cause, effect): lag, F, p, significance and a sentence. Absent columns are skipped."""
    there = [(c, e) for c, e in pairs if c in rows.columns and e in rows.columns]
    columns = sorted({c for p in there for c in p})
    kind = dict(rows.dtypes)[series]

    def audit(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)[columns].astype(float).ffill().bfill()
        out = []
        for cause, effect in there:
            lag, f, p = granger(values[cause].to_numpy(), values[effect].to_numpy(), max_lag)
            found = p < level
            text = f"past {cause} precedes {effect} by {lag} (F={f:.2f}, p={p:.3f})" if found else f"no causality from {cause} to {effect} (min p={p:.3f})"
            out.append((frame[series].iloc[0], cause, effect, lag, f, p, found, text))
        return pd.DataFrame(out, columns=[series, "cause", "effect", "lag", "f_stat", "p_value", "significant", "interpretation"])

    schema = f"{series} {kind}, cause string, effect string, lag int, f_stat double, p_value double, significant boolean, interpretation string"
    return rows.select(series, order, *columns).groupBy(series).applyInPandas(audit, schema)


def adf_p(y: np.ndarray) -> float:
    """p-value of the augmented Dickey-Fuller test with a constant, lags by AIC; 0 for short or constant series."""
    y = y[~np.isnan(y)]
    if len(y) < 8 or (y == y[0]).all():
        return 0.0
    most = min(int(math.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
    step, best = np.diff(y), None

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        d = step[skip:]
        return d, np.column_stack([y[skip:-1]] + [step[skip - k : len(step) - k] for k in range(1, lags + 1)] + [np.ones(len(d))])

    for lags in range(most + 1):
        d, x = design(lags, most)
        ssr = max(_residual(x, d), 1e-300)
        aic = len(d) * math.log(ssr / len(d)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    d, x = design(best[1], best[1])
    weights, *_ = np.linalg.lstsq(x, d, rcond=None)
    spread = np.square(d - x @ weights).sum() / max(1, len(d) - x.shape[1])
    tau = weights[0] / math.sqrt(max(spread * np.linalg.pinv(x.T @ x)[0, 0], 1e-300))
    if tau > HIGHEST:
        return 1.0
    if tau < LOWEST:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(SMALL_P if tau <= SWITCH else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def stationarity(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, p_value, stationary) per series."""
    kind = dict(rows.dtypes)[series]

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        p = adf_p(frame.sort_values("o")["y"].to_numpy(float))
        return pd.DataFrame({series: [frame[series].iloc[0]], "p_value": [p], "stationary": [p < 0.05]})

    return rows.select(series, F.col(order).alias("o"), F.col(value).cast("double").alias("y")).groupBy(series).applyInPandas(test, f"{series} {kind}, p_value double, stationary boolean")
