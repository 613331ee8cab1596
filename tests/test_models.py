"""The fitted models: structural trend and damped smoothing; quantiles of odd groups."""

import datetime as dt

import numpy as np
import pytest

from pulselake.operators import forecast, smoothing, structural as S
from pulselake.operators.quantiles import with_quantiles


def weekly(n):
    return 2 * np.sin(2 * np.pi * np.arange(n) / 7)


def test_planted_changepoint_is_found_and_few_others():
    rng, t = np.random.default_rng(1), np.arange(300)
    y = np.where(t < 150, 20 + 0.1 * t, 35 - 0.1 * (t - 150)) + weekly(300) + rng.normal(0, 0.3, 300)
    found = S.structural_fit(t, y, 14, 0, 100, "linear")
    change = found["change"].to_numpy()
    main = np.flatnonzero(np.abs(change) > 0.2)
    assert (change != 0).sum() <= 8 and len(main) and (np.abs(found["day"].to_numpy()[main] - 150) <= 15).all()
    assert change.sum() < -0.5 and np.abs(found["yhat"][:300] - y).mean() < 0.5


def test_fit_is_a_mode_of_the_posterior():
    rng, t = np.random.default_rng(2), np.arange(120)
    y = 1 / (1 + np.exp(-(t - 60) / 15)) + rng.normal(0, 0.03, 120)
    problem = S.design(t / 119, t, S.changepoints(120), rng.normal(size=(120, 1)), 1.2, "logistic")
    start = np.zeros(problem.growth.shape[1] + problem.extra.shape[1])
    w, sigma = S.fit(problem, y, start, steps=200)
    best = S.objective(problem, y, w, sigma)
    normal, laplace = S.penalties(problem)
    slope = -problem.jacobian(w).T @ (y - problem.fitted(w)) / sigma**2 + normal * w
    zero = (w == 0) & (laplace > 0)
    scale = 1 + np.abs(problem.jacobian(w)).sum(axis=0) / sigma**2 * 0.03
    assert zero.sum() > 10 and (np.abs(slope[zero]) <= laplace[zero] + 1e-3 * scale[zero]).all()
    assert (np.abs(slope + laplace * np.sign(w))[~zero] <= 1e-3 * scale[~zero]).all()
    for _ in range(300):
        assert S.objective(problem, y, w + rng.normal(0, 1e-3, len(w)), sigma) >= best - 1e-6


@pytest.mark.parametrize("growth", ["logistic", "linear", "flat"])
def test_forecast_keeps_its_bounds_and_order(growth):
    rng = np.random.default_rng(3)
    y = 60 + np.cumsum(rng.normal(0.3, 1, 90))
    found = S.structural_fit(np.arange(90), y, 60, 55, float(y.max()) + 2, growth)
    values = found[["yhat_lower", "yhat", "yhat_upper"]].to_numpy()
    assert (values >= 55).all() and (values <= y.max() + 2).all()
    assert (values[:, 0] <= values[:, 1] + 0.5).all() and (values[:, 1] <= values[:, 2] + 0.5).all()
    if growth == "flat":
        assert np.ptp(found["trend"]) < 1e-9 and (found["change"] == 0).all()
    assert S.structural_fit(np.arange(90), y, 60, 55, float(y.max()) + 2, growth).equals(found)


def test_holdout_error_is_below_the_last_value():
    rng, t = np.random.default_rng(4), np.arange(200)
    y = 100 + 40 / (1 + np.exp(-(t - 80) / 30)) + 6 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 200)
    ahead = S.structural_fit(t[:-14], y[:-14], 14, 50, 200)["yhat"].to_numpy()[-14:]
    assert np.abs(ahead - y[-14:]).mean() < 0.5 * np.abs(y[-15] - y[-14:]).mean()


def test_regressors_explain_and_masked_days_are_predicted():
    rng, t = np.random.default_rng(5), np.arange(150)
    x = rng.normal(0, 1, 150)
    y = 50 + 5 * x + rng.normal(0, 0.2, 150)
    y[70:75] = np.nan
    found = S.structural_fit(t, y, 3, 0, 100, "linear", x[:, None])
    want = 50 + 5 * x
    assert np.abs(found["yhat"][:150] - want).max() < 1


def test_structural_series_of_any_kind(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("a", day(k), 50.0 + k % 7, k % 3) for k in range(40)] + [("a", day(3), 70.0, None), ("a", None, 1.0, 1)]
    rows += [("one", day(0), 5.0, 1), ("none", day(0), None, 1), (None, day(0), 1.0, 1), (None, day(1), 2.0, 1), ("flat", day(0), 3.0, 1), ("flat", day(9), 3.0, 1)]
    frame = spark.createDataFrame(rows, "s string, d date, v double, r int")
    found = S.structural_forecast(frame, "s", "d", "v", 5, regressors=("r",)).collect()
    count = lambda s: (sum(r.s == s for r in found), sum(r.s == s and r.is_forecast for r in found))
    assert (count("a"), count("one"), count("none"), count(None), count("flat")) == ((45, 5), (6, 5), (0, 0), (7, 5), (7, 5))
    assert all(np.isfinite([r.yhat, r.yhat_lower, r.yhat_upper]).all() for r in found)
    assert all(abs(r.yhat - 3) < 0.5 for r in found if r.s == "flat")
    assert S.structural_forecast(frame.limit(0), "s", "d", "v", 5).collect() == []


def simulated(n, alpha, beta, gamma, phi, seed):
    rng = np.random.default_rng(seed)
    level, trend, season, out = 100.0, 0.0, list(rng.normal(0, 3, 7)), []
    for k in range(n):
        value = level + phi * trend + season[k % 7] + rng.normal()
        before = level
        level = alpha * (value - season[k % 7]) + (1 - alpha) * (level + phi * trend)
        trend = beta * (level - before) + (1 - beta) * phi * trend
        season[k % 7] = gamma * (value - level) + (1 - gamma) * season[k % 7]
        out.append(value)
    return np.array(out)


def plain_loss(y, alpha, beta, gamma, phi):
    season = 7 if len(y) >= 14 else 0
    level, trend = float(np.mean(y[: max(1, season)])), 0.0
    seasonal, loss = [v - level for v in y[:season]] or [0.0], 0.0
    for t, value in enumerate(y):
        s = seasonal[t % len(seasonal)]
        loss += (value - (level + phi * trend + s)) ** 2
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + phi * trend)
        trend = beta * (level - before) + (1 - beta) * phi * trend
        if season:
            seasonal[t % season] = gamma * (value - level) + (1 - gamma) * s
    return loss


def test_smoothing_recovers_what_made_a_series():
    y = simulated(3000, 0.3, 0.05, 0.1, 0.95, 6)
    p, loss = smoothing.fit(y)
    assert np.abs(p - [0.3, 0.05, 0.1, 0.95]).max() < 0.06 and abs(loss / len(y) - 1) < 0.1
    assert abs(plain_loss(y, *p) - loss) < 1e-6 * loss


def test_smoothing_is_never_worse_than_the_grid():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 13, 14, 30, 90):
        y = np.cumsum(rng.normal(0, 1, n)) + 3 * rng.normal(size=n)
        p, loss = smoothing.fit(y)
        grid = [plain_loss(y, *g) for g in smoothing.starts(7 if n >= 14 else 0)]
        assert loss <= min(grid) * (1 + 1e-9) + 1e-9 and (p >= smoothing.LEAST).all() and (p <= smoothing.MOST).all()


def test_smoothing_models_of_any_series(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    y = simulated(60, 0.4, 0.1, 0.1, 0.9, 8)
    rows = [("a", day(k), float(v)) for k, v in enumerate(y)] + [("short", day(k), 5.0) for k in range(3)] + [("gap", day(0), 1.0), ("gap", day(20), 2.0), ("none", day(0), None), (None, day(0), 4.0), ("a", None, 9.0)]
    found = {r.s: r for r in smoothing.smoothing_models(spark.createDataFrame(rows, "s string, d date, v double"), "s", "d", "v").collect()}
    assert found.keys() == {"a", "short", "gap", None} and found["a"].n == 60 and len(found["a"].season) == 7 and found["short"].season == []
    p, loss = smoothing.fit(y)
    assert abs(found["a"].sigma - (loss / 60) ** 0.5) < 1e-9 and abs(found["a"].alpha - p[0]) < 1e-9 and abs(found["short"].level - 5) < 1e-9
    assert found["gap"].n == 2 and np.isfinite(found["gap"].level)


def test_groups_with_null_keys_or_without_values_keep_their_row(spark):
    rows = spark.createDataFrame([("a", 60.0), ("a", 70.0), (None, 50.0), ("empty", None)], "g string, v double")
    found = {r.g: r for r in forecast.heart_rate_bounds("v", ["g"], rows).collect()}
    assert found.keys() == {"a", None, "empty"} and found[None].floor is not None and found["a"].cap > found["a"].floor
    q = {r.g: r.q for r in with_quantiles(rows.select("g").distinct(), rows, "v", ["g"], [0.5]).collect()}
    assert q == {"a": [65.0], None: [50.0], "empty": None}
    assert {r.metric for r in forecast.metric_bounds(rows.withColumnRenamed("g", "metric"), "metric", "v").collect()} == {"a", None, "empty"}
