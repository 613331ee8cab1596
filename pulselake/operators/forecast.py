"""Forecasts per series: physiological bounds, fixed smoothing, the ensemble of both fitted models, holdout errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulselake.operators import smoothing, structural
from pulselake.operators.quantiles import with_quantiles


def holdout_metrics(rows: DataFrame, value: str, series: list[str], order: str, last: int, season: int) -> DataFrame:
    """MAE, RMSE and MAPE of the value ``season`` rows ago over the last ``last`` rows of each series."""
    w = Window.partitionBy(*series).orderBy(order)
    y = F.col(value).cast("double")
    lagged = rows.select(*series, y.alias("y"), F.lag(y, season).over(w).alias("p"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*series)).alias("n"))
    error = F.col("y") - F.col("p")
    return lagged.filter(F.col("i") > F.col("n") - last).groupBy(*series).agg(
        F.count(F.lit(1)).alias("k"),
        F.round(F.avg(F.abs(error)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.avg(F.abs(error / (F.col("y") + F.lit(1e-6)))) * 100, 6).alias("mape"),
    )


def bounds(value: str, by: list[str], rows: DataFrame) -> DataFrame:
    """Floor and cap per group from extremes and outer percentiles (the generic rule).

    For values from 0 up: the floor is four fifths of the minimum or half under it, not
    below 0, and the cap a quarter above the maximum; for negative minima, a fifth below.
    """
    y = F.col(value)
    found = rows.groupBy(*by).agg(F.min(y).alias("mn"), F.max(y).alias("mx"))
    zero = F.lit(0.0)
    floor = F.when(F.col("mn") >= 0, F.least(F.greatest(zero, F.col("mn") * 0.8), F.greatest(zero, F.col("mn") - 0.5))).otherwise(F.col("mn") * 1.2)
    return found.withColumn("floor", floor).withColumn("cap", F.greatest(F.col("mx") * 1.25, F.col("floor") + 5)).drop("mn", "mx")


def heart_rate_bounds(value: str, by: list[str], rows: DataFrame) -> DataFrame:
    """Floor and cap of a resting heart rate: near the observed range, within 38 and 115, at least 5 apart."""
    s = with_quantiles(rows.groupBy(*by).agg(F.min(value).alias("mn"), F.max(value).alias("mx")), rows, value, by, [0.01, 0.99])
    floor = F.least(F.greatest(F.lit(38.0), F.col("q")[0] - 3), F.col("mn") - 0.5)
    cap = F.greatest(F.least(F.lit(115.0), F.greatest(F.col("mx") + 6, F.col("q")[1] + 4)), F.col("mx") + 0.5)
    wide = s.select(*by, floor.alias("floor"), cap.alias("cap"))
    return wide.withColumn("cap", F.when(F.col("cap") - F.col("floor") < 5, F.col("floor") + 10).otherwise(F.col("cap")))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``value`` within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def horizon_dates(today: Column, include_today: bool = True) -> Column:
    """Dates from today (or tomorrow) to the Sunday of next week."""
    return F.sequence(today if include_today else F.date_add(today, 1), F.date_add(today, 13 - F.weekday(today)))


def damped_steps(rows: DataFrame, series: str, day: str, value: str, alpha: float, beta: float, phi: float) -> DataFrame:
    """(series, n, next_value): the damped one-step forecast after each row of a series, to its last row.

    A series is sorted in its partition and folded batch by batch; the state is one level and one trend.
    After a null value all are null.
    """
    kept = rows.select(series, day, F.col(value).cast("double").alias("_y"))
    kept = kept.repartition(series).sortWithinPartitions(series, day)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, n, level, trend = False, None, 0, 0.0, 0.0
        for batch in batches:
            counts, values = [], []
            for k, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                y = np.nan if y is None else y
                if not begun or k != key:
                    begun, key, n, level, trend = True, k, 1, y, 0.0
                else:
                    before, n = level, n + 1
                    level = alpha * y + (1 - alpha) * (before + phi * trend)
                    trend = beta * (level - before) + (1 - beta) * phi * trend
                counts.append(n)
                values.append(level + phi * trend)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(values, pa.float64(), from_pandas=True)], names=[series, "n", "next_value"])

    return kept.mapInArrow(run, f"{series} {dict(kept.dtypes)[series]}, n long, next_value double")


def forecast_series(rows: DataFrame, series: str, day: str, value: str, horizon: int, weight: float = 0.5) -> DataFrame:
    """Ensemble of both models per series, clamped to its bounds: n + horizon rows each.

    Columns: series, ds, predicted, ci_lower, ci_upper, is_forecast. A series is fitted in
    one Arrow group; one with fewer than three values repeats its mean.
    """
    kind = dict(rows.dtypes)[series]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ds").dropna(subset=["y"])
        y = frame["y"].to_numpy(float)
        if not len(y):
            return pd.DataFrame({series: [], "ds": [], "predicted": [], "ci_lower": [], "ci_upper": [], "is_forecast": []})
        mn, mx = y.min(), y.max()
        low = min(max(0, 0.8 * mn), max(0, mn - 0.5)) if mn >= 0 else 1.2 * mn
        high = max(1.25 * mx, low + 5)
        if len(y) < 3:
            one = two = (np.full(len(y), y.mean()), np.full(horizon, y.mean()), 1.0)
        else:
            days = frame["ds"].to_numpy().astype("datetime64[D]").astype(np.int64)
            found = structural.structural_fit(days, y, horizon, low, high)["yhat"].to_numpy()
            one, two = smoothing.forecast(y, horizon), (found[: len(y)], found[len(y) :], max(float(np.std(y - found[: len(y)])), 1e-4))
        curve = weight * np.concatenate(one[:2]) + (1 - weight) * np.concatenate(two[:2])
        sigma = weight * one[2] + (1 - weight) * two[2]
        fan = 1.96 * sigma * np.sqrt(np.concatenate((np.ones(len(y)), np.arange(1, horizon + 1))))
        last = frame["ds"].iloc[-1]
        dates = [*frame["ds"], *[last + pd.Timedelta(days=h).to_pytimedelta() for h in range(1, horizon + 1)]]
        clip = lambda v: np.clip(v, low, high)
        return pd.DataFrame(
            {series: frame[series].iloc[0], "ds": dates, "predicted": clip(curve), "ci_lower": clip(curve - fan), "ci_upper": clip(curve + fan), "is_forecast": np.arange(len(curve)) >= len(y)}
        )

    schema = f"{series} {kind}, ds date, predicted double, ci_lower double, ci_upper double, is_forecast boolean"
    return rows.select(series, F.col(day).alias("ds"), F.col(value).cast("double").alias("y")).groupBy(series).applyInPandas(fit, schema)


#: Bounds of each metric (fixed values). mn, mx: least and greatest value; q1, q9: 1st and 99th
#: percentile; mu, sd: mean and population deviation. The gap rule applies where cap - floor is less.
BOUND_RULES = {
    "resting_heart_rate": ("least(greatest(38, q1 - 3), mn - 0.5)", "greatest(least(115, greatest(mx + 6, q9 + 4)), mx + 0.5)", 5, "floor + 10"),
    "running_avg_hr": ("greatest(110, least(mn - 5, q1 - 3))", "least(200, greatest(mx + 10, q9 + 8))", 10, "floor + 20"),
    "gym_avg_hr": ("greatest(80, least(mn - 5, q1 - 3))", "least(175, greatest(mx + 10, q9 + 8))", 10, "floor + 20"),
    "walking_avg_hr": ("greatest(75, least(mn - 5, q1 - 3))", "least(150, greatest(mx + 8, q9 + 6))", 10, "floor + 15"),
    "total_sleep_hours": ("greatest(3.5, least(mn - 0.5, q1 - 0.5))", "least(13, greatest(mx + 1, q9 + 1))", 2, "floor + 3"),
    "active_kilocalories": ("0", "greatest(mx * 1.5, 3000)", None, None),
    "resting_kilocalories": ("greatest(900, least(mn - 50, 1100))", "least(2800, greatest(mx + 100, 2400))", 100, "floor + 200"),
    "total_kilocalories": ("greatest(1100, least(mn - 100, 1400))", "greatest(mx * 1.4, 4500)", None, None),
    "hrv_rmssd": ("least(greatest(15, least(mn * 0.8, q1 - 5)), mn - 0.5)", "greatest(mx * 1.35, q9 + 15)", 10, "floor + 15"),
    "daily_avg_stress": ("greatest(18, least(mn, round(mu - 1.5 * sd, 1)))", "least(36, greatest(34, round(mu + 1.5 * sd, 1)))", 6, "least(37, floor + 8)"),
    "sleep_score": ("greatest(30, least(mn - 10, 50))", "100", None, None),
    "total_steps": ("0", "greatest(mx * 1.5, 30000)", None, None),
    "fitness_age": ("greatest(28, least(mn - 0.5, 33.5))", "greatest(mx + 1, 41)", None, None),
    "fitness_age_gap": ("greatest(0, least(mn - 1, 3.5))", "greatest(mx + 1.5, 7.5)", None, None),
}


def metric_bounds(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """(metric, floor, cap) by each metric's rule; metrics without one get the generic rule."""
    s = rows.groupBy(metric).agg(F.min(value).alias("mn"), F.max(value).alias("mx"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    s = with_quantiles(s, rows, value, [metric], [0.01, 0.99])
    s = s.withColumn("q1", F.col("q")[0]).withColumn("q9", F.col("q")[1])
    generic_floor = "CASE WHEN mn >= 0 THEN least(greatest(0, mn * 0.8), greatest(0, mn - 0.5)) ELSE mn * 1.2 END"
    case = lambda k, other: "CASE " + " ".join(f"WHEN {metric} = '{m}' THEN CAST({r[k]} AS DOUBLE)" for m, r in BOUND_RULES.items() if r[k] is not None) + f" ELSE {other} END"
    s = s.withColumn("floor", F.expr(case(0, generic_floor))).withColumn("cap", F.expr(case(1, "greatest(mx * 1.25, floor + 5)")))
    gap = "CASE " + " ".join(f"WHEN {metric} = '{m}' THEN {r[2]}" for m, r in BOUND_RULES.items() if r[2]) + " ELSE 0 END"
    s = s.withColumn("cap", F.expr(f"CASE WHEN cap - floor < {gap} THEN {case(3, 'cap')} ELSE cap END"))
    return s.select(metric, "floor", "cap")
