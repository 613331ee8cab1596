"""Averages that treat zeros as missing, and past-versus-future week summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def valid(value: Column, signed: bool = False) -> Column:
    """``value`` if it counts: not null, not NaN and above 0 (``signed``: other than 0)."""
    good = ~F.isnan(value.cast("double")) & ((value != 0) if signed else (value > 0))
    return F.when(good, value)


def clean_average(value: Column, when: Column | None = None, signed: bool = False) -> tuple[Column, Column]:
    """(mean rounded to 2 decimals, number of valid values), as aggregates; (null, 0) if none is valid.

    ``value`` should be a decimal: sums are then exact and rounding has no ties that differ
    between engines.
    """
    counted = valid(value, signed)
    if when is not None:
        counted = F.when(when, counted)
    n = F.count(counted)
    mean = F.round((F.sum(counted).cast("decimal(30,6)") / F.nullif(n, F.lit(0)).cast("decimal(12,0)")).cast("decimal(30,8)"), 2)
    return mean.cast("double"), n


def past_future_week(daily: DataFrame, forecasts: DataFrame, metrics: list[str], anchor: Column, series: str) -> DataFrame:
    """One row per series: clean averages over [anchor-7, anchor-1] of actuals and [anchor, anchor+6] of forecasts.

    ``daily`` and ``forecasts`` are long: (series, day, metric, value decimal).
    """
    def side(rows: DataFrame, prefix: str, first: int, last: int) -> DataFrame:
        window = rows.filter(F.col("day").between(F.date_add(anchor, first), F.date_add(anchor, last)))
        columns = []
        for metric in metrics:
            mean, n = clean_average(F.col("value"), F.col("metric") == metric)
            columns += [mean.alias(f"{prefix}_{metric}_avg"), n.alias(f"{prefix}_{metric}_days")]
        return window.groupBy(series).agg(*columns)

    return side(daily, "hist", -7, -1).join(side(forecasts, "fore", 0, 6), series, "full_outer").withColumn("anchor_date", anchor)
