"""Consolidation of per-day facts into one wide row, and the actual/forecast timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cents(column: str | Column) -> Column:
    """Exact two-decimal value, so that sums do not depend on row order."""
    return F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")


def consolidate_daily(events: DataFrame, kinds: list[str], series: str = "user_id") -> DataFrame:
    """Count and exact sum of every kind per (series, day), side by side.

    The reference joins one relation per kind; conditional aggregates give the same
    columns with one shuffle. A kind that is absent on a day has null count and sum.
    """
    day = F.col("ts").cast("date").alias("day")
    columns = []
    for kind in kinds:
        of_kind = F.col("event_type") == kind
        columns += [
            F.nullif(F.count(F.when(of_kind, 1)), F.lit(0)).alias(f"{kind}_n"),
            F.sum(F.when(of_kind, cents("value"))).alias(f"{kind}_sum"),
        ]
    return events.filter(F.col("event_type").isin(kinds)).groupBy(series, day).agg(*columns)


def pivot_metrics(long: DataFrame, day: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Long forecasts to one row per day: one pass for what the reference does in a self-join per metric."""
    return long.groupBy(day).pivot(metric, metrics).agg(F.max(value))


def unified_timeline(actual: DataFrame, forecasts: DataFrame, day: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Actual rows, and pivoted forecasts of the days that have none, tagged by ``record_type``."""
    future = pivot_metrics(forecasts, day, metric, value, metrics).join(actual.select(day), day, "left_anti")
    tag = lambda rows, kind: rows.select(day, F.lit(kind).alias("record_type"), *metrics)
    return tag(actual, "ACTUAL").unionByName(tag(future, "FORECAST"))


def completeness(days: DataFrame) -> DataFrame:
    """(user_id, day, ok, reason) of days with the number of kinds and the presence of two key metrics."""
    reason = (
        F.when(F.col("kinds").isNull(), "no data")
        .when(F.col("kinds") < 3, "missing files")
        .when(F.col("clicks") == 0, "no clicks")
        .when(F.col("views") == 0, "no views")
        .otherwise("complete")
    )
    return days.select("user_id", "day", (reason == "complete").alias("ok"), reason.alias("reason"))
