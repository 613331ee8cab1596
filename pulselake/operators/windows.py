"""Window operators over series: fills, interpolation, row and calendar windows.

Every function takes the series columns that the window is partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec


def _over(series: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(order)


def dense_calendar(rows: DataFrame, series: list[str], day: str) -> DataFrame:
    """A row for every day between a series' first and last; added days have nulls elsewhere."""
    span = rows.groupBy(*series).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return span.join(rows, [*series, day], "left")


def forward_fill(column: str, series: list[str], order: str) -> Column:
    return F.last(column, ignorenulls=True).over(_over(series, order).rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(column: str, series: list[str], order: str) -> Column:
    return F.first(column, ignorenulls=True).over(_over(series, order).rowsBetween(0, Window.unboundedFollowing))


def fill_both(column: str, series: list[str], order: str) -> Column:
    """Forward, then backward fill."""
    return F.coalesce(forward_fill(column, series, order), backward_fill(column, series, order))


def lag_filled(column: str, series: list[str], order: str) -> Column:
    """The previous row's value, filled forward and then backward."""
    w = _over(series, order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before, F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def interpolate(rows: DataFrame, column: str, series: list[str], order: str, out: str) -> DataFrame:
    """Linear interpolation by row position; ends take the nearest known value."""
    w = _over(series, order)
    at = rows.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("_i").alias("i")))
    previous = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = at.withColumn("_p", previous).withColumn("_n", following)
    slope = (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.i") - F.col("_p.i"))
    value = F.when(F.col("_p.i") < F.col("_n.i"), F.col("_p.v") + slope * (F.col("_i") - F.col("_p.i"))).otherwise(F.coalesce("_p.v", "_n.v"))
    return both.withColumn(out, value).drop("_i", "_p", "_n")


def rolling_rows(column: str, series: list[str], order: str, rows: int) -> Column:
    """Mean of the last ``rows`` rows with at least one value; exact for decimals."""
    w = _over(series, order).rowsBetween(1 - rows, 0)
    return F.sum(column).over(w).cast("double") / F.nullif(F.count(column).over(w), F.lit(0))


def rolling_days(column: str, series: list[str], day: str, first: int, last: int) -> Column:
    """Sum over the calendar days [day + first, day + last], whatever rows there are."""
    w = Window.partitionBy(*series).orderBy(F.unix_date(day)).rangeBetween(first, last)
    return F.sum(column).over(w)


def acwr(column: str, series: list[str], order: str, epsilon: float) -> Column:
    """Acute to chronic ratio: 3-row over 7-row mean."""
    return rolling_rows(column, series, order, 3) / (rolling_rows(column, series, order, 7) + F.lit(epsilon))
