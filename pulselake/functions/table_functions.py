"""Query tools as table functions for SQL: one call a partition of a TABLE argument.

``recent_actuals(TABLE(days) PARTITION BY series ORDER BY day, value => 'clicks', days => 7)`` and
``forecasts_ahead(TABLE(forecasts) PARTITION BY metric ORDER BY target_date, base => DATE'...', horizon => 5)``
give a row a record and, last, a summary row. ``analyze`` checks the arguments and names the
columns while the query is planned; rows come one by one, and a partition holds no more
of them than the answer does.
"""

from __future__ import annotations

import datetime as dt
from collections import deque

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pulselake.operators.tools import EXCLUDED

#: Days that actuals may reach back.
LONGEST = 90


def _column(table: AnalyzeArgument, name: str) -> None:
    if not table.isTable:
        raise ValueError("the first argument has to be a TABLE")
    if name not in table.dataType.fieldNames():
        raise ValueError(f"the table has no column {name}; it has {', '.join(table.dataType.fieldNames())}")


class RecentActuals:
    """The days of a series up to its last one with a value (or its last one), ``days`` back (1 to 90)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, days: AnalyzeArgument) -> AnalyzeResult:
        _column(rows, value.value)
        _column(rows, "day")
        fields = rows.dataType.fieldNames()
        if not isinstance(rows.dataType["day"].dataType, DateType):
            raise ValueError("day has to be a date")
        key = rows.dataType[fields[0]].dataType
        schema = StructType().add("kind", StringType()).add("series", key).add("day", DateType()).add("value", DoubleType()).add("status", StringType()).add("first_day", DateType()).add("last_day", DateType()).add("records", LongType()).add("mean", DoubleType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.days: deque = deque()
        self.answer: list = []
        self.series = self.value = None
        self.filled = False
        self.back = 1

    def eval(self, rows: Row, value: str, days: int):
        self.series, self.back = rows[0], min(LONGEST, max(1, days))
        day, number = rows["day"], rows[value]
        if day is None:
            return
        self.days.append((day, None if number is None else float(number)))
        while self.days[0][0] <= day - dt.timedelta(days=self.back):
            self.days.popleft()
        if number is not None or not self.filled:
            self.answer, self.filled = list(self.days), self.filled or number is not None
        elif self.answer and self.answer[-1][0] == day:
            self.answer.append(self.days[-1])

    def terminate(self):
        known = [v for _, v in self.answer if v is not None]
        for day, number in self.answer:
            yield ("record", self.series, day, number, None, None, None, None, None)
        last = self.answer[-1][0] if self.answer else None
        first = last - dt.timedelta(days=self.back - 1) if last else None
        yield ("summary", self.series, None, None, "success" if self.answer else "empty", first, last, len(self.answer), sum(known) / len(known) if known else None)


class ForecastsAhead:
    """A metric's forecasts of 1 to ``horizon`` days behind ``base``; excluded metrics are an error."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, base: AnalyzeArgument, horizon: AnalyzeArgument) -> AnalyzeResult:
        for name in ("metric", "target_date", "predicted_value"):
            _column(rows, name)
        if not isinstance(base.dataType, DateType) or horizon.value is not None and horizon.value < 1:
            raise ValueError("base has to be a date, and horizon 1 or more")
        schema = StructType().add("kind", StringType()).add("metric", StringType()).add("target_date", DateType()).add("days_ahead", LongType()).add("predicted_value", DoubleType()).add("status", StringType()).add("records", LongType()).add("excluded", BooleanType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.metric, self.records = None, 0

    def eval(self, rows: Row, base: dt.date, horizon: int):
        self.metric = rows["metric"]
        ahead = (rows["target_date"] - base).days if rows["target_date"] else 0
        if self.metric not in EXCLUDED and 1 <= ahead <= horizon:
            self.records += 1
            value = rows["predicted_value"]
            yield ("record", self.metric, rows["target_date"], ahead, None if value is None else float(value), None, None, None)

    def terminate(self):
        excluded = self.metric in EXCLUDED
        yield ("summary", self.metric, None, None, None, "error" if excluded else "success" if self.records else "empty", self.records, excluded)


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("recent_actuals", udtf(RecentActuals))
    spark.udtf.register("forecasts_ahead", udtf(ForecastsAhead))
    return ["recent_actuals", "forecasts_ahead"]
