"""Views of the event table that several queries share, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators.consolidate import cents
from pulselake.session import table

KINDS = ["click", "error", "purchase", "signup", "view"]

#: (user_id, day, metric, n, value): exact sums of the events of a day.
DAILY = """daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type AS metric, count(*) AS n,
         sum(CAST(value AS DECIMAL(18,2))) AS value
  FROM events GROUP BY ALL)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("value")
    )


#: (target_date, metric, predicted_value): every metric's daily mean of the week before an anchor, a week on.
NAIVE = """naive AS (
  SELECT anchor, CAST(CAST(ts AS DATE) + 7 AS DATE) AS target_date, event_type AS metric,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS predicted_value
  FROM events, (VALUES (DATE '2024-01-22'), (DATE '2024-01-25')) a(anchor)
  WHERE CAST(ts AS DATE) BETWEEN anchor - 6 AND anchor
  GROUP BY ALL)"""


def naive(spark: SparkSession, sf_dir: str, anchor: str) -> DataFrame:
    """Seasonal-naive forecasts made at ``anchor`` for the seven days after it."""
    last = F.to_date(F.lit(anchor))
    day = F.col("ts").cast("date")
    events = table(spark, sf_dir, "events").filter(day.between(F.date_sub(last, 6), last))
    mean = F.sum(cents("value")).cast("double") / F.count("value")
    return events.groupBy(F.date_add(day, 7).alias("target_date"), F.col("event_type").alias("metric")).agg(mean.alias("predicted_value"))


#: (priority, day, n, value): orders of a day, one series per priority.
ORDERS = """series AS (
  SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value
  FROM orders GROUP BY ALL)"""


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("value")
    )
