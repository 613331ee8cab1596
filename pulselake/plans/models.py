"""Queries of forecasts, bounds and detectors."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import forecast, smoothing, structural
from pulselake.operators.anomaly import impute, isolation_forest, local_outlier_factor, severities
from pulselake.operators.quantiles import exact_quantiles
from pulselake.plans.common import ORDERS, daily, order_series
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources.tables import scratch


@query("""
WITH s AS (SELECT event_type AS metric, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
f AS (SELECT *, CASE WHEN mn >= 0 THEN least(greatest(0.0, mn * 0.8), greatest(0.0, mn - 0.5)) ELSE mn * 1.2 END AS floor FROM s)
SELECT metric, round(floor, 6) AS floor, round(greatest(mx * 1.25, floor + 5), 6) AS cap FROM f
""")
def g17_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic floor and cap of each metric."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return forecast.bounds("value", ["metric"], rows).select("metric", F.round("floor", 6).alias("floor"), F.round("cap", 6).alias("cap"))


@query("""
WITH s AS (SELECT event_type AS metric, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q9 FROM events GROUP BY 1),
f AS (SELECT metric, least(greatest(38.0, q1 - 3), mn - 0.5) AS floor, greatest(least(115.0, greatest(mx + 6, q9 + 4)), mx + 0.5) AS cap FROM s)
SELECT metric, round(floor, 6) AS floor, round(CASE WHEN cap - floor < 5 THEN floor + 10 ELSE cap END, 6) AS cap FROM f
""")
def g17_heart_rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor and cap by the resting heart rate's rule."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return forecast.heart_rate_bounds("value", ["metric"], rows).select("metric", F.round("floor", 6).alias("floor"), F.round("cap", 6).alias("cap"))


@query(f"""
WITH {ORDERS}, b AS (SELECT priority, quantile_cont(CAST(value AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(value AS DOUBLE), 0.95) AS hi FROM series GROUP BY 1)
SELECT s.priority, s.day, round(least(greatest(CAST(value AS DOUBLE), lo), hi), 6) AS value FROM series s JOIN b ON b.priority = s.priority
""")
def c13_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values clamped to their series' 5th and 95th percentile."""
    rows = order_series(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    edges = exact_quantiles(rows, "value", ["priority"], [0.05, 0.95])
    joined = rows.join(edges, "priority")
    return joined.select("priority", "day", F.round(forecast.clamp(F.col("value"), F.col("q")[0], F.col("q")[1]), 6).alias("value"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS today FROM orders)
SELECT today, CAST(unnest(generate_series(today, today + CAST(14 - isodow(today) AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS target_date FROM d
""")
def g23_horizon_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast dates from each day to the Sunday of the week after."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("today")).distinct()
    return days.select("today", F.explode(forecast.horizon_dates(F.col("today"))).alias("target_date"))


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, round(40 + datediff('day', DATE '1995-01-01', min(CAST(o_orderdate AS DATE))) / 365.25, 6) AS chronological_age
FROM orders GROUP BY 1
""")
def g25_age_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic ageing line over the days that there are."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", F.round(F.lit(40) + F.datediff("day", F.lit("1995-01-01")) / F.lit(365.25), 6).alias("chronological_age"))


@query(None)
def g20_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing and bounded trend combined, with clamped intervals, 14 days on for every series."""
    return forecast.forecast_series(order_series(spark, sf_dir), "priority", "day", "value", 14)


@query(None)
def g18_structural_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic growth with sparse changepoints, weekly waves and the number of orders as a regressor, four weeks on for every series."""
    return structural.structural_forecast(order_series(spark, sf_dir), "priority", "day", "value", 28, regressors=("n",))


@query(None)
def g19_ets_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, trend, weekly season and error of damped smoothing, fitted on every series whole."""
    return smoothing.smoothing_models(order_series(spark, sf_dir), "priority", "day", "value")


@query(None)
def g12_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest over each day's number and value of orders."""
    rows = order_series(spark, sf_dir).select("priority", "day", F.col("n").cast("double").alias("n"), F.col("value").cast("double").alias("value"))
    return isolation_forest(rows, ["n", "value"])


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, click, view): every day on which a user has events, of any kind."""
    of = lambda k: F.sum(F.when(F.col("metric") == k, F.col("value"))).cast("double").alias(k)
    return daily(spark, sf_dir).groupBy("user_id", "day").agg(of("click"), of("view"))


@query(None)
def g13_local_outlier_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local outlier factor of each user's days."""
    rows = user_days(spark, sf_dir)
    return local_outlier_factor(rows, "day", ["click", "view"], ["user_id"])


@query(None)
def g15_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of each user's days from both detectors and the rule factors."""
    rows = user_days(spark, sf_dir).withColumnsRenamed({"click": "hrv", "view": "rhr"})
    path = scratch(spark, "imputed")
    impute(rows, ["hrv", "rhr"], ["user_id"], "day").write.parquet(path)
    rules = [("hrv", "<", -1.5, "low HRV"), ("rhr", ">", 1.5, "high RHR")]
    found = severities(spark.read.parquet(path), "day", rules, ["user_id"])
    return found.withColumn("factors", F.concat_ws("; ", "factors"))


@query(None)
def g22_recovery_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature importances of a random forest that predicts an order's value from its lines."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(items, "o_orderkey")
    names = ["quantity", "discount", "lines"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = RandomForestRegressor(labelCol="o_totalprice", numTrees=50, maxDepth=4, seed=42).fit(data)
    error = RegressionEvaluator(labelCol="o_totalprice", metricName="rmse").evaluate(model.transform(data))
    rows_ = [(n, float(w), float(error)) for n, w in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows_, "feature string, importance double, rmse double").orderBy(F.desc("importance"))
