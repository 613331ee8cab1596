"""Query tools over consolidated days and forecasts, as lazy frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Units of the metrics in sentences (fixed values).
UNITS = {
    "resting_heart_rate": " ppm", "running_avg_hr": " ppm", "walking_avg_hr": " ppm", "gym_avg_hr": " ppm", "hrv_rmssd": " ms", "daily_avg_stress": " pts",
    "sleep_score": " pts", "total_sleep_hours": " hrs", "total_steps": " pasos", "active_kilocalories": " kcal", "resting_kilocalories": " kcal", "total_kilocalories": " kcal",
}


def unit(metric: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, metric), F.lit(""))


#: Metrics that the forecast tool does not give (fixed values).
EXCLUDED = ["fitness_age", "fitness_age_gap", "chronological_age"]


def forecast_tool(forecasts: DataFrame, base: Column, horizon: int) -> DataFrame:
    """Forecasts up to ``horizon`` days after ``base``, without excluded metrics, each with ``days_ahead`` and a sentence."""
    rows = forecasts.filter(~F.col("metric").isin(EXCLUDED)).withColumn("days_ahead", F.datediff("target_date", base).cast("bigint"))
    rows, mark = rows.filter(F.col("days_ahead").between(1, horizon)), unit(F.col("metric"))
    text = lambda c: F.col(c).cast("string")
    parts = ["El pronóstico para dentro de ", text("days_ahead"), " día(s) (", text("target_date"), ") de ", F.col("metric"), " es de ", text("predicted_value"), mark]
    parts += [" (IC 95%: [", text("ci_lower"), " a ", text("ci_upper"), "]", mark, "), proyectado por ", F.col("model_name"), "."]
    return rows.withColumn("statement", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def forecast_status(asked: DataFrame, forecasts: DataFrame, base: Column, horizon: int) -> DataFrame:
    """(metric, status, predictions) of each metric asked for: excluded ones are errors, those without forecasts empty."""
    stored = forecasts.groupBy("metric").agg(F.count(F.lit(1)).alias("stored"), F.count(F.when(F.datediff("target_date", base).between(1, horizon), 1)).alias("ahead"))
    excluded = F.col("metric").isin(EXCLUDED)
    status = F.when(excluded, "error").when(F.col("stored").isNull(), "empty").otherwise("success")
    return asked.join(stored, "metric", "left").select("metric", status.alias("status"), F.when(excluded, 0).otherwise(F.coalesce("ahead", F.lit(0))).cast("bigint").alias("predictions"))


def recent_actuals(rows: DataFrame, series: str, day: str, filled: str, days: int = 3, end: Column | None = None) -> DataFrame:
    """The last ``days`` (1 to 90) calendar days of each series up to ``end``.

    Without ``end`` a series ends at its latest day whose ``filled`` column is not null, else
    at its latest day; one window over the series finds that.
    """
    days = min(90, max(1, days))
    whole = Window.partitionBy(series)
    last = end if end is not None else F.coalesce(F.max(F.when(F.col(filled).isNotNull(), F.col(day))).over(whole), F.max(day).over(whole))
    return rows.withColumn("_end", last).filter(F.col(day).between(F.date_sub("_end", days - 1), F.col("_end"))).drop("_end")


def triage(days: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome) of days with ``ok``: skipped if complete, else repaired if ``fixed`` has them, else failed."""
    joined = days.join(fixed.select(*keys).distinct().withColumn("_fixed", F.lit(True)), keys, "left")
    outcome = F.when(F.col("ok"), "skipped").when(F.col("_fixed"), "repaired").otherwise("failed")
    return joined.select(*keys, outcome.alias("outcome"))
