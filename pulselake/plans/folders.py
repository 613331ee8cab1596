"""Raw day folders, written from the event table and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators.consolidate import cents
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources.day_folders import day_folders, store_files
from pulselake.sources.tables import scratch

_DAYS = """k AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2),
f AS (
  SELECT day, kind, NULL::BIGINT AS activity_id, CASE WHEN kind = 'error' AND day(day) % 7 = 3 THEN NULL ELSE total END AS total, false AS packed, kind = 'error' AND day(day) % 7 = 3 AS bad FROM k
  UNION ALL SELECT CAST(ts AS DATE), 'activity', event_id, CASE WHEN event_id % 30 = 10 THEN NULL ELSE value END, event_id % 20 = 0, event_id % 30 = 10 FROM events WHERE event_id % 10 = 0)"""


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Day folders with a file a kind and one for every tenth event; some of them are broken off, some events have a package."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    root = scratch(spark, "raw")
    folder = F.col("day").cast("string")
    days = events.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).cast("double").alias("total"))
    whole = F.to_json(F.struct(folder.alias("calendarDate"), "n", "total"))
    broken = (F.col("event_type") == "error") & (F.dayofmonth("day") % 7 == 3)
    kinds = days.select(F.concat(folder, F.lit("/"), F.col("event_type"), F.lit(".json")).alias("path"), F.when(broken, F.substring(whole, 1, 12)).otherwise(whole).cast("binary").alias("content"))
    acts = events.filter("event_id % 10 = 0").withColumn("base", F.concat(folder, F.lit("/activities/activity_"), F.col("event_id").cast("string")))
    text = F.to_json(F.struct("event_id", "value"))
    summaries = acts.select(F.concat("base", F.lit("_summary.json")).alias("path"), F.when(F.col("event_id") % 30 == 10, "not json").otherwise(text).cast("binary").alias("content"))
    packages = acts.filter("event_id % 20 = 0").select(F.concat("base", F.lit(".zip")).alias("path"), F.lit(b"PK").alias("content"))
    others = days.limit(1).select(F.lit("sample/click.json").alias("path"), F.lit(b"{}").alias("content"))
    store_files(kinds.union(summaries).union(packages).union(others), root)
    return root


def _told(rows: DataFrame) -> DataFrame:
    total = F.coalesce(F.get_json_object("payload", "$.total"), F.get_json_object("payload", "$.value")).cast("double")
    bad = F.col("error").isNotNull()
    return rows.select("day", "kind", "activity_id", F.when(~bad, total).alias("total"), F.col("package").isNotNull().alias("packed"), bad.alias("bad"))


@query(f"WITH {_DAYS} SELECT day, kind, activity_id, total, packed, bad FROM f")
def a1_day_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All day folders, broken files included, each with its error."""
    return _told(day_folders(spark, _stored(spark, sf_dir)))


@query(f"WITH {_DAYS} SELECT day, kind, activity_id, total, packed, bad FROM f WHERE day >= DATE '2024-01-09' AND day < DATE '2024-01-12' AND kind <> 'view'")
def a2_days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of three days; no other is opened."""
    rows = day_folders(spark, _stored(spark, sf_dir))
    return _told(rows.filter("day >= date'2024-01-09' and day < date'2024-01-12' and kind <> 'view'"))
