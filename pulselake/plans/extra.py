"""The last lines of the inventory: attribution, tools, partitions, scalar function families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import store, tools
from pulselake.operators.anomaly import affects, rule_factors
from pulselake.operators.consolidate import cents, completeness, consolidate_daily
from pulselake.plans.common import DAILY, daily
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources.tables import purge_days


@query(f"""
WITH {DAILY}, m AS (SELECT user_id, day, CAST(sum(value) FILTER (WHERE metric = 'click') AS DOUBLE) AS hrv, CAST(sum(value) FILTER (WHERE metric = 'view') AS DOUBLE) AS rhr FROM daily GROUP BY 1, 2),
z AS (SELECT user_id, day, (hrv - avg(hrv) OVER p) / (stddev_pop(hrv) OVER p + 1e-6) AS zh, (rhr - avg(rhr) OVER p) / (stddev_pop(rhr) OVER p + 1e-6) AS zr FROM m WINDOW p AS (PARTITION BY user_id))
SELECT user_id, day, coalesce(zh < -1.5, false) AS hrv, coalesce(zr > 1.5, false) AS resting FROM z
""")
def g3_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics the factors of a day point to."""
    wide = consolidate_daily(table(spark, sf_dir, "events"), ["click", "view", "error", "purchase", "signup"])
    rows = wide.select("user_id", "day", F.col("click_sum").cast("double").alias("h"), F.col("view_sum").cast("double").alias("r"))
    found = rule_factors(rows, [("h", "<", -1.5, "Low HRV"), ("r", ">", 1.5, "Elevated Resting HR")], ["user_id"])
    return found.select("user_id", "day", affects(F.col("factors"), "hrv_rmssd").alias("hrv"), affects(F.col("factors"), "resting_heart_rate").alias("resting"))


@query(f"""
WITH {DAILY}, d AS (SELECT user_id, day, sum(value) FILTER (WHERE metric = 'click') AS clicks, count(*) AS kinds FROM daily GROUP BY 1, 2),
e AS (SELECT *, coalesce(max(CASE WHEN clicks IS NOT NULL THEN day END) OVER (PARTITION BY user_id), max(day) OVER (PARTITION BY user_id)) AS last_day FROM d)
SELECT user_id, day, CAST(clicks AS DOUBLE) AS clicks, kinds FROM e WHERE day BETWEEN last_day - 6 AND last_day
""")
def m3_recent_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days of each user up to the latest one with clicks."""
    clicks = F.sum(F.when(F.col("metric") == "click", F.col("value")))
    days = daily(spark, sf_dir).groupBy("user_id", "day").agg(clicks.cast("double").alias("clicks"), F.count(F.lit(1)).alias("kinds"))
    return tools.recent_actuals(days, "user_id", "day", "clicks", 7)


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS kinds, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
  max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS signups FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN kinds >= 3 AND clicks = 1 AND views = 1 THEN 'skipped' WHEN signups = 1 THEN 'repaired' ELSE 'failed' END AS outcome FROM p
""")
def c19_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days skipped as complete, repaired, or failed."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    present = events.groupBy("user_id", "day").agg(F.count_distinct("event_type").alias("kinds"), has("click").alias("clicks"), has("view").alias("views"))
    return tools.triage(completeness(present), events.filter("event_type = 'signup'"), ["user_id", "day"])


@query(f"""
WITH {DAILY} SELECT day, CAST(sum(value) AS DOUBLE) AS value, CASE WHEN day = DATE '2024-01-10' THEN 'rebuilt' ELSE 'kept' END AS state FROM daily GROUP BY day
""")
def b8_rebuild_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of a consolidated table is built anew, the others are kept."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    build = lambda rows, state: rows.groupBy("day").agg(F.sum(cents("value")).cast("double").alias("value")).withColumn("state", F.lit(state))
    stored = build(events, "kept")
    fresh = build(events.filter("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-11'"), "rebuilt")
    return store.force_replace(stored, fresh, ["day"])


@query("""
SELECT source AS folder, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'sample' ELSE '2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') END AS source FROM documents)
WHERE source = 'sample' OR source < '2024-01-15' GROUP BY 1
""")
def b20_purge_open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day folders from a date on are purged; folders that are no dates stay."""
    folder = F.when(F.col("lang") == "en", "sample").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "documents").select(folder.alias("folder"))
    return purge_days(rows, "folder", F.to_date(F.lit("2024-01-15"))).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, abs(value - 50) AS distance, round(sqrt(value), 6) AS root, least(greatest(value, 10.0), 90.0) AS clipped, round(ln(value + 1), 6) AS logged FROM events
""")
def k3_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mathematical functions."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.abs(v - 50).alias("distance"), F.round(F.sqrt(v), 6).alias("root"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"), F.round(F.ln(v + 1), 6).alias("logged")
    )


@query("""
SELECT doc_id, lower(source) AS low, upper(lang) AS up, replace(source, 'src', 'source_') AS named, starts_with(text, 'The') AS the, substr(text, 1, 20) AS head,
  (length(text) - length(replace(text, 'en', ''))) // 2 AS occurrences FROM documents
""")
def k4_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions, occurrences counted without overlap."""
    text = F.col("text")
    found = ((F.length(text) - F.length(F.replace(text, F.lit("en"), F.lit("")))) / 2).cast("bigint")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lower("source").alias("low"), F.upper("lang").alias("up"), F.replace("source", F.lit("src"), F.lit("source_")).alias("named"), F.startswith(text, F.lit("The")).alias("the"), F.substring(text, 1, 20).alias("head"), found.alias("occurrences")
    )


@query("""
SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0) AS filled, nullif(event_type, 'view') AS kind,
  CASE WHEN value > 75 THEN 'high' WHEN value > 25 THEN 'middle' ELSE 'low' END AS level FROM events
""")
def k5_conditionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals and nulls."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.when(F.col("event_type") != "error", v), F.lit(0.0)).alias("filled"), F.nullif("event_type", F.lit("view")).alias("kind"), F.when(v > 75, "high").when(v > 25, "middle").otherwise("low").alias("level")
    )


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE '?' END AS short, CASE WHEN length(text) > 100 THEN 'len,role' ELSE 'role' END AS kept FROM conversations
""")
def k7_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map lookups with defaults, merges and filters."""
    names = F.create_map(F.lit("user"), F.lit("U"), F.lit("assistant"), F.lit("A"))
    merged = F.map_concat(F.create_map(F.lit("role"), F.lit(101)), F.create_map(F.lit("len"), F.length("text")))
    kept = F.array_join(F.sort_array(F.map_keys(F.map_filter(merged, lambda k, v: v > 100))), ",")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(names, F.col("role")), F.lit("?")).alias("short"), kept.alias("kept"))


@query("""
WITH h AS (SELECT o_orderpriority AS priority, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY 1),
t AS (SELECT priority, last_day, last_day + CAST(14 - isodow(last_day) AS INTEGER) AS target FROM h)
SELECT priority, greatest(datediff('day', last_day, CAST(target AS DATE)) + 1, datediff('day', last_day, CAST(target AS DATE))) AS horizon FROM t
""")
def g24_horizon_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to forecast: as many as there are dates, or as the last date is away from the history."""
    from pulselake.operators.forecast import horizon_dates

    last = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_day"))
    dates = horizon_dates(F.col("last_day"))
    return last.select("priority", F.greatest(F.size(dates), F.datediff(F.element_at(dates, -1), "last_day")).cast("bigint").alias("horizon"))
