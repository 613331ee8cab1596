"""Daily consolidation: queries over the event table seen as daily telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulselake.operators.averages import clean_average, past_future_week
from pulselake.operators.consolidate import cents, completeness, consolidate_daily, unified_timeline
from pulselake.plans.common import DAILY, KINDS, NAIVE, daily, naive
from pulselake.plans.registry import query
from pulselake.session import table


@query("""
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type,
         count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS s
  FROM events GROUP BY ALL),
spine AS (SELECT user_id, day, n AS clicks, s AS click_value FROM d WHERE event_type = 'click')
SELECT spine.user_id, spine.day, spine.clicks,
       CAST(click_value AS DOUBLE) AS click_value,
       CAST(v.s AS DOUBLE) AS view_value, CAST(p.s AS DOUBLE) AS purchase_value,
       coalesce(e.n, 0) AS errors, coalesce(u.n, 0) AS signups,
       CAST(click_value - v.s AS DOUBLE) AS resting_value
FROM spine
LEFT JOIN d v ON v.user_id = spine.user_id AND v.day = spine.day AND v.event_type = 'view'
LEFT JOIN d p ON p.user_id = spine.user_id AND p.day = spine.day AND p.event_type = 'purchase'
LEFT JOIN d e ON e.user_id = spine.user_id AND e.day = spine.day AND e.event_type = 'error'
LEFT JOIN d u ON u.user_id = spine.user_id AND u.day = spine.day AND u.event_type = 'signup'
""")
def d1_consolidate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per user and day from the five event types."""
    wide = consolidate_daily(table(spark, sf_dir, "events"), ["click", "view", "purchase", "error", "signup"])
    return wide.filter("click_n > 0").select(
        "user_id",
        "day",
        F.col("click_n").alias("clicks"),
        F.col("click_sum").cast("double").alias("click_value"),
        F.col("view_sum").cast("double").alias("view_value"),
        F.col("purchase_sum").cast("double").alias("purchase_value"),
        F.coalesce("error_n", F.lit(0)).alias("errors"),
        F.coalesce("signup_n", F.lit(0)).alias("signups"),
        (F.col("click_sum") - F.col("view_sum")).cast("double").alias("resting_value"),
    )


@query(f"""
WITH {DAILY}
SELECT c.user_id, c.day, CAST(c.value AS DOUBLE) AS click_value, CAST(v.value AS DOUBLE) AS view_value, coalesce(e.n, 0) AS errors
FROM daily c
LEFT JOIN daily v ON v.user_id = c.user_id AND v.day = c.day AND v.metric = 'view'
LEFT JOIN daily e ON e.user_id = c.user_id AND e.day = c.day AND e.metric = 'error'
WHERE c.metric = 'click' AND c.day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
""")
def d2_ml_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned timeline of one date range; the range is pushed below the aggregate."""
    events = table(spark, sf_dir, "events").filter("ts >= timestamp'2024-01-08' and ts < timestamp'2024-01-22'")
    wide = consolidate_daily(events, ["click", "view", "error"])
    return wide.filter("click_n > 0").select(
        "user_id", "day", F.col("click_sum").cast("double").alias("click_value"), F.col("view_sum").cast("double").alias("view_value"), F.coalesce("error_n", F.lit(0)).alias("errors")
    )


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS sessions, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, max(value) AS greatest
FROM events GROUP BY 1, 2
""")
def e1_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, mean and maximum of a day's activities."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day"))
    total = F.sum(cents("value")).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("sessions"), total.alias("total"), (total / F.count(F.lit(1))).alias("mean"), F.max("value").alias("greatest"))


@query("SELECT CAST(ts AS DATE) AS day, max(ts) AS latest FROM events GROUP BY 1")
def e2_latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest update of each day."""
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max("ts").alias("latest"))


@query("""
SELECT event_type, coalesce(max(CASE WHEN value > 1000000 THEN CAST(ts AS DATE) END), max(CAST(ts AS DATE))) AS latest_day FROM events GROUP BY event_type
""")
def e3_latest_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest day that meets a condition, else the latest of all, in one pass."""
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.coalesce(F.max(F.when(F.col("value") > 1_000_000, day)), F.max(day)).alias("latest_day"))


@query("""
SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations
""")
def e4_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    names = ["events", "orders", "documents", "pages", "conversations"]
    counts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts)


@query(f"""
WITH {DAILY}, w AS (SELECT * FROM daily WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30')
SELECT user_id,
  CAST(sum(value) FILTER (WHERE metric = 'click') AS DOUBLE) / count(value) FILTER (WHERE metric = 'click') AS click_mean,
  CAST(coalesce(sum(n) FILTER (WHERE metric = 'view'), 0) AS BIGINT) AS views,
  CAST(coalesce(sum(CASE WHEN metric = 'error' THEN n ELSE 0 END), 0) AS BIGINT) AS errors,
  arg_max(metric, (day, metric)) AS last_status
FROM w GROUP BY user_id
""")
def e5_period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-skipping means, sums and the last status of the latest seven days."""
    last = F.to_date(F.lit("2024-01-30"))
    week = daily(spark, sf_dir).filter(F.col("day").between(F.date_sub(last, 6), last))
    of = lambda kind, c: F.when(F.col("metric") == kind, F.col(c))
    return week.groupBy("user_id").agg(
        (F.sum(of("click", "value")).cast("double") / F.nullif(F.count(of("click", "value")), F.lit(0))).alias("click_mean"),
        F.coalesce(F.sum(of("view", "n")), F.lit(0)).alias("views"),
        F.coalesce(F.sum(of("error", "n")), F.lit(0)).alias("errors"),
        F.max_by("metric", F.struct("day", "metric")).alias("last_status"),
    )


@query("""
WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL WHEN value < 5 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS v FROM events)
SELECT user_id, CAST(round(CAST(CAST(sum(v) FILTER (WHERE v > 0) AS DECIMAL(30,6)) / nullif(count(*) FILTER (WHERE v > 0), 0) AS DECIMAL(30,8)), 2) AS DOUBLE) AS mean,
  count(*) FILTER (WHERE v > 0) AS days
FROM v GROUP BY user_id
""")
def e6_clean_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages in which zeros and nulls are missing."""
    value = F.when(F.col("event_type") == "error", None).when(F.col("value") < 5, F.lit(0).cast("decimal(18,2)")).otherwise(cents("value"))
    mean, n = clean_average(value)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(mean.alias("mean"), n.alias("days"))


def _week_sql() -> str:
    columns = []
    for side, source in (("hist", "h"), ("fore", "f")):
        for kind in KINDS:
            own = f"FILTER (WHERE metric = '{kind}' AND value > 0)"
            mean = f"CAST(round(CAST(CAST(sum(value) {own} AS DECIMAL(30,6)) / nullif(count(value) {own}, 0) AS DECIMAL(30,8)), 2) AS DOUBLE)"
            columns.append((source, f"{mean} AS {side}_{kind}_avg, count(value) {own} AS {side}_{kind}_days"))
    h, f = (", ".join(c for s, c in columns if s == source) for source in "hf")
    return f"""
WITH {DAILY},
h AS (SELECT user_id, {h} FROM daily WHERE day BETWEEN DATE '2024-01-17' AND DATE '2024-01-23' GROUP BY user_id),
future AS (SELECT user_id, day + 7 AS day, metric, value FROM daily WHERE day BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'),
f AS (SELECT user_id, {f} FROM future GROUP BY user_id)
SELECT coalesce(h.user_id, f.user_id) AS user_id, h.* EXCLUDE (user_id), f.* EXCLUDE (user_id), DATE '2024-01-24' AS anchor_date FROM h FULL JOIN f ON h.user_id = f.user_id"""


@query(_week_sql())
def e7_past_future_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days back against seven days of (seasonal-naive) forecasts, per user and metric."""
    actual = daily(spark, sf_dir).select("user_id", "day", "metric", "value")
    anchor = F.to_date(F.lit("2024-01-24"))
    forecasts = actual.filter(F.col("day").between(F.date_sub(anchor, 7), F.date_sub(anchor, 1))).withColumn("day", F.date_add("day", 7))
    return past_future_week(actual, forecasts, KINDS, anchor, "user_id")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day,
  arg_max(value, event_id) FILTER (WHERE event_type IN ('click', 'view')) AS running_hr,
  arg_max(value, event_id) FILTER (WHERE event_type IN ('purchase')) AS gym_hr,
  arg_max(value, event_id) FILTER (WHERE event_type IN ('signup', 'error') AND value > 0) AS walking_hr
FROM events GROUP BY 1, 2
""")
def e8_last_activity_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last activity of each sport family of a day wins."""
    last = lambda *kinds: F.max_by("value", F.when(F.col("event_type").isin(*kinds), F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        last("click", "view").alias("running_hr"), last("purchase").alias("gym_hr"), F.max_by("value", F.when(F.col("event_type").isin("signup", "error") & (F.col("value") > 0), F.col("event_id"))).alias("walking_hr")
    )


@query(f"""
WITH {DAILY}, w AS (SELECT user_id, day, {", ".join(f"max(value) FILTER (WHERE metric = '{k}') AS {k}" for k in KINDS)} FROM daily GROUP BY 1, 2),
m AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, CAST(count(*) - count({k}) AS DOUBLE) * 100 / count(*) AS missing_pct FROM w" for k in KINDS)})
SELECT metric, round(missing_pct, 6) AS missing_pct FROM m WHERE missing_pct > 0
""")
def e9_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of user-days without each metric, in percent, where there is any."""
    wide = consolidate_daily(table(spark, sf_dir, "events"), KINDS)
    shares = [F.struct(F.lit(k).alias("metric"), ((F.count(F.lit(1)) - F.count(f"{k}_sum")).cast("double") * 100 / F.count(F.lit(1))).alias("missing_pct")) for k in KINDS]
    return wide.agg(F.array(*shares).alias("m")).select(F.explode("m").alias("m")).select("m.metric", F.round("m.missing_pct", 6).alias("missing_pct")).filter("missing_pct > 0")


@query(f"""
WITH {DAILY}, {NAIVE},
actual AS (SELECT day, 'ACTUAL' AS record_type, {", ".join(f"CAST(round(sum(value) FILTER (WHERE metric = '{k}'), 1) AS DOUBLE) AS {k}" for k in KINDS)} FROM daily WHERE day <= DATE '2024-01-24' GROUP BY day),
forecast AS (SELECT target_date AS day, 'FORECAST' AS record_type, {", ".join(f"max(predicted_value) FILTER (WHERE metric = '{k}') AS {k}" for k in KINDS)}
  FROM naive WHERE anchor = DATE '2024-01-25' GROUP BY 1)
SELECT * FROM actual UNION ALL SELECT * FROM forecast WHERE day NOT IN (SELECT day FROM actual)
""")
def i1_unified_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual days, then the pivoted forecasts of days that have no actuals yet."""
    days = daily(spark, sf_dir).filter("day <= date'2024-01-24'")
    sums = [F.round(F.sum(F.when(F.col("metric") == k, F.col("value"))), 1).cast("double").alias(k) for k in KINDS]
    actual = days.groupBy("day").agg(*sums)
    forecasts = naive(spark, sf_dir, "2024-01-25").withColumnRenamed("target_date", "day")
    return unified_timeline(actual, forecasts, "day", "metric", "predicted_value", KINDS)


@query("""
SELECT event_id, CAST(round(CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3)) AS DECIMAL(24,6)), 1) AS DOUBLE) AS minutes,
       CAST(round(CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(24,6)), 2) AS DOUBLE) AS km
FROM events
""")
def c6_unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit conversions with rounding, in decimals so that ties round alike everywhere."""
    to = lambda factor, digits: F.round((cents("value") * F.lit(factor).cast("decimal(4,3)")).cast("decimal(24,6)"), digits).cast("double")
    return table(spark, sf_dir, "events").select("event_id", to("0.125", 1).alias("minutes"), to("0.001", 2).alias("km"))


@query(f"""
WITH {DAILY}, spine AS (SELECT DISTINCT user_id FROM events),
days AS (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-16', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM spine),
p AS (SELECT user_id, day, count(*) AS kinds, max(CASE WHEN metric = 'click' THEN 1 ELSE 0 END) AS clicks, max(CASE WHEN metric = 'view' THEN 1 ELSE 0 END) AS views FROM daily GROUP BY 1, 2)
SELECT days.user_id, days.day, kinds IS NOT NULL AND kinds >= 3 AND clicks = 1 AND views = 1 AS ok,
  CASE WHEN kinds IS NULL THEN 'no data' WHEN kinds < 3 THEN 'missing files' WHEN clicks = 0 THEN 'no clicks' WHEN views = 0 THEN 'no views' ELSE 'complete' END AS reason
FROM days LEFT JOIN p ON p.user_id = days.user_id AND p.day = days.day
""")
def c11_day_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the last fifteen closed days of each user: complete or not, and why."""
    events = table(spark, sf_dir, "events")
    users = events.select("user_id").distinct()
    days = users.withColumn("day", F.explode(F.sequence(F.to_date(F.lit("2024-01-16")), F.to_date(F.lit("2024-01-30")))))
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    present = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_distinct("event_type").alias("kinds"), has("click").alias("clicks"), has("view").alias("views"))
    return completeness(days.join(present, ["user_id", "day"], "left"))


@query(f"""
WITH {NAIVE}
SELECT metric, target_date, predicted_value, datediff('day', DATE '2024-01-25', target_date) AS days_ahead,
  metric || ' in ' || datediff('day', DATE '2024-01-25', target_date) || ' days: ' || CASE WHEN predicted_value >= 50 THEN 'high' ELSE 'low' END AS sentence
FROM naive WHERE anchor = DATE '2024-01-25' AND metric NOT IN ('error') AND datediff('day', DATE '2024-01-25', target_date) BETWEEN 1 AND 5
""")
def m4_forecast_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast query tool: excluded metrics, a horizon, and a sentence per row."""
    ahead = F.datediff("target_date", F.lit("2024-01-25")).cast("bigint")
    rows = naive(spark, sf_dir, "2024-01-25").filter(~F.col("metric").isin("error")).withColumn("days_ahead", ahead).filter("days_ahead between 1 and 5")
    level = F.when(F.col("predicted_value") >= 50, "high").otherwise("low")
    return rows.select("metric", "target_date", "predicted_value", "days_ahead", F.concat("metric", F.lit(" in "), F.col("days_ahead").cast("string"), F.lit(" days: "), level).alias("sentence"))


@query("""
WITH p AS (SELECT o_orderpriority AS priority, o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT priority, o_orderdate, o_orderkey, o_totalprice FROM p WHERE rn <= 2
""")
def e16_head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two orders of each priority; the window's rank limit is pushed before the shuffle."""
    first = Window.partitionBy("priority").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_orderkey", "o_totalprice")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn <= 2").drop("rn")


@query(f"""
WITH {NAIVE}
SELECT count(DISTINCT metric) AS metrics, min(target_date) AS first_day, max(target_date) AS last_day, count(*) AS n FROM naive WHERE anchor = DATE '2024-01-25'
""")
def e17_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many metrics a forecast has, and from when to when."""
    return naive(spark, sf_dir, "2024-01-25").agg(F.count_distinct("metric").alias("metrics"), F.min("target_date").alias("first_day"), F.max("target_date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {DAILY}, d AS (SELECT day, metric, CAST(sum(value) AS BIGINT) AS v FROM daily GROUP BY 1, 2)
SELECT day, {", ".join(f"max(v) FILTER (WHERE metric = '{k}') AS {k}, max('[' || (v - 1) || ', ' || (v + 1) || ']') FILTER (WHERE metric = '{k}') AS {k}_interval" for k in KINDS)}
FROM d GROUP BY day
""")
def e18_wide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide summary per day: value and a formatted interval for each metric."""
    rounded = F.round(F.sum("value"), 0).cast("bigint")
    days = daily(spark, sf_dir).groupBy("day", "metric").agg(rounded.alias("v")).withColumn("i", F.format_string("[%d, %d]", F.col("v") - 1, F.col("v") + 1))
    of = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c)))
    return days.groupBy("day").agg(*[x for k in KINDS for x in (of(k, "v").alias(k), of(k, "i").alias(f"{k}_interval"))])


@query("SELECT list_sort(list_distinct(list(event_type))) AS metrics FROM events")
def e15_distinct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted set of metrics."""
    return table(spark, sf_dir, "events").agg(F.sort_array(F.collect_set("event_type")).alias("metrics"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def e13_count_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' ORDER BY ts, event_id")
def c1_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inclusive date range, ascending; both bounds reach the Parquet scan."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase' and ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-13'")
    return rows.select("user_id", "event_id", "ts", "value").orderBy("ts", "event_id")


@query(f"""
WITH {NAIVE}
SELECT target_date, metric, predicted_value FROM naive WHERE anchor = DATE '2024-01-25' AND target_date > (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type = 'signup')
""")
def c17_future_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows after the last actual day; the scalar is one row and is broadcast."""
    last = table(spark, sf_dir, "events").filter("event_type = 'signup'").agg(F.max(F.col("ts").cast("date")).alias("last_day"))
    return naive(spark, sf_dir, "2024-01-25").join(F.broadcast(last), F.col("target_date") > F.col("last_day")).drop("last_day")
