"""Queries of the store operators: upserts, locks, deletes, diffs, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import store
from pulselake.operators.consolidate import cents
from pulselake.plans.common import DAILY, NAIVE, daily, naive
from pulselake.plans.registry import query
from pulselake.session import table

LATEST = "row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) = 1"


@query("""
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20'
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10')
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def b1_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of a later batch over an earlier one (overlapping), last write wins."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    existing, batch = events.filter("ts < timestamp'2024-01-20'"), events.filter("ts >= timestamp'2024-01-10'")
    return store.merge_latest(existing.unionByName(batch), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
SELECT user_id, day, score, event_id FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts,
         coalesce(CAST(json_extract_string(props, '$.scores.overall') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT)) AS score
  FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
""")
def b2_upsert_json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of JSON payloads whose score lies on one of two paths."""
    path = lambda p: F.get_json_object("props", p).try_cast("bigint")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.coalesce(path("$.scores.overall"), path("$.k")).alias("score"), "event_id", "ts")
    return store.merge_latest(rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query("""
WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, day, chronological, fitness, CAST(round(CAST(chronological AS DECIMAL(18,2)) - CAST(fitness AS DECIMAL(18,2)), 2) AS DOUBLE) AS gap FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(k AS DOUBLE) AS chronological, value AS fitness, ts, event_id FROM k)
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
""")
def b6_upsert_derived_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert that derives the difference of two payload values, rounded to cents."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("day"), F.get_json_object("props", "$.k").try_cast("double").alias("chronological"), F.col("value").alias("fitness"), "ts", "event_id"
    )
    last = store.merge_latest(rows, ["user_id", "day"], ["ts", "event_id"])
    return last.select("user_id", "day", "chronological", "fitness", F.round(cents("chronological") - cents("fitness"), 2).cast("double").alias("gap"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value
FROM e GROUP BY user_id
""")
def b7_keep_old_when_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert in which a null does not overwrite the last known value."""
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return store.merge_keep_old(rows, ["user_id"], ["ts", "event_id"], ["value"])


@query("""
WITH f AS (
  SELECT event_id, CAST(ts AS DATE) AS target_date, event_type AS metric,
         coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE value END, CASE WHEN user_id < 100 THEN value / 2 END) AS predicted_value,
         CASE WHEN event_type = 'click' THEN value * 2 END AS hi
  FROM events)
SELECT target_date, metric, predicted_value, predicted_value AS ci_lower, coalesce(hi, predicted_value) AS ci_upper
FROM f WHERE predicted_value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY target_date, metric ORDER BY event_id DESC) = 1
""")
def b9_normalise_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast records with alternative names: coalesced, completed, incomplete ones dropped, last write wins."""
    value = F.col("value")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("target_date"),
        F.col("event_type").alias("metric"),
        F.coalesce(F.when(F.col("event_type") != "view", value), F.when(F.col("user_id") < 100, value / 2)).alias("predicted_value"),
        F.when(F.col("event_type") == "click", value * 2).alias("hi"),
    )
    complete = raw.filter("predicted_value is not null and target_date is not null")
    rows = complete.select("event_id", "target_date", "metric", "predicted_value", F.col("predicted_value").alias("ci_lower"), F.coalesce("hi", "predicted_value").alias("ci_upper"))
    return store.merge_latest(rows, ["target_date", "metric"], ["event_id"]).drop("event_id")


@query(f"""
WITH {NAIVE}
SELECT target_date, metric, predicted_value FROM naive WHERE anchor = DATE '2024-01-22'
UNION ALL
SELECT target_date, metric, predicted_value FROM naive n WHERE anchor = DATE '2024-01-25'
  AND NOT EXISTS (SELECT 1 FROM naive o WHERE o.anchor = DATE '2024-01-22' AND o.target_date = n.target_date AND o.metric = n.metric)
""")
def b10_lock_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts once written are locked; a later run only adds missing (date, metric) keys."""
    return store.lock_first_write(naive(spark, sf_dir, "2024-01-22"), naive(spark, sf_dir, "2024-01-25"), ["target_date", "metric"])


@query(f"""
WITH {NAIVE}
SELECT target_date, metric, predicted_value FROM naive WHERE anchor = DATE '2024-01-25'
UNION ALL
SELECT target_date, metric, predicted_value FROM naive n WHERE anchor = DATE '2024-01-22'
  AND NOT EXISTS (SELECT 1 FROM naive o WHERE o.anchor = DATE '2024-01-25' AND o.target_date = n.target_date AND o.metric = n.metric)
""")
def b10_force_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced run replaces its horizon."""
    return store.force_replace(naive(spark, sf_dir, "2024-01-22"), naive(spark, sf_dir, "2024-01-25"), ["target_date", "metric"])


@query(f"""
WITH {DAILY}
SELECT day, metric, count(*) AS rows_kept, CAST(sum(value) AS DOUBLE) AS value FROM daily
WHERE day IS NULL OR day < DATE '2024-01-21' GROUP BY day, metric
""")
def b13_delete_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a range delete leaves, per day and metric."""
    left = store.delete_from(daily(spark, sf_dir), "day", F.to_date(F.lit("2024-01-21")))
    return left.groupBy("day", "metric").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum("value").cast("double").alias("value"))


@query(f"""
WITH {DAILY}
SELECT metric, count(*) AS deleted FROM daily WHERE day >= DATE '2024-01-21' GROUP BY metric
""")
def b13_deleted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table a range delete removes."""
    return daily(spark, sf_dir).filter("day >= date'2024-01-21'").groupBy("metric").agg(F.count(F.lit(1)).alias("deleted"))


@query("""
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT day, CAST(v AS DOUBLE) AS value, n, src FROM (
  SELECT day, v, n, 'existing' AS src FROM l WHERE day NOT IN (SELECT day FROM o) UNION ALL SELECT day, v, n, 'extracted' FROM o)
WHERE day < DATE '2000-06-01'
""")
def b14_extract_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted days win over stored ones; days from the closing date on are left out."""
    def per_day(name: str, date: str, value: str, source: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows.groupBy(F.col(date).cast("date").alias("day")).agg(F.sum(cents(value)).cast("double").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("src", F.lit(source))

    stored, fresh = per_day("lineitem", "l_shipdate", "l_extendedprice", "existing"), per_day("orders", "o_orderdate", "o_totalprice", "extracted")
    return store.extract_precedence(stored, fresh, "day", F.to_date(F.lit("2000-06-01")))


_LEDGER = """
now AS (SELECT doc_id, sha256(text) AS digest, source FROM documents WHERE lang <> 'fr'),
old AS (SELECT doc_id, source, CASE WHEN n_chars < 400 THEN '' WHEN lang = 'de' THEN sha256(text || ' ') ELSE sha256(text) END AS digest
        FROM documents WHERE lang <> 'es')"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    digest = F.when(F.col("n_chars") < 400, "").when(F.col("lang") == "de", F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))
    now = docs.filter("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    return now, docs.filter("lang <> 'es'").select("doc_id", "source", digest.alias("digest"))


@query(f"""
WITH {_LEDGER}
SELECT coalesce(now.doc_id, old.doc_id) AS doc_id,
  CASE WHEN old.doc_id IS NULL THEN 'new' WHEN now.doc_id IS NULL THEN 'orphan' WHEN coalesce(old.digest, '') = '' THEN 'backfill'
       WHEN old.digest <> now.digest THEN 'changed' ELSE 'unchanged' END AS status
FROM now FULL OUTER JOIN old ON now.doc_id = old.doc_id
""")
def d10_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents of an index are new, changed, to be backfilled, unchanged or orphaned."""
    now, old = _versions(spark, sf_dir)
    return store.state_diff(now, old, "doc_id", "digest")


@query(f"""
WITH {_LEDGER}
SELECT old.source, old.doc_id, unnest(range(CAST(len(old.digest) // 16 AS BIGINT))) AS chunk
FROM old WHERE doc_id NOT IN (SELECT doc_id FROM now)
""")
def d11_orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of tracked documents that are no longer active."""
    now, old = _versions(spark, sf_dir)
    gone = old.join(now.select("doc_id"), "doc_id", "left_anti")
    last = (F.length("digest") / 16).cast("bigint") - 1
    return gone.filter(last >= 0).select("source", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))


@query(f"""
WITH {_LEDGER}
SELECT source, count(*) AS documents, CAST(sum(CASE WHEN digest = '' THEN 0 ELSE 4 END) AS BIGINT) AS chunks,
       CAST(sum(CASE WHEN digest IN (SELECT digest FROM now) THEN 1 ELSE 0 END) AS BIGINT) AS unchanged
FROM old GROUP BY source
""")
def b24_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger totals per source: documents, chunks, and those whose digest is still in use."""
    now, old = _versions(spark, sf_dir)
    used = now.select("digest").distinct().withColumn("used", F.lit(1))
    joined = old.join(used, "digest", "left")
    chunks = F.sum(F.when(F.col("digest") == "", 0).otherwise(4))
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), chunks.alias("chunks"), F.sum(F.coalesce("used", F.lit(0))).cast("bigint").alias("unchanged"))
