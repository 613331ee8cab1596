"""Versioned tables and running streams, over the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import retrieval, vector_index
from pulselake.operators.consolidate import cents
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources import versioned
from pulselake.sources.tables import append, scratch
from pulselake.streaming import limits, repair

_TOTALS = """t AS (SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
c AS (SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events
  WHERE value < 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' GROUP BY 1, 2),
v2 AS (SELECT day, metric, coalesce(c.n, t.n) AS n, CASE WHEN c.day IS NULL THEN t.value ELSE c.value END AS value FROM t LEFT JOIN c USING (day, metric))"""


def _daily_versions(spark: SparkSession, sf_dir: str) -> str:
    """A daily table of four versions: empty, filled, three days corrected, the last days deleted."""
    events = table(spark, sf_dir, "events")
    totals = lambda rows, seq: rows.groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("value")).cast("double").alias("value"), F.lit(seq).alias("seq"))
    path = scratch(spark, "daily")
    versioned.create(spark, path, "day date, metric string, n long, value double, seq int", "day")
    versioned.append(totals(events, 1), path)
    fixed = events.filter("value < 50 and ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-13'")
    versioned.upsert(totals(fixed, 2), path, ["day", "metric"], ["seq"])
    versioned.delete_parts(spark, path, lambda day: day >= "2024-01-25" and day != versioned.NONE)
    return path


@query(f"""
WITH {_TOTALS} SELECT 0 AS version, day, metric, n, value FROM t WHERE false UNION ALL SELECT 1, * FROM t UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v2 WHERE day < DATE '2024-01-25'
""")
def b8_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of an upserted table, read after all changes."""
    path = _daily_versions(spark, sf_dir)
    one = lambda v: versioned.read(spark, path, v).select(F.lit(v).alias("version"), "day", "metric", "n", "value")
    return reduce(DataFrame.unionByName, [one(v) for v in versioned.versions(spark, path)])


@query(f"""
WITH {_TOTALS}, d AS (SELECT DISTINCT day FROM t), h AS (
  SELECT 1 AS version, 'append' AS action, day, true AS rewritten FROM d
  UNION ALL SELECT 2, 'upsert', day, day IN (SELECT day FROM c) FROM d
  UNION ALL SELECT 3, 'delete', day, day >= DATE '2024-01-25' FROM d)
SELECT version, action, CAST(day AS VARCHAR) AS part, rewritten FROM h
""")
def b8_partition_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which days' files each version has of its own: those of the incoming rows."""
    return versioned.history(spark, _daily_versions(spark, sf_dir))


_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Events land in runs of ten days; some come five days after they happened, some twenty.
_LANDED = """e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + CASE WHEN event_id % 40 = 7 THEN 20 WHEN event_id % 10 = 3 THEN 5 ELSE 0 END) / 10) AS INT) AS run FROM events),
m AS (SELECT run, max(max(day)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, max(max(ts)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 15 DAY AS mark FROM e GROUP BY run)"""


def _runs(spark: SparkSession, sf_dir: str, folder: str, longest: int = 20):
    """Lands the events run by run, those that come late up to ``longest`` days after they happened; yields after each."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    lag = F.when(F.col("event_id") % 40 == 7, longest).when(F.col("event_id") % 10 == 3, 5).otherwise(0)
    run = F.floor((F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01"))) + lag) / 10).cast("int")
    first, last = events.agg(F.min(run), F.max(run)).first()
    for k in range(first, last + 1) if first is not None else []:
        append(events.filter(run == k), folder)
        yield k


@query(f"""
WITH {_LANDED}, s AS (SELECT e.*, newest IS NOT NULL AND day < newest - 15 AS late FROM e JOIN m USING (run))
SELECT CASE WHEN late THEN 'late' ELSE 'daily' END AS side, day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY 1, 2, 3
""")
def l2_repair_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that repairs days of up to 15 days back, run after each landing; older rows go aside. The last batch comes twice."""
    base = scratch(spark, "repair")
    landing, daily, late, checkpoint = (f"{base}/{n}" for n in ("landing", "daily", "late", "checkpoint"))
    for _ in _runs(spark, sf_dir, landing):
        repair.repair_days(spark, landing, _EVENTS, daily, late, checkpoint)
    last = versioned.snapshot(spark, daily).batches["events"]
    repair.repairing_sink(daily, late, "events")(spark.read.schema(_EVENTS).parquet(landing), last)
    days = versioned.read(spark, daily).select(F.lit("daily").alias("side"), "day", "event_type", "n", F.col("total").cast("double").alias("total"))
    aside = versioned.read(spark, late).groupBy(F.lit("late").alias("side"), "day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).cast("double").alias("total"))
    return days.unionByName(aside)


@query(f"""
WITH {_LANDED}, w AS (SELECT max(ts) - INTERVAL 15 DAY AS final FROM e), s AS (SELECT e.* FROM e JOIN m USING (run) WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark)
SELECT day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s, w WHERE day + INTERVAL 1 DAY <= final GROUP BY 1, 2
""")
def l1_closed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a watermark of 15 days has closed, by a stream with state that is run after each landing."""
    base = scratch(spark, "closing")
    for _ in _runs(spark, sf_dir, f"{base}/landing"):
        repair.close_days(spark, f"{base}/landing", _EVENTS, f"{base}/closed", f"{base}/checkpoint")
    return versioned.read(spark, f"{base}/closed")


#: Limits that the events' few calls a user reach: one in six hours, two a day, six a week.
_LIMITS = (("quarter", 6 * 3600, 1), ("day", 86400, 2), ("week", 7 * 86400, 6))


@query("""
WITH c AS (SELECT user_id, list({'id': event_id, 'at': epoch_us(ts), 'took': 0::BIGINT, 'outcome': ''} ORDER BY ts, event_id) AS calls FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_transform(calls, lambda c: [c]), lambda done, next: list_append(done, struct_pack(id := next[1].id, at := next[1].at, took := 0::BIGINT, outcome :=
  CASE WHEN len(list_filter(done, lambda d: d.outcome = 'ok' AND d.at > next[1].at - 21600000000)) >= 1 THEN 'quarter'
    WHEN len(list_filter(done, lambda d: d.outcome = 'ok' AND d.at > next[1].at - 86400000000)) >= 2 THEN 'day'
    WHEN len(list_filter(done, lambda d: d.outcome = 'ok' AND d.at > next[1].at - 604800000000)) >= 6 THEN 'week' ELSE 'ok' END)), [calls[1]][1:0]) AS done FROM c)
SELECT user_id, unnest(done).id AS event_id, unnest(done).outcome AS outcome FROM f
""")
def l5_three_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls limited in three windows, by a stream with list state and timers that is run after each landing."""
    base = scratch(spark, "limits")
    out, landing = f"{base}/decided", f"{base}/landing"
    versioned.create(spark, out, "user_id long, event_id long, ts timestamp, outcome string", "outcome")

    def run() -> None:
        with limits.keyed_state(spark):
            decided = limits.limited_stream(repair.landed(spark, landing, _EVENTS), "user_id", _LIMITS, lateness="15 days")
            repair.catch_up(decided, f"{base}/checkpoint", repair.closing_sink(out, "limits"))

    for _ in _runs(spark, sf_dir, landing, longest=5):
        run()
    # a row of nobody, long after the others, lets the watermark pass them all
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 60 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("event_type", "string"), ("value", "double"), ("props", "string"))])
    append(last, landing)
    run()
    return versioned.read(spark, out).filter("event_id >= 0").select("user_id", "event_id", "outcome")


_ALIKE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


@query(f"""
SELECT query_id, id, round(s, 6) AS similarity, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, {_ALIKE} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_ALIKE}, 12) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c)
WHERE rank <= 4
""")
def a17_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest of every vector, from a stored index."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch(spark, "index")
    vector_index.build(vectors.select(F.col("vec_id").alias("id"), "embedding"), path, 64)
    found = vector_index.search(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), path, 4, 64)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


#: Filters that callers ask for, and the labels that they may see.
_ASKED = {"none": None, "one": {"label": 2}, "foreign": {"label": 9}, "some": {"label": {"$in": [1, 9]}}, "all foreign": {"label": {"$in": [8, 9]}}, "other": {"vec_id": {"$in": [3, 4, 5, 6, 7]}}}


@query("""
WITH a(asked, label, ids) AS (VALUES ('none', [1, 2, 3], NULL), ('one', [2], NULL), ('foreign', [1, 2, 3], NULL), ('some', [1], NULL), ('all foreign', [1, 2, 3], NULL), ('other', [1, 2, 3], [3, 4, 5, 6, 7]))
SELECT a.asked, vec_id, e.label FROM embeddings e JOIN a ON list_contains(a.label, e.label) AND (a.ids IS NULL OR list_contains(a.ids, vec_id))
""")
def c15_allowed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that filters may show, once they are kept within the allowed labels."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    one = lambda name: vectors.filter(retrieval.metadata_filter(retrieval.within(_ASKED[name], "label", [1, 2, 3]))).select(F.lit(name).alias("asked"), "vec_id", "label")
    return reduce(DataFrame.unionByName, [one(name) for name in _ASKED])
