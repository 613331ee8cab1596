"""Queries of gates, sentences, rule factors, payload shapes, file sources and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.functions import fixed_values as fixed
from pulselake.functions import text as T
from pulselake.operators import forecast, retrieval, store, tools
from pulselake.operators.anomaly import impute
from pulselake.operators.consolidate import cents
from pulselake.plans.common import DAILY, NAIVE, daily, naive
from pulselake.plans.documents import _PLAIN, _quote
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources.tables import features_or_csv, read_or_empty, scratch, valid_binaries, whole_texts

_NORMAL = f"translate({_PLAIN}, '{fixed.LEET_SIGNS}', '{fixed.LEET_LETTERS}')"


@query(f"""
WITH c AS (SELECT [{", ".join(f"avg(CAST(embedding[{k}] AS DOUBLE))" for k in range(1, 65))}] AS center FROM embeddings),
s AS (SELECT doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) AS sim, {" OR ".join(f"contains({_NORMAL}, {_quote(t)})" for t in fixed.DOMAIN_TERMS)} AS lexical
  FROM documents JOIN embeddings ON vec_id = doc_id, c)
SELECT doc_id, coalesce(lexical, false) OR sim >= 0.52 AS in_domain, round(CASE WHEN lexical THEN greatest(sim, 0.7) ELSE sim END, 4) AS score,
  CASE WHEN lexical THEN 'lexicon_match' WHEN sim >= 0.52 THEN 'semantic_similarity' ELSE 'out_of_domain' END AS method FROM s
""")
def j11_domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain gate of texts with their vectors: a term of the lexicon, else similarity to the centroid."""
    vectors = table(spark, sf_dir, "embeddings")
    center = vectors.agg(F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(64)]).alias("center"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(F.broadcast(center))
    gate = retrieval.domain_gate(T.normalise_prefix(F.col("text")), retrieval.cosine(F.col("embedding"), F.col("center")))
    return rows.select("doc_id", *gate)


#: Metrics that the event kinds stand for.
_METRICS = {"click": "resting_heart_rate", "view": "hrv_rmssd", "purchase": "total_steps", "error": "sleep_score", "signup": "fitness_age"}
_METRIC_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in _METRICS.items()) + " END"
_FORECASTS = f"""{NAIVE},
f AS (SELECT {_METRIC_SQL} AS metric, target_date, CAST(predicted_value AS DECIMAL(18,2)) AS p, datediff('day', DATE '2024-01-25', target_date) AS ahead FROM naive WHERE anchor = DATE '2024-01-25')"""


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _METRICS.items() for x in pair])
    rows = naive(spark, sf_dir, "2024-01-25").select(names[F.col("metric")].alias("metric"), "target_date", cents("predicted_value").alias("predicted_value"))
    low, high = (F.col("predicted_value") - F.lit(1).cast("decimal(3,2)")).cast("decimal(18,2)"), (F.col("predicted_value") + F.lit(1).cast("decimal(3,2)")).cast("decimal(18,2)")
    return rows.select("*", low.alias("ci_lower"), high.alias("ci_upper"), F.lit("naive").alias("model_name"))


@query(f"""
WITH {_FORECASTS}, u AS (SELECT *, CASE metric {" ".join(f"WHEN '{m}' THEN '{u}'" for m, u in tools.UNITS.items())} ELSE '' END AS unit FROM f)
SELECT metric, target_date, ahead AS days_ahead, 'El pronóstico para dentro de ' || ahead || ' día(s) (' || strftime(target_date, '%Y-%m-%d') || ') de ' || metric || ' es de ' || CAST(p AS VARCHAR) || unit
  || ' (IC 95%: [' || CAST(CAST(p - 1.00 AS DECIMAL(18,2)) AS VARCHAR) || ' a ' || CAST(CAST(p + 1.00 AS DECIMAL(18,2)) AS VARCHAR) || ']' || unit || '), proyectado por naive.' AS statement
FROM u WHERE metric NOT IN ('fitness_age', 'fitness_age_gap', 'chronological_age') AND ahead BETWEEN 1 AND 5
""")
def j15_forecast_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast tool's sentences, with units, for the horizon of five days."""
    rows = tools.forecast_tool(_forecasts(spark, sf_dir), F.to_date(F.lit("2024-01-25")), 5)
    return rows.select("metric", "target_date", "days_ahead", "statement")


@query(f"""
WITH {_FORECASTS}, r(metric) AS (VALUES ('hrv_rmssd'), ('total_steps'), ('fitness_age'), ('spo2'))
SELECT r.metric, CASE WHEN r.metric IN ('fitness_age', 'fitness_age_gap', 'chronological_age') THEN 'error' WHEN count(f.metric) = 0 THEN 'empty' ELSE 'success' END AS status,
  CASE WHEN r.metric IN ('fitness_age', 'fitness_age_gap', 'chronological_age') THEN 0 ELSE count(CASE WHEN ahead BETWEEN 1 AND 5 THEN 1 END) END AS predictions
FROM r LEFT JOIN f ON f.metric = r.metric GROUP BY r.metric
""")
def m4_forecast_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of asking the forecast tool for some metrics: excluded ones are errors, unknown ones empty."""
    asked = spark.createDataFrame([("hrv_rmssd",), ("total_steps",), ("fitness_age",), ("spo2",)], "metric string")
    return tools.forecast_status(asked, _forecasts(spark, sf_dir), F.to_date(F.lit("2024-01-25")), 5)


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
SELECT user_id, day, k AS weekly, CASE WHEN event_type = 'view' THEN k ELSE NULL END AS baseline FROM p QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
""")
def b3_upsert_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of payloads that come in an envelope, bare, or as a list whose first element counts."""
    props = F.col("props")
    payload = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"hrvSummary":'), props, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), props, F.lit(',{"k":-1}]')))
        .otherwise(props)
    )
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", payload.alias("payload"))
    rows = rows.select("user_id", "day", "ts", "event_id", store.payload_field("payload", "hrvSummary", "k").try_cast("bigint").alias("weekly"), F.get_json_object("payload", "$[0].k").try_cast("bigint").alias("baseline"))
    return store.merge_latest(rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts", "event_id")


@query(f"""
WITH {DAILY}, w AS (SELECT DATE '2024-01-22' AS anchor_date, metric, CAST(sum(value) AS DOUBLE) / count(*) AS mean, count(*) AS days, 'second' AS run FROM daily WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' AND value > 0 GROUP BY metric
UNION ALL SELECT DATE '2024-01-15', metric, CAST(sum(value) AS DOUBLE) / count(*), count(*), 'first' FROM daily WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND value > 0 GROUP BY metric)
SELECT anchor_date, metric, mean, days, run FROM w
""")
def b12_replace_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's row of an anchor date is replaced when it is computed again; other anchors stay."""
    def week(anchor: str, run: str, last: int) -> DataFrame:
        day = F.to_date(F.lit(anchor))
        rows = daily(spark, sf_dir).filter(F.col("day").between(F.date_sub(day, 7), F.date_sub(day, last)) & (F.col("value") > 0))
        return rows.groupBy(day.alias("anchor_date"), "metric").agg((F.sum("value").cast("double") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("days"), F.lit(run).alias("run"))

    stored = week("2024-01-15", "first", 1).unionByName(week("2024-01-22", "first", 4))
    return store.force_replace(stored, week("2024-01-22", "second", 1), ["anchor_date", "metric"])


@query("""
WITH s AS (SELECT event_type AS metric, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
f AS (SELECT *, CASE WHEN mn >= 0 THEN least(greatest(0.0, mn * 0.8), greatest(0.0, mn - 0.5)) ELSE mn * 1.2 END AS floor FROM s),
b AS (SELECT metric, floor, greatest(mx * 1.25, floor + 5) AS cap FROM f)
SELECT event_id, round(least(greatest(value, floor + 0.1), cap - 0.1), 6) AS y FROM events JOIN b ON metric = event_type WHERE value IS NOT NULL
""")
def c18_training_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values clipped into the training domain, a tenth inside floor and cap."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    edges = forecast.bounds("value", ["metric"], events)
    rows = events.filter("value is not null").join(edges, "metric")
    return rows.select("event_id", F.round(forecast.clamp(F.col("value"), F.col("floor") + 0.1, F.col("cap") - 0.1), 6).alias("y"))


_SPORTS = {"running_avg_hr": "click", "gym_avg_hr": "purchase", "walking_avg_hr": "signup"}


@query("""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS activities, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS load, max(value) AS hardest FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
h AS (SELECT user_id, CAST(ts AS DATE) AS day, """ + ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{k}' AND value IS NOT NULL) AS {n}" for n, k in _SPORTS.items()) + """ FROM events GROUP BY 1, 2),
d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2)
SELECT d.user_id, d.day, errors, coalesce(activities, 0) AS activities, load, hardest, running_avg_hr, gym_avg_hr, walking_avg_hr
FROM d LEFT JOIN a ON a.user_id = d.user_id AND a.day = d.day LEFT JOIN h ON h.user_id = d.user_id AND h.day = d.day
""")
def d3_clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with the day's activities and the heart rate of the last activity of each sport, in one pass."""
    kind, value = F.col("event_type"), F.col("value")
    is_activity = kind != "error"
    sports = [F.max_by(F.when(kind == k, value), F.when((kind == k) & value.isNotNull(), F.col("event_id"))).alias(n) for n, k in _SPORTS.items()]
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.when(kind.isin("error", "view"), 1)).alias("errors"),
        F.count(F.when(is_activity, 1)).alias("activities"),
        F.sum(F.when(is_activity, cents("value"))).cast("double").alias("load"),
        F.max(F.when(is_activity, value)).alias("hardest"),
        *sports,
    )
    return rows.filter("errors > 0")


_FEATURES = ["click", "view"]


@query(f"""
WITH {DAILY}, m AS (SELECT user_id, day, {", ".join(f"CAST(sum(value) FILTER (WHERE metric = '{k}') AS DOUBLE) AS {k}" for k in _FEATURES)} FROM daily GROUP BY 1, 2),
q AS (SELECT {", ".join(f"quantile_cont({k}, 0.5) AS q_{k}" for k in _FEATURES)} FROM m)
SELECT user_id, day, {", ".join(f'''coalesce(last_value({k} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({k} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), q_{k}, 0) AS {k}''' for k in _FEATURES)} FROM m, q
""")
def g10_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each user's days: filled forward, backward, then by the median."""
    of = lambda k: F.sum(F.when(F.col("metric") == k, F.col("value"))).cast("double").alias(k)
    rows = daily(spark, sf_dir).groupBy("user_id", "day").agg(*map(of, _FEATURES))
    return impute(rows, _FEATURES, ["user_id"], "day").select("user_id", "day", *_FEATURES)


_RULED = {"hrv_rmssd": "click", "resting_heart_rate": "view", "daily_avg_stress": "error", "sleep_score": "purchase", "total_steps": "signup"}
_Z = "CAST(CAST(z_{0} AS DECIMAL(9,1)) AS VARCHAR)"
_ONE, _WHOLE = "CAST(CAST({0} AS DECIMAL(18,1)) AS VARCHAR)", "CAST(CAST({0} AS DECIMAL(18,0)) AS VARCHAR)"


@query(f"""
WITH {DAILY}, m AS (SELECT user_id, day, {", ".join(f"sum(value) FILTER (WHERE metric = '{k}') AS {m}" for m, k in _RULED.items())} FROM daily GROUP BY 1, 2),
z AS (SELECT *, {", ".join(f"(CAST({m} AS DOUBLE) - avg(CAST({m} AS DOUBLE)) OVER p) / (stddev_pop(CAST({m} AS DOUBLE)) OVER p + 1e-6) AS z_{m}" for m in _RULED)} FROM m WINDOW p AS (PARTITION BY user_id)),
f AS (SELECT user_id, day, list_filter([
  CASE WHEN z_hrv_rmssd < -1.5 THEN 'HRV significantly suppressed (' || {_ONE.format("hrv_rmssd")} || ' ms, Z=' || {_Z.format("hrv_rmssd")} || ')' END,
  CASE WHEN z_resting_heart_rate > 1.5 THEN 'Elevated Resting HR (' || {_WHOLE.format("resting_heart_rate")} || ' bpm, Z=+' || {_Z.format("resting_heart_rate")} || ')' END,
  CASE WHEN z_daily_avg_stress > 1.5 THEN 'High autonomic stress score (' || {_WHOLE.format("daily_avg_stress")} || ', Z=+' || {_Z.format("daily_avg_stress")} || ')' END,
  CASE WHEN z_sleep_score < -1.5 THEN 'Poor sleep restoration score (' || {_WHOLE.format("sleep_score")} || ', Z=' || {_Z.format("sleep_score")} || ')' END,
  CASE WHEN abs(z_total_steps) > 2 THEN 'Extreme activity ' || CASE WHEN z_total_steps > 0 THEN 'Spike' ELSE 'Drop' END || ' (' || {_WHOLE.format("total_steps")} || ' steps, Z=' || CASE WHEN z_total_steps > 0 THEN '+' ELSE '' END || {_Z.format("total_steps")} || ')' END],
  lambda x: x IS NOT NULL) AS factors FROM z)
SELECT user_id, day, array_to_string(factors, '; ') AS factors, CASE WHEN len(factors) >= 2 THEN 'ACUTE_ALERT' WHEN len(factors) = 1 THEN 'MILD_ANOMALY' ELSE 'NORMAL' END AS severity FROM f
""")
def g14_factor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules with their values and z-scores, and the severity that they add up to."""
    from pulselake.operators.anomaly import factor_texts, severity

    of = lambda m, k: F.sum(F.when(F.col("metric") == k, F.col("value"))).alias(m)
    rows = daily(spark, sf_dir).groupBy("user_id", "day").agg(*[of(m, k) for m, k in _RULED.items()])
    found = factor_texts(rows, ["user_id"])
    return found.select("user_id", "day", F.concat_ws("; ", "factors").alias("factors"), severity(F.size("factors"), F.lit(0)).alias("severity"))


@query("""
SELECT label, count(*) AS n, least(greatest(3 * 5, 10), count(*)) AS pool FROM embeddings GROUP BY label
""")
def h6_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a search for five takes from each label's vectors."""
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pool", retrieval.candidate_pool(5, F.col("n")))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SELECT CAST(14 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS views, CAST(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in _TABLES) + " AS BIGINT) AS total_rows")
def n2_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, views and rows of the whole collection."""
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n"), F.lit("table").alias("kind")) for t in _TABLES]
    every = reduce(DataFrame.unionByName, counts)
    return every.agg(F.count(F.when(F.col("kind") == "table", 1)).alias("tables"), F.count(F.when(F.col("kind") == "view", 1)).alias("views"), F.sum("n").alias("total_rows"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def a3_csv_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature file of which only the CSV is there, by a declared schema."""
    path = scratch(spark, "features")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderpriority")
    rows.write.option("header", True).csv(f"{path}.csv")
    return features_or_csv(spark, path, rows.schema).filter("o_orderpriority = '1-URGENT'")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a5_scan_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table and one that is not there, which reads as typed and empty."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = scratch(spark, "stored")
    rows.write.parquet(path)
    both = read_or_empty(spark, scratch(spark, "absent"), rows.schema).unionByName(read_or_empty(spark, path, rows.schema))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT CAST(n_nationkey AS INTEGER) AS key, regexp_replace(n_name, '^\s+|\s+$', '', 'g') AS text, sha256('  ' || n_name || chr(10)) AS sha256 FROM nation")
def a6_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read whole and stripped, with their digests."""
    path = scratch(spark, "texts")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("  "), "n_name").alias("value")).write.partitionBy("key").text(path)
    found = whole_texts(spark, path)
    return found.select(F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("key"), "text", "sha256")


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, n_nationkey % 3 = 0 AS valid FROM nation")
def a13_valid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which binary files begin as they should and are large enough."""
    path, key = scratch(spark, "binaries"), F.col("n_nationkey")
    body = F.when(key % 3 == 0, F.concat(F.lit("%PDF-"), F.repeat("n_name", 1024))).when(key % 3 == 1, F.lit("%PDF-1.4")).otherwise(F.repeat("n_name", 1024))
    table(spark, sf_dir, "nation").select(key.alias("key"), body.alias("value")).write.partitionBy("key").text(path)
    found = valid_binaries(spark, path)
    return found.select(F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("key"), "valid")
