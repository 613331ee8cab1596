"""Records of anomalies, forecasts and registries; defaults, checked seeds, formatted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.operators import records, retrieval, sft
from pulselake.operators.stats import z_score
from pulselake.operators.vector_index import settled
from pulselake.plans.common import DAILY, ORDERS, daily, order_series
from pulselake.plans.registry import oracle_of, query
from pulselake.session import table

_WIDE = f"""{DAILY}, m AS (SELECT user_id, day, CAST(sum(value) FILTER (WHERE metric = 'click') AS DOUBLE) AS click, CAST(sum(value) FILTER (WHERE metric = 'view') AS DOUBLE) AS view FROM daily GROUP BY 1, 2)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.sum(F.when(F.col("metric") == k, F.col("value"))).cast("double").alias(k)
    return daily(spark, sf_dir).groupBy("user_id", "day").agg(*[of(k) for k in ("click", "view", "error", "purchase", "signup")])


@query(f"""
WITH {_WIDE}, z AS (SELECT *, (click - avg(click) OVER u) / (stddev_pop(click) OVER u + 1e-6) AS zc, (view - avg(view) OVER u) / (stddev_pop(view) OVER u + 1e-6) AS zv FROM m WINDOW u AS (PARTITION BY user_id)),
s AS (SELECT *, CASE WHEN zc < -1 THEN 1 ELSE 0 END + CASE WHEN zv > 1 THEN 1 ELSE 0 END AS k FROM z)
SELECT user_id, day, k > 0 AS is_anomaly, CASE k WHEN 2 THEN 'ACUTE_ALERT' WHEN 1 THEN 'MILD_ANOMALY' ELSE 'NORMAL' END AS severity, round(zc, 4) AS isolation_forest_score, round(zv, 4) AS lof_score,
  concat_ws('; ', CASE WHEN zc < -1 THEN 'few clicks' END, CASE WHEN zv > 1 THEN 'many views' END) AS contributing_factors, round(click, 2) AS click, round(view, 2) AS view FROM s
""")
def g16_anomaly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly records of each user's days, with rounded scores and a rounded map of metrics."""
    rows = _wide(spark, sf_dir).withColumn("zc", z_score("click", ["user_id"])).withColumn("zv", z_score("view", ["user_id"]))
    low, high = F.coalesce(F.col("zc") < -1, F.lit(False)), F.coalesce(F.col("zv") > 1, F.lit(False))
    count = low.cast("int") + high.cast("int")
    rows = rows.withColumn("severity", F.when(count == 2, "ACUTE_ALERT").when(count == 1, "MILD_ANOMALY").otherwise("NORMAL"))
    rows = rows.withColumn("factors", F.concat_ws("; ", F.when(low, "few clicks"), F.when(high, "many views")))
    found = records.anomaly_records(rows, ["user_id", "day"], "zc", "zv", ["click", "view"])
    return found.select("*", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in ("click", "view")]).drop("metrics")


@query(f"""
WITH {ORDERS}, f AS (SELECT priority, day, CAST(value AS DOUBLE) AS y, CAST(lag(value, 7) OVER (PARTITION BY priority ORDER BY day) AS DOUBLE) AS yhat FROM series),
k AS (SELECT * FROM f WHERE yhat IS NOT NULL), t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY priority ORDER BY day DESC) <= 7)
SELECT k.priority, 'seasonal' AS model, round(avg(abs(y - yhat)), 4) AS mae, max(first_day) AS first_day, max(last_day) AS last_day, max(rows) AS rows, max(last_yhat) AS last_yhat
FROM k JOIN (SELECT priority, min(day) AS first_day, max(day) AS last_day, count(*) AS rows, arg_max(yhat, day) AS last_yhat FROM t GROUP BY 1) s ON s.priority = k.priority GROUP BY k.priority
""")
def g31_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary record of each series' forecast: rounded error and the last seven rows."""
    from pyspark.sql import Window

    rows = order_series(spark, sf_dir).withColumn("yhat", F.lag(F.col("value"), 7).over(Window.partitionBy("priority").orderBy("day")).cast("double")).filter("yhat is not null")
    found = records.forecast_summaries(rows.withColumn("y", F.col("value").cast("double")), "priority", "day", ["yhat"], {"mae": F.avg(F.abs(F.col("y") - F.col("yhat")))}, "seasonal")
    sample = F.col("forecast_sample")
    last = F.try_element_at(sample, F.lit(-1))
    return found.select("priority", "model", "metrics.mae", F.get(sample, F.lit(0))["day"].alias("first_day"), last["day"].alias("last_day"), F.size(sample).cast("bigint").alias("rows"), last["yhat"].alias("last_yhat"))


@query("""
SELECT 'events' AS name, '{"imputation_strategy":"fill","domain_baselines":{"value":58.0},"feature_count":3,"features":["user_id","day","value"],"total_rows":' || count(*) || ',"last_calendar_date":"' || max(CAST(ts AS DATE)) || '"}' AS metadata FROM events
""")
def g30_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON record of a stored table."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return records.registry_record(rows, "events", "fill", {"value": 58.0}, "day")


_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a{more}, {d})"


@query(f"""
WITH {DAILY}, m AS (SELECT user_id, day, {", ".join(f"CAST(sum(value) FILTER (WHERE metric = '{k}') AS DOUBLE) AS {k}" for k in ("click", "view", "error", "purchase", "signup"))} FROM daily GROUP BY 1, 2)
SELECT user_id, day, {_FILL.format(c="click", d=58.0, more="")} AS resting_heart_rate, coalesce(view, 5000.0) AS total_steps, coalesce(error, 300.0) AS active_kilocalories, coalesce(signup, 2100.0) AS total_kilocalories,
  round({_FILL.format(c="purchase", d=145.0, more=", avg(purchase) OVER w")}, 1) AS running_avg_hr, 110.0 AS gym_avg_hr, 115.0 AS walking_avg_hr, 55.0 AS hrv_rmssd, 25.0 AS daily_avg_stress, 80.0 AS sleep_score, 40.0 AS chronological_age, 34.8 AS fitness_age,
  34.5 AS achievable_fitness_age, 16.6 AS body_fat_pct, 35.0 AS vigorous_minutes_avg, greatest(coalesce(signup, 2100.0) - coalesce(error, 300.0), 800.0) AS resting_kilocalories
FROM m WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), w AS (PARTITION BY user_id)
""".replace("110.0 AS", "110.0::DOUBLE AS").replace("115.0 AS", "115.0::DOUBLE AS").replace("55.0 AS", "55.0::DOUBLE AS").replace("25.0 AS", "25.0::DOUBLE AS").replace("80.0 AS sl", "80.0::DOUBLE AS sl").replace("40.0 AS", "40.0::DOUBLE AS").replace("34.8 AS", "34.8::DOUBLE AS").replace("34.5 AS", "34.5::DOUBLE AS").replace("16.6 AS", "16.6::DOUBLE AS").replace("35.0 AS", "35.0::DOUBLE AS"))
def g29_all_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics without gaps: filled within a user, then by the domain's defaults; five of them have values here."""
    names = {"click": "resting_heart_rate", "view": "total_steps", "error": "active_kilocalories", "purchase": "running_avg_hr", "signup": "total_kilocalories"}
    rows = _wide(spark, sf_dir).withColumnsRenamed(names)
    absent = [m for m in (records.FILLED | records.PLAIN | records.OBSERVED) if m not in rows.columns]
    return records.with_defaults(rows.withColumns({m: F.lit(None).cast("double") for m in absent}), ["user_id"], "day")


@query("""
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'es' END AS lang FROM conversations GROUP BY 1),
h AS (SELECT *, CASE lang WHEN 'en' THEN ['### 1. Quick Diagnosis', '### 2. Physiological Breakdown', '### 3. Today''s Work'] ELSE ['### 1. El Diagnóstico Rápido', '### 2. La Explicación Fisiológica', '### 3. La Chamba de Hoy'] END AS heads FROM c)
SELECT conv_id, array_to_string(list_concat(CASE WHEN len(roles) <> 3 THEN ['turn count'] ELSE [] END, CASE WHEN roles <> ['system', 'user', 'assistant'] THEN ['role order'] ELSE [] END,
  list_transform(list_filter(heads, lambda s: NOT coalesce(contains(texts[3], s), false)), lambda s: 'missing ' || s)), '; ') AS violations FROM h
""")
def o6_seed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each conversation from being a seed."""
    rows = sft.conversations(table(spark, sf_dir, "conversations"))
    language = F.when(F.col("conv_id") % 2 == 0, "en").otherwise("es")
    return rows.select("conv_id", F.concat_ws("; ", records.seed_violations(F.col("messages"), language)).alias("violations"))


@query("""
WITH c AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND turn > 1) AS said, arg_max(text, turn) AS last, arg_min(text, turn) AS first FROM conversations GROUP BY 1),
r AS (SELECT conv_id % 4 AS batch, coalesce(said, CASE WHEN conv_id % 2 = 0 THEN last END, first) AS response FROM c)
SELECT batch, count(*) AS n, round(100.0 * count(*) FILTER (WHERE length(response) >= 300) / count(*), 2) AS long_pct, round(100.0 * count(*) FILTER (WHERE regexp_matches(response, '[.!?]$')) / count(*), 2) AS ended_pct FROM r GROUP BY 1
""")
def o5_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates of batches of responses: the first answer behind the second turn, else the response, else the content."""
    turns = table(spark, sf_dir, "conversations")
    late = sft.conversations(turns.filter("turn > 1"))
    ends = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"))
    rows = ends.join(late, "conv_id", "left")
    response = records.response_of(F.col("messages"), F.when(F.col("conv_id") % 2 == 0, F.col("last")), F.col("first"))
    rate = lambda ok: F.round(F.count_if(ok) * 100.0 / F.count(F.lit(1)), 2)
    scored = rows.select((F.col("conv_id") % 4).alias("batch"), response.alias("response"))
    return scored.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), rate(F.length("response") >= 300).alias("long_pct"), rate(F.col("response").rlike("[.!?]$")).alias("ended_pct"))


@query("""
WITH r AS (SELECT source, doc_id, text, n_chars / 1000.0 AS d, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents)
SELECT source, string_agg('[Documento ' || place || ': doc' || doc_id || ' | Fuente: ' || source || ' | Distancia Coseno: ' || printf('%.4f', d::DOUBLE) || ' | Rerank Score: ' || printf('%.5f', (place / 8)::DOUBLE) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context
FROM r WHERE place <= 3 GROUP BY source
""")
def j14_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that cites the three shortest documents of each source."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text", (F.col("n_chars") / 1000).alias("d"), place.alias("place")).filter("place <= 3")
    block = records.context_block(F.col("place"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("source"), F.col("d"), F.col("place") / 8, F.col("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("block")))), lambda b: b["block"])
    return rows.groupBy("source").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


_REACHED = f"""s AS ({oracle_of("m7_ask_cascade")}), c AS (SELECT list({{'id': item_id, 'at': item_id * 60, 'outcome': ''}} ORDER BY item_id) AS calls FROM s WHERE status IN ('success', 'no_matching_evidence')),
f AS (SELECT list_reduce(list_transform(calls, lambda c: [c]), lambda done, next: list_append(done, struct_pack(id := next[1].id, at := next[1].at, outcome :=
  CASE WHEN len(list_filter(done, lambda d: d.outcome = 'ok' AND d.at > next[1].at - 3600)) >= 12 THEN 'hour' WHEN len(list_filter(done, lambda d: d.outcome = 'ok' AND d.at > next[1].at - 86400)) >= 20 THEN 'day' ELSE 'ok' END)), [calls[1]][1:0]) AS done FROM c WHERE len(calls) > 0),
b AS (SELECT unnest(done).id AS item_id, unnest(done).outcome AS outcome FROM f)"""


@query(f"WITH {_REACHED} SELECT s.item_id, CASE WHEN b.outcome <> 'ok' THEN 'budget_exceeded' ELSE s.status END AS status, coalesce(b.outcome, 'not asked') AS budget FROM s LEFT JOIN b USING (item_id)")
def m7_budgeted_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over every benchmark question, one a minute: only questions that pass all checks before it use up the budget."""
    from pulselake.plans.documents import m7_ask_cascade

    checked = settled(m7_ask_cascade(spark, sf_dir), "asked")
    return retrieval.within_budget(checked, "item_id", F.timestamp_seconds(F.col("item_id") * 60), limits=(("hour", 3600, 12), ("day", 86400, 20)), stored=1)
