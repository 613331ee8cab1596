"""Further lines of the inventory: predicates, joins, diagnostics, catalog, training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulselake.functions import text as T
from pulselake.operators import causality, forecast, records, sft, store, windows
from pulselake.operators.consolidate import pivot_metrics
from pulselake.operators.quantiles import exact_quantiles
from pulselake.plans.common import DAILY, KINDS, NAIVE, ORDERS, daily, naive, order_series
from pulselake.plans.documents import _LABELS_SQL, label_chunks
from pulselake.plans.registry import query
from pulselake.plans.series import DENSE, PAIRED, dense, paired
from pulselake.session import table
from pulselake.sources.tables import append, scratch


@query("""
SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 200 AND source NOT IN ('src1', 'src2') AND text IS NOT NULL
""")
def c7_in_and_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by literal sets and half ranges, pushed to the scan."""
    return table(spark, sf_dir, "documents").filter("lang in ('en', 'de') and n_chars >= 200 and source not in ('src1', 'src2') and text is not null").select("doc_id", "n_chars")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 77")
def c3_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by key."""
    return table(spark, sf_dir, "events").filter("event_id = 77").select("event_id", "user_id", "event_type", "value")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) GROUP BY 1, 2
""")
def c9_not_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of keys that a subquery does not have, as an anti join."""
    events = table(spark, sf_dir, "events")
    bad = events.filter("event_type = 'error' and value > 90").select("user_id").distinct()
    return events.join(bad, "user_id", "left_anti").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DAILY} SELECT user_id, day, metric, CAST(value AS DOUBLE) AS value FROM daily WHERE day < DATE '2024-01-30'")
def c10_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only days that are closed at a given date."""
    return daily(spark, sf_dir).filter("day < date'2024-01-30'").select("user_id", "day", "metric", F.col("value").cast("double").alias("value"))


@query(f"""
WITH {ORDERS}, q AS (SELECT priority, quantile_cont(CAST(value AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(value AS DOUBLE), 0.75) AS q3 FROM series GROUP BY 1),
f AS (SELECT s.priority, s.day, CAST(s.value AS DOUBLE) AS value, CAST(s.value AS DOUBLE) < q1 - 2.5 * (q3 - q1) OR CAST(s.value AS DOUBLE) > q3 + 2.5 * (q3 - q1) AS odd FROM series s JOIN q ON q.priority = s.priority),
c AS (SELECT *, count(*) FILTER (WHERE odd) OVER (PARTITION BY priority) AS k, count(*) OVER (PARTITION BY priority) AS n FROM f)
SELECT priority, day, CASE WHEN odd AND k > 0 AND 2 * k < n THEN NULL ELSE value END AS value FROM c
""")
def c12_anomaly_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged values become null, unless half of the series is flagged."""
    rows = order_series(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    q = exact_quantiles(rows, "value", ["priority"], [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    odd = (F.col("value") < F.col("q")[0] - 2.5 * iqr) | (F.col("value") > F.col("q")[1] + 2.5 * iqr)
    w = Window.partitionBy("priority")
    flagged = rows.join(q, "priority").withColumn("odd", odd).withColumn("k", F.count(F.when(F.col("odd"), 1)).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return flagged.select("priority", "day", F.when(~(F.col("odd") & (F.col("k") > 0) & (2 * F.col("k") < F.col("n"))), F.col("value")).alias("value"))


@query("SELECT event_id, CASE WHEN value BETWEEN 15 AND 35 THEN 'normal' WHEN value < 15 THEN 'low' ELSE 'high' END AS band FROM events")
def c14_band_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of the band that a value lies in."""
    band = F.when(F.col("value").between(15, 35), "normal").when(F.col("value") < 15, "low").otherwise("high")
    return table(spark, sf_dir, "events").select("event_id", band.alias("band"))


@query("SELECT coalesce(role, 'unknown') AS role, count(*) AS n FROM (SELECT CASE WHEN turn > 4 THEN NULL ELSE role END AS role FROM conversations) GROUP BY 1")
def c16_default_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a default for missing labels."""
    role = F.coalesce(F.when(F.col("turn") <= 4, F.col("role")), F.lit("unknown"))
    return table(spark, sf_dir, "conversations").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {NAIVE}
SELECT target_date, {", ".join(f"max(predicted_value) FILTER (WHERE metric = '{k}') AS {k}" for k in KINDS)} FROM naive WHERE anchor = DATE '2024-01-22' GROUP BY 1
""")
def d4_pivot_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long forecasts to one row per date in one pass."""
    return pivot_metrics(naive(spark, sf_dir, "2024-01-22"), "target_date", "metric", "predicted_value", KINDS)


@query(f"""
WITH {NAIVE}
SELECT a.target_date, a.metric, 0.5 * a.predicted_value + 0.5 * b.predicted_value AS predicted FROM naive a JOIN naive b ON a.target_date = b.target_date AND a.metric = b.metric
WHERE a.anchor = DATE '2024-01-22' AND b.anchor = DATE '2024-01-25'
""")
def d6_merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts merged where both have a value, with equal weights."""
    keys = ["target_date", "metric"]
    a, b = (naive(spark, sf_dir, day).withColumnRenamed("predicted_value", name) for day, name in (("2024-01-22", "one"), ("2024-01-25", "two")))
    return a.join(b, keys).select(*keys, (0.5 * F.col("one") + 0.5 * F.col("two")).alias("predicted"))


@query("SELECT d.lang, l.quality, l.toxic, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL")
def d7_labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to documents, aggregated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars").cast("double") / F.count(F.lit(1))).alias("mean_chars"))


@query("""
WITH a AS (SELECT conv_id, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS words, contains(text, '.') AS dotted FROM conversations WHERE role = 'assistant' AND trim(text) <> '')
SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE dotted) / count(*), 2) AS dotted_pct, round(CAST(sum(words * 133 // 100) AS DOUBLE) / count(*), 1) AS mean_tokens FROM a
""")
def e12_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of answers that pass, in percent, and mean length."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''")
    _, tokens = T.approximate_tokens(F.col("text"))
    n = F.count(F.lit(1))
    passed = F.count(F.when(F.contains("text", F.lit(".")), 1))
    return rows.agg(n.alias("n"), F.round(passed * F.lit(100.0) / n, 2).alias("dotted_pct"), F.round(F.sum(tokens).cast("double") / n, 1).alias("mean_tokens"))


@query(f"""
WITH {DENSE}, z AS (SELECT user_id, day, coalesce(value, 0) AS zero, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM dense)
SELECT user_id, day, zero, held FROM z
""")
def g28_imputations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero fill and forward fill side by side."""
    rows = dense(spark, sf_dir)
    return rows.select("user_id", "day", F.coalesce("value", F.lit(0.0)).alias("zero"), F.coalesce(windows.forward_fill("value", ["user_id"], "day"), F.lit(0.0)).alias("held"))


def _bounds_sql() -> str:
    rules, kinds = forecast.BOUND_RULES, list(forecast.BOUND_RULES)
    names = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(kinds))
    case = lambda i, other: "CASE " + " ".join(f"WHEN metric = '{m}' THEN CAST({r[i]} AS DOUBLE)" for m, r in rules.items() if r[i] is not None) + f" ELSE {other} END"
    gap = "CASE " + " ".join(f"WHEN metric = '{m}' THEN {r[2]}" for m, r in rules.items() if r[2]) + " ELSE 0 END"
    return f"""
WITH v AS (SELECT CASE o_custkey % 15 {names} ELSE 'other' END AS metric, o_totalprice / 1000 AS value FROM orders),
s AS (SELECT metric, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q9, avg(value) AS mu, stddev_pop(value) AS sd FROM v GROUP BY 1),
f AS (SELECT *, {case(0, "CASE WHEN mn >= 0 THEN least(greatest(0, mn * 0.8), greatest(0, mn - 0.5)) ELSE mn * 1.2 END")} AS floor FROM s),
c AS (SELECT *, {case(1, "greatest(mx * 1.25, floor + 5)")} AS cap0 FROM f)
SELECT metric, round(floor, 4) AS floor, round(CASE WHEN cap0 - floor < {gap} THEN {case(3, "cap0")} ELSE cap0 END, 4) AS cap FROM c"""


@query(_bounds_sql())
def g17_metric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric's own bounds rule; customers play the metrics."""
    kinds = [*forecast.BOUND_RULES, "other"]
    metric = F.array(*map(F.lit, kinds))[(F.col("o_custkey") % 15).cast("int")]
    rows = table(spark, sf_dir, "orders").select(metric.alias("metric"), (F.col("o_totalprice") / 1000).alias("value"))
    return forecast.metric_bounds(rows, "metric", "value").select("metric", F.round("floor", 4).alias("floor"), F.round("cap", 4).alias("cap"))


@query(None)
def g6_granger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granger tests both ways at lags up to 2 per return flag, with p-values and sentences."""
    return causality.granger_audit(paired(spark, sf_dir), [("price", "shipped"), ("shipped", "price"), ("absent", "price")], "flag", "day")


@query(None)
def g7_stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Augmented Dickey-Fuller test of each series."""
    return causality.stationarity(order_series(spark, sf_dir), "priority", "day", "value")


@query(f"""
WITH RECURSIVE {ORDERS}, y AS (SELECT priority, CAST(value AS DOUBLE) AS y, row_number() OVER (PARTITION BY priority ORDER BY day) AS i FROM series),
s AS (SELECT priority, i, y AS level, 0.0::DOUBLE AS trend FROM y WHERE i = 1 UNION ALL
  SELECT y.priority, y.i, 0.3 * y.y + 0.7 * (s.level + 0.9 * s.trend), 0.1 * (0.3 * y.y + 0.7 * (s.level + 0.9 * s.trend) - s.level) + 0.9 * 0.9 * s.trend FROM s JOIN y ON y.priority = s.priority AND y.i = s.i + 1)
SELECT priority, i AS n, round(level + 0.9 * trend, 4) AS next_value FROM s
""")
def g19_ets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damped one-step forecast after every row of a series, at fixed weights, to its last row."""
    steps = forecast.damped_steps(order_series(spark, sf_dir), "priority", "day", "value", 0.3, 0.1, 0.9)
    return steps.withColumn("next_value", F.round("next_value", 4))


@query("""
SELECT event_id, CASE WHEN value IS NULL THEN 'NULL' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.4g', value) END AS shown, printf('%.4g', value / 70000) AS small, printf('%.4g', value * 1234.567) AS large,
  '<BLOB ' || octet_length(encode(props)) || 'B: 0x' || lower(hex(encode(props)[1:4])) || '...>' AS blob,
  CASE WHEN length(replace(trim(props), chr(10), ' ')) > 42 THEN '''' || substr(replace(trim(props), chr(10), ' '), 1, 39) || '...''' ELSE '''' || replace(trim(props), chr(10), ' ') || '''' END AS quoted FROM events
""")
def j16_sample_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample values as text: whole numbers without decimals, long strings cut and quoted."""
    v = F.col("value")
    text = F.translate(F.trim("props"), "\n", " ")
    quoted = F.when(F.length(text) > 42, F.concat(F.lit("'"), F.substring(text, 1, 39), F.lit("...'"))).otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    number = lambda x, name: records.sample_number(x).alias(name)
    shown = [number(v, "shown"), number(v / 70_000, "small"), number(v * 1234.567, "large"), records.sample_binary(F.col("props").cast("binary")).alias("blob")]
    return table(spark, sf_dir, "events").select("event_id", *shown, quoted.alias("quoted"))


@query(r"""
WITH f AS (SELECT conv_id, turn, '```json' || chr(10) || '{"a": "' || role || CASE WHEN turn = 1 THEN '' ELSE '"}' END || chr(10) || '```' AS raw FROM conversations)
SELECT conv_id, turn, json_extract_string(CASE WHEN turn = 1 THEN s || '"}' ELSE s END, '$.a') AS a FROM (SELECT *, regexp_replace(regexp_replace(raw, '^```(?:json)?\s*', ''), '\s*```$', '') AS s FROM f)
""")
def j18_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced and truncated JSON is stripped, closed and parsed."""
    cut = F.when(F.col("turn") == 1, F.lit("")).otherwise(F.lit('"}'))
    raw = F.concat(F.lit('```json\n{"a": "'), F.col("role"), cut, F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get_json_object(T.repaired_json(raw), "$.a").alias("a"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def j19_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content fingerprints."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso, CAST(CAST(ts AS DATE) + 7 AS DATE) AS plus_week, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_number, substr(strftime(ts, '%Y-%m-%dT%H'), 1, 10) AS prefix FROM events
""")
def k1_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date formatting and arithmetic."""
    ts, day = F.col("ts"), F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd").alias("iso"), F.date_add(day, 7).alias("plus_week"), F.datediff(day, F.lit("2024-01-01")).cast("bigint").alias("day_number"), F.substring(F.date_format(ts, "yyyy-MM-dd'T'HH"), 1, 10).alias("prefix")
    )


@query("SELECT user_id, CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY user_id")
def k2_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a user's first and last."""
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.explode(F.sequence(F.min(day), F.max(day))).alias("day"))


@query("""
SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}')[1:3] AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS distinct_words FROM documents
""")
def k6_arrays_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array functions over all words of a document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(words, 1, 3).alias("words"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct_words"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent, TRY_CAST(json_extract_string(props, '$.k') || CASE WHEN event_id > 50 THEN 'x' ELSE '' END AS DOUBLE) AS coerced FROM events")
def k8_json_and_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON paths, absent ones too, and casts that give null where they fail."""
    k = F.get_json_object("props", "$.k")
    broken = F.concat(k, F.when(F.col("event_id") > 50, "x").otherwise("")).try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", k.cast("bigint").alias("k"), F.get_json_object("props", "$.absent").alias("absent"), broken.alias("coerced"))


@query("""
SELECT source AS src, lang, CAST(n_chars AS VARCHAR) AS n, 'chunk' AS doc_type, doc_id FROM documents WHERE lang = 'en'
UNION ALL SELECT source, lang, CAST(n_chars AS VARCHAR), 'chunk', doc_id FROM documents WHERE lang = 'de'
""")
def a8_chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk tables of several sources, with JSON metadata parsed; bad JSON gives the default."""
    docs = table(spark, sf_dir, "documents")
    parts = [docs.filter(F.col("lang") == k).select("doc_id", "source", F.to_json(F.struct("lang", "n_chars")).alias("metadata_json")) for k in ("en", "de")]
    rows = reduce(DataFrame.unionByName, parts)
    meta = F.from_json("metadata_json", "lang string, n_chars long")
    return rows.select(F.col("source").alias("src"), meta["lang"].alias("lang"), meta["n_chars"].cast("string").alias("n"), F.lit("chunk").alias("doc_type"), "doc_id")


@query("SELECT 1 AS run_id, count(*) AS n_rows, 'day' AS kind FROM events UNION ALL SELECT 2, count(*), 'order' FROM orders")
def b11_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only run log whose ids go on from the greatest one."""
    path = scratch(spark, "runs")
    for name, kind in (("events", "day"), ("orders", "order")):
        count = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n_rows"))
        last = 0 if kind == "day" else spark.read.parquet(path).agg(F.max("run_id")).first()[0]
        append(count.select(F.lit(last + 1).cast("int").alias("run_id"), "n_rows", F.lit(kind).alias("kind")), path)
    return spark.read.parquet(path)


@query("SELECT conv_id, turn, role FROM conversations")
def b15_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export to CSV and back with a declared schema."""
    path = scratch(spark, "csv")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT source, doc_id, n_chars FROM documents WHERE source = 'src3'")
def b16_partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by source; the read prunes to one partition."""
    path = scratch(spark, "by-source")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rows.repartition("source").write.option("compression", "snappy").partitionBy("source").parquet(path)
    return spark.read.parquet(path).filter("source = 'src3'").select("source", "doc_id", "n_chars")


@query("""
SELECT vec_id AS id, CASE WHEN label IN (3, 4) THEN 'new' ELSE 'old' END AS version, label FROM embeddings WHERE label <> 5
""")
def b18_vector_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors upserted by id after a length check, and some deleted."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", F.lit("old").alias("version"), F.lit(0).alias("seq"))
    fresh = stored.filter("label in (3, 4)").withColumn("version", F.lit("new")).withColumn("seq", F.lit(1)).filter(F.size("embedding") == 64)
    merged = store.merge_latest(stored.select("id", "label", "version", "seq").unionByName(fresh.select("id", "label", "version", "seq")), ["id"], ["seq"])
    gone = stored.filter("label = 5").select("id")
    return merged.join(gone, "id", "left_anti").select("id", "version", "label")


@query(_LABELS_SQL)
def e11_label_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label combinations per source, ranked."""
    return label_chunks(spark, sf_dir)


@query("""
SELECT lang, source, n, bar FROM (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bar, row_number() OVER (PARTITION BY lang ORDER BY sum(n_chars) DESC, source) AS r FROM documents GROUP BY 1, 2) WHERE r <= 3
""")
def h3_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest sources of each language."""
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bar"))
    best = Window.partitionBy("lang").orderBy(F.desc("bar"), "source")
    return rows.withColumn("r", F.row_number().over(best)).filter("r <= 3").drop("r")


@query("""
SELECT conv_id AS id, 'general' AS metric_category, 'es' AS language, list(role || ': ' || text ORDER BY turn) AS lines, string_agg('<|' || role || '|>' || text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def o4_chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with the conversation rendered by a template."""
    rows = sft.conversations(table(spark, sf_dir, "conversations"))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    text = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"])), "")
    return rows.select(F.col("conv_id").alias("id"), F.lit("general").alias("metric_category"), F.lit("es").alias("language"), line.alias("lines"), text.alias("text"))


@query("""
WITH p AS (SELECT lang, role, k FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT role FROM conversations), range(14) r(k))
SELECT lang, role, CAST(k AS INTEGER) AS k, row_number() OVER (ORDER BY sha256(lang || role || k), lang, role, k) AS position FROM p QUALIFY position BETWEEN 11 AND 60
""")
def o7_generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of a generation plan: all combinations in hash order, resumed after ten."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    roles = table(spark, sf_dir, "conversations").select("role").distinct()
    combinations = langs.withColumn("one", F.lit(1)).join(roles.withColumn("one", F.lit(1)), "one").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(13)))).drop("one")
    order = Window.orderBy(F.sha2(F.concat("lang", "role", F.col("k").cast("string")), 256), "lang", "role", "k")
    return combinations.withColumn("position", F.row_number().over(order).cast("bigint")).filter("position between 11 and 60")


@query("""
WITH m AS (SELECT source, median(n_chars) AS med FROM documents GROUP BY 1), d AS (SELECT d.source, median(abs(n_chars - med)) AS mad FROM documents d JOIN m ON m.source = d.source GROUP BY 1)
SELECT d.doc_id, round((d.n_chars - med) / (mad * 1.4826 + 1e-6), 6) AS robust_z FROM documents d JOIN m ON m.source = d.source JOIN d x ON x.source = d.source
""")
def p1_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: z-score from median and median absolute deviation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    med = exact_quantiles(docs, "n_chars", ["source"], [0.5]).select("source", F.col("q")[0].alias("med"))
    with_med = docs.join(med, "source").withColumn("off", F.abs(F.col("n_chars") - F.col("med")))
    mad = exact_quantiles(with_med, "off", ["source"], [0.5]).select("source", F.col("q")[0].alias("mad"))
    z = (F.col("n_chars") - F.col("med")) / (F.col("mad") * 1.4826 + F.lit(1e-6))
    return with_med.join(mad, "source").select("doc_id", F.round(z, 6).alias("robust_z"))


@query(f"""
WITH {PAIRED}, r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY price) + (count(*) OVER (PARTITION BY flag, price) - 1) / 2.0 AS a, rank() OVER (PARTITION BY flag ORDER BY shipped) + (count(*) OVER (PARTITION BY flag, shipped) - 1) / 2.0 AS b FROM paired)
SELECT flag, round(corr(a, b), 6) AS rho FROM r GROUP BY flag
""")
def p2_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: rank correlation per series."""
    def rank(c: str):
        return F.rank().over(Window.partitionBy("flag").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("flag", c)) - 1) / 2.0

    return paired(spark, sf_dir).select("flag", rank("price").alias("a"), rank("shipped").alias("b")).groupBy("flag").agg(F.round(F.corr("a", "b"), 6).alias("rho"))
