"""Table functions in SQL, payloads as variants, the language model's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.functions import table_functions
from pulselake.operators import language, payloads
from pulselake.operators.store import merge_latest
from pulselake.plans.common import DAILY, NAIVE, daily, naive
from pulselake.plans.registry import query
from pulselake.session import table


@query(f"""
WITH {DAILY}, d AS (SELECT user_id, day, CAST(sum(value) FILTER (WHERE metric = 'click') AS DOUBLE) AS clicks FROM daily GROUP BY 1, 2),
e AS (SELECT *, coalesce(max(CASE WHEN clicks IS NOT NULL THEN day END) OVER (PARTITION BY user_id), max(day) OVER (PARTITION BY user_id)) AS last_day FROM d),
k AS (SELECT * FROM e WHERE day BETWEEN last_day - 6 AND last_day)
SELECT 'record' AS kind, user_id AS series, day, clicks AS value, NULL AS status, NULL::DATE AS first_day, NULL::DATE AS last_day, NULL::BIGINT AS records, NULL::DOUBLE AS mean FROM k
UNION ALL SELECT 'summary', user_id, NULL, NULL, 'success', CAST(max(last_day) - 6 AS DATE), max(last_day), count(*), round(avg(clicks), 6) FROM k GROUP BY user_id
""")
def m3_actuals_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days of each user with clicks, asked of a table function in SQL."""
    table_functions.register(spark)
    days = daily(spark, sf_dir).groupBy("user_id", "day").agg(F.sum(F.when(F.col("metric") == "click", F.col("value"))).cast("double").alias("clicks"))
    found = spark.sql("SELECT * FROM recent_actuals(TABLE({days}) PARTITION BY user_id ORDER BY day, value => 'clicks', days => 7)", days=days)
    return found.withColumn("mean", F.round("mean", 6))


@query(f"""
WITH {NAIVE}, f AS (SELECT CASE metric WHEN 'view' THEN 'fitness_age' ELSE metric END AS metric, target_date, predicted_value, datediff('day', DATE '2024-01-25', target_date) AS ahead FROM naive WHERE anchor = DATE '2024-01-25'),
k AS (SELECT * FROM f WHERE metric <> 'fitness_age' AND ahead BETWEEN 1 AND 3)
SELECT 'record' AS kind, metric, target_date, ahead AS days_ahead, predicted_value, NULL AS status, NULL::BIGINT AS records, NULL::BOOLEAN AS excluded FROM k
UNION ALL SELECT 'summary', f.metric, NULL, NULL, NULL, CASE WHEN f.metric = 'fitness_age' THEN 'error' WHEN count(k.metric) = 0 THEN 'empty' ELSE 'success' END, count(k.metric), f.metric = 'fitness_age'
FROM f LEFT JOIN k ON k.metric = f.metric AND k.target_date = f.target_date GROUP BY f.metric
""")
def m4_forecasts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of three days and each metric's status, asked of a table function in SQL."""
    table_functions.register(spark)
    rows = naive(spark, sf_dir, "2024-01-25").withColumn("metric", F.when(F.col("metric") == "view", "fitness_age").otherwise(F.col("metric")))
    return spark.sql("SELECT * FROM forecasts_ahead(TABLE({rows}) PARTITION BY metric ORDER BY target_date, base => DATE'2024-01-25', horizon => 3)", rows=rows)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as they come from several sources: in an envelope, bare, in a list, broken off, absent."""
    props = F.col("props")
    shaped = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"hrvSummary":'), props, F.lit("}")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("["), props, F.lit(',{"k":-1}]')))
        .when(F.col("event_id") % 5 == 2, F.substring(props, 1, 4))
        .when(F.col("event_id") % 10 == 3, F.lit(None))
        .otherwise(props)
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", shaped.alias("payload"))


_PARSED = """p AS (SELECT event_id, user_id, ts, event_id % 5 = 2 AS bad, event_id % 10 = 3 AS none, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT event_id, user_id, ts, CASE WHEN bad OR none THEN NULL ELSE k END AS k, CASE WHEN bad OR none THEN NULL WHEN event_id % 5 = 0 THEN 'envelope' WHEN event_id % 5 = 1 THEN 'list' ELSE 'bare' END AS shape, bad FROM p)"""


@query(f"WITH {_PARSED} SELECT event_id, k, shape, bad FROM s")
def k8_variant_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all shapes, each parsed once; broken ones keep their row."""
    found = payloads.parsed(_payloads(spark, sf_dir), "payload", "hrvSummary", {"k": ("$.k", "bigint")})
    return found.select("event_id", "k", "shape", F.col("error").isNotNull().alias("bad"))


@query(f"""
WITH {_PARSED} SELECT user_id, CAST(ts AS DATE) AS day, k AS weekly, shape FROM s WHERE shape IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1
""")
def b3_variant_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest readable payload of each user and day."""
    found = payloads.parsed(_payloads(spark, sf_dir), "payload", "hrvSummary", {"weekly": ("$.k", "bigint")}).filter("shape is not null")
    rows = found.select("user_id", F.to_date("ts").alias("day"), "weekly", "shape", "ts", "event_id")
    return merge_latest(rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts", "event_id")


#: Texts whose id ends in 0 or 5 are not learnt from.
_GRAMS = r"""w AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents),
o AS (SELECT doc_id, lang, held, word, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, held, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram FROM o),
c AS (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held AND lang IS NOT NULL GROUP BY 1, 2),
k AS (SELECT gram FROM c GROUP BY 1 ORDER BY sum(n) DESC, gram LIMIT 20000),
l AS (SELECT DISTINCT lang FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL),
t AS (SELECT l.lang, (SELECT count(*) FROM k) + coalesce((SELECT sum(n) FROM c JOIN k USING (gram) WHERE c.lang = l.lang), 0) AS total FROM l),
m AS (SELECT k.gram, t.lang, CAST(floor(1000 * ln((coalesce(c.n, 0) + 1)::DOUBLE / total::DOUBLE)) AS BIGINT) AS weight FROM k CROSS JOIN t LEFT JOIN c ON c.gram = k.gram AND c.lang = t.lang),
s AS (SELECT doc_id, m.lang, sum(n * weight) AS score FROM g JOIN m USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1),
u AS (SELECT lang FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1)"""


@query(f"""
WITH {_GRAMS} SELECT d.doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '\\P{{L}}', '', 'g')) >= 10 AND b.lang IS NOT NULL THEN b.lang ELSE u.lang END AS language,
  CASE WHEN length(regexp_replace(coalesce(text, ''), '\\P{{L}}', '', 'g')) >= 10 AND b.lang IS NOT NULL THEN 'model' ELSE 'default' END AS method
FROM documents d LEFT JOIN b USING (doc_id) CROSS JOIN u
""")
def j8_detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by letter trigrams, learnt from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.detect(docs, "doc_id", language.fit(docs.filter("doc_id % 5 <> 0")))
