"""Queries over documents, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulselake.functions import fixed_values as fixed
from pulselake.functions import text as T
from pulselake.operators import retrieval, sft
from pulselake.operators.chunk import chunk_documents
from pulselake.operators.profile import profile
from pulselake.plans.registry import query
from pulselake.session import table
from pulselake.sources.tables import json_lines, scratch
from pulselake.streaming import events as streams


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bpage\s+\d+\s+(?:of\s+\d+)?\b', '', 'g'),
  '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents
""")
def j1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents: page marks, broken words, blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_document(F.col("text")).alias("clean"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), {_quote('|'.join(f'(?:{p})' for p in ps))}) THEN '{tag}' END" for tag, ps in fixed.TOPIC_PATTERNS.items()) + ") AS tags FROM documents")
def j2_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic tags of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", T.topic_tags(F.col("text"))).alias("tags"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(lower(source || ' Doc-' || doc_id), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') || '_c' || lpad(CAST(n_chars // 1000 AS VARCHAR), CAST(greatest(3, length(CAST(n_chars // 1000 AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM documents
""")
def j5_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugged chunk ids."""
    name = F.concat("source", F.lit(" Doc-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(name, F.floor(F.col("n_chars") / 1000).cast("bigint")).alias("chunk_id"))


@query(None)
def j3_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of all documents."""
    return chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


_PLAIN = f"translate(lower(text), '{T._ACCENTS}', '{T._PLAIN}')"


@query(f"""
WITH w AS (SELECT doc_id, lang, regexp_matches(text, '[¿¡ñÑ]') AS marked, list_distinct(regexp_extract_all({_PLAIN}, '[a-z]+')) AS words FROM documents),
c AS (SELECT *, len(list_intersect(words, {_list(fixed.SPANISH_WORDS)})) AS es, len(list_intersect(words, {_list(fixed.ENGLISH_WORDS)})) AS en, len(list_intersect(words, {_list(fixed.FOREIGN_WORDS)})) AS other FROM w)
SELECT doc_id, lang, CASE WHEN marked THEN 'es' WHEN other > 0 THEN 'other' WHEN es > 0 AND es >= en THEN 'es' WHEN en > 0 THEN 'en' END AS detected FROM c
""")
def j8_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by marks and word counts."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.query_language(F.col("text")).alias("detected"))


@query(f"SELECT doc_id, translate({_PLAIN}, '{fixed.LEET_SIGNS}', '{fixed.LEET_LETTERS}') AS text FROM documents")
def j9_normalise_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents, case and leet signs normalised."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_prefix(F.col("text")).alias("text"))


@query(None)
def j9_normalise_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normalisation of conversation turns, back-references and look-behind included."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalise(F.col("text")).alias("text"))


@query(
    "SELECT conv_id, turn, coalesce("
    + ", ".join(f"CASE WHEN regexp_matches(text, {_quote(p)}) OR regexp_matches(translate({_PLAIN}, '{fixed.LEET_SIGNS}', '{fixed.LEET_LETTERS}'), {_quote(p)}) THEN '{n}' END" for n, p in fixed.ATTACK_PATTERNS.items())
    + ") AS category FROM conversations"
)
def j10_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attack family found in each turn, raw or normalised."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.attack_category(text, T.normalise_prefix(text)).alias("category"))


_DOMAIN = "|".join(fixed.DOMAIN_TERMS)


@query(f"""
WITH c AS (SELECT [{", ".join(f"avg(CAST(embedding[{k}] AS DOUBLE))" for k in range(1, 65))}] AS center FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 6) AS similarity, list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) >= 0.1 AS in_domain FROM embeddings, c
""")
def j11_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the domain's centroid, and the gate."""
    vectors = table(spark, sf_dir, "embeddings")
    center = vectors.agg(F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(64)]).alias("center"))
    similarity = retrieval.cosine(F.col("embedding"), F.col("center"))
    return vectors.join(F.broadcast(center)).select("vec_id", F.round(similarity, 6).alias("similarity"), (similarity >= 0.1).alias("in_domain"))


_KNN = """SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int, where: dict | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    collection = vectors.select(F.col("vec_id").alias("id"), "embedding", *["label"] * bool(where))
    return retrieval.nearest(queries, collection, k, 64, retrieval.metadata_filter(where) if where else None)


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({_KNN}) WHERE rank <= 10")
def j13_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of the query set."""
    return _neighbours(spark, sf_dir, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({_KNN} AND c.label IN (1, 2, 3)) WHERE rank <= 5")
def d12_filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors among some labels."""
    found = _neighbours(spark, sf_dir, 5, {"$and": [{"label": {"$in": [1, 2, 3]}}]})
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_CANDIDATES = f"""n AS (SELECT * FROM ({_KNN}) WHERE rank <= 10),
cand AS (SELECT query_id, lower(b.text) AS query, id, 1 - similarity AS distance, lower(d.text) AS text, lower(d.source) AS tags
  FROM n JOIN benchmark b ON b.item_id = query_id // 100 JOIN documents d ON d.doc_id = id),
tok AS (SELECT *, list_distinct(list_filter(regexp_extract_all(query, '([a-z0-9áéíóúüñ]{{2,}})', 1), lambda t: length(t) > 2 OR t IN ('hr', 'hf', 'lf', 'rr'))) AS tokens, tags || ' ' || text AS whole FROM cand),
hit AS (SELECT *, list_filter(tokens, lambda t: contains(whole, t)) AS found FROM tok),
lex AS (SELECT *, CASE WHEN len(tokens) = 0 THEN 0.0 ELSE len(found) / CAST(len(tokens) AS DOUBLE) * 5.0
  + least(coalesce(list_sum(list_transform(found, lambda t: (length(whole) - length(replace(whole, t, ''))) // length(t))), 0), 10) * 0.2 + len(list_filter(found, lambda t: contains(tags, t))) END AS lexical FROM hit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS dr, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, id) AS lr FROM lex),
fused AS (SELECT query_id, id, dr, lr, round(0.55 / (60 + dr) + 0.45 / (60 + lr) + lexical / 10.0 * 0.005, 6) AS rerank_score FROM ranked)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbours(spark, sf_dir, 10)
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.lower("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"), F.lower("source").alias("tags"))
    return near.join(items, "query_id").join(docs, "id").select("query_id", "query", "id", F.round(1 - F.col("similarity"), 12).alias("distance"), "text", "tags")


@query(f"WITH {_CANDIDATES} SELECT query_id, id, dr AS dense_rank, lr AS lexical_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM fused QUALIFY rank <= 3")
def j12_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three candidates of each query by fused dense and lexical ranks."""
    best = retrieval.rerank(_candidates(spark, sf_dir), 3)
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return best.select("query_id", "id", whole("dense_rank"), whole("lexical_rank"), "rerank_score", whole("rank"))


@query(f"""
WITH {_CANDIDATES}, n_cand AS (SELECT query_id, count(*) AS candidates, max(1 - distance) AS best FROM cand WHERE distance < 0.999999 GROUP BY 1),
q AS (SELECT item_id, text, list_distinct(regexp_extract_all({_PLAIN}, '[a-z]+')) AS words FROM benchmark)
SELECT item_id, CASE WHEN NOT regexp_matches(text, '[¿¡ñÑ]') AND len(list_intersect(words, {_list(fixed.FOREIGN_WORDS)})) > 0 THEN 'unsupported_language'
  WHEN """ + " OR ".join(f"regexp_matches(text, {_quote(p)}) OR regexp_matches(translate({_PLAIN}, '{fixed.LEET_SIGNS}', '{fixed.LEET_LETTERS}'), {_quote(p)})" for p in fixed.ATTACK_PATTERNS.values()) + """ THEN 'rejected'
  WHEN coalesce(best, 0) < 0.52 AND candidates IS NOT NULL THEN 'out_of_domain' WHEN candidates IS NULL THEN 'no_matching_evidence' ELSE 'success' END AS status
FROM q LEFT JOIN n_cand ON query_id = item_id * 100
""")
def m7_ask_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every benchmark question in the order of the checks."""
    near = _candidates(spark, sf_dir).filter("distance < 0.999999").groupBy((F.col("query_id") / 100).cast("bigint").alias("item_id"))
    near = near.agg(F.count(F.lit(1)).alias("candidates"), F.max(1 - F.col("distance")).alias("best"))
    text = F.col("text")
    questions = table(spark, sf_dir, "benchmark").select("item_id", T.query_language(text).alias("language"), T.attack_category(text, T.normalise_prefix(text)).alias("attack")).join(near, "item_id", "left")
    known = F.coalesce("candidates", F.lit(0))
    similarity = F.when(known == 0, F.lit(1.0)).otherwise(F.col("best"))
    return questions.select("item_id", retrieval.ask_status(F.coalesce("language", F.lit("es")), F.col("attack"), similarity, known).alias("status"))


@query("""
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, bool_and(coalesce(trim(text) <> '', false)) AS filled FROM conversations GROUP BY 1)
SELECT conv_id, len(roles) = 3 AND roles = ['system', 'user', 'assistant'] AND filled AS valid,
  CASE WHEN len(roles) <> 3 THEN 'turn count' WHEN roles <> ['system', 'user', 'assistant'] THEN 'role order' WHEN NOT filled THEN 'empty content' END AS violation FROM c
""")
def o1_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of each conversation and the first rule that it breaks."""
    rows = sft.conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", sft.is_valid(F.col("messages")).alias("valid"), sft.violation(F.col("messages")).alias("violation"))


@query("""
WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256(conv_id || ':42'), conv_id) AS i, count(*) OVER () AS n FROM c)
SELECT conv_id, CASE WHEN i <= floor(n * 0.25) THEN 'validation' ELSE 'train' END AS split FROM r
""")
def o2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split with exact sizes."""
    return sft.exact_split(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 0.25)


@query("""
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())
""")
def o3_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions by language and by source in one pass."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.groupingSets([[docs.lang], [docs.source], []], docs.lang, docs.source)
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars").cast("double") / F.count(F.lit(1))).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(r"""
WITH a AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant'),
w AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM a)
SELECT conv_id, turn, CAST(words AS BIGINT) AS word_count, CAST(words * 133 // 100 AS BIGINT) AS approx_tokens, contains(text, '.') AND contains(text, 'e') AS has_all_sections,
  """ + "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), {_quote(m)}) THEN {_quote(m)} END" for m in fixed.MARKERS["en"]) + """) AS matched_markers, words * 133 // 100 BETWEEN 190 AND 360 AS in_token_range FROM w
""")
def j17_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric of every answer: sections, markers, length."""
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return answers.select("conv_id", "turn", *sft.rubric(F.col("text"), [".", "e"], fixed.MARKERS["en"]))


@query("SELECT conv_id, turn, role, text FROM conversations")
def a9_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines (with blank and broken ones between) and read back."""
    path = scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    broken = rows.filter("turn = 0").select(F.lit("{broken").alias("value"))
    lines.unionByName(broken).write.text(path)
    read = json_lines(spark, path, rows.schema)
    return read.filter("_corrupt_record is null").drop("_corrupt_record")


@query("""
SELECT doc_id, CASE WHEN length(text) > 250 THEN substr(text, 1, 250) || '...' ELSE text END AS excerpt FROM documents
""")
def j14_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 250 characters of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    parts = [
        f"""SELECT '{name}' AS table_name, '{c}' AS column_name, CAST({i} AS INTEGER) AS column_id, '{t}' AS data_type, (SELECT count(*) FROM {name}) AS n_rows,
  (SELECT count(*) - count({c}) FROM {name}) AS n_nulls, coalesce((SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {name} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)), '(none)') AS samples"""
        for i, (c, t) in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


_PROFILED = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
}


@query(" UNION ALL ".join(_profile_sql(n, c) for n, c in _PROFILED.items()))
def n1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog profile: types, rows, nulls and samples of each column."""
    found = [profile(table(spark, sf_dir, n).select(*[F.col(c).cast(t).alias(c) for c, t in columns]), n) for n, columns in _PROFILED.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2
""")
def l1_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling day window of the stream, over the table."""
    return streams.closed_days(table(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new_, event_id FROM events),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k
""")
def l6_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of each user."""
    return streams.sessions(table(spark, sf_dir, "events"))


@query(None)
def f11_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a budget of one an hour and two a day lets through, per user."""
    return streams.call_budget(table(spark, sf_dir, "events"), "user_id", hour=1, day=2)


_LABELS_SQL = """
SELECT d.source, l.quality, l.toxic, count(*) AS n, rank() OVER (PARTITION BY d.source ORDER BY count(*) DESC) AS place
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2, 3"""


def label_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("source", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.rank().over(Window.partitionBy("source").orderBy(F.desc("n"))).cast("bigint"))
