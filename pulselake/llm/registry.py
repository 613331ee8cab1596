"""The queries of the corpus operators, over whole tables with production parameters.

SQL gives the exact answers of embedding dedup, archives and MinHash dedup by all pairs.
Hashing, tokenizing, tree building and training are outside DuckDB's reach; ``tests/llm``
holds those against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.edit_embedding import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.warc import archive_round_trip

    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.sharding import shard_slots

    return shard_slots(_documents(spark, sf_dir), shards=8)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), width=4)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.html_text import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.quality import classify_quality

    return classify_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.toxicity import classify_toxicity

    return classify_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.conversation_repair import damaged, repaired

    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.common import new_path
    from pulselake.llm.token_counts import counted_tokens

    return counted_tokens(_documents(spark, sf_dir), cache=new_path(spark, "token-counts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_edit_embedding, op2_embedding_dedup, op3_warc, op4_sharding, op5_best_fit_packing, op6_minhash, op7_mixing, op8_html_extraction, op9_quality, op10_toxicity, op11_collocations, op12_conversation_repair, op13_token_counts]
    return {f.__name__: f for f in found}


_REACH = """m AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT {id} AS node, {id} AS other FROM {nodes} UNION SELECT reach.node, m.b FROM reach JOIN m ON m.a = reach.other)"""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
""" + _REACH.format(id="vec_id", nodes="embeddings") + """,
d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM l UNION ALL SELECT b FROM l) GROUP BY 1),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(d.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN d ON d.node = vec_id"""

OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.digest = p.digest"""

OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: hash(array_to_string(words[i:i + 3], ' ')))
  WHEN len(words) > 0 THEN [hash(array_to_string(words, ' '))] ELSE [] END)) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.x = y.x AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
""" + _REACH.format(id="doc_id", nodes="documents") + """,
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP11 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
o AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) t(m) WHERE len(words) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM o WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
x AS (SELECT lang, u.phrase, a, k, l.f AS l, r.f AS r, (2000000 * CAST(a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) u JOIN f l USING (lang) JOIN f r USING (lang)
  WHERE l.phrase = array_to_string(words[1:k], ' ') AND r.phrase = array_to_string(words[k + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN c USING (lang)
  WHERE c.m > len(string_split(s.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * CAST(c.a AS HUGEINT) >= 80 * CAST(s.a AS HUGEINT)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s ANTI JOIN d USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000"""

def _op12() -> str:
    """The cheapest edits by dynamic programming: per state the least (cost, audit), written as one string with the cost in nine digits."""
    plus = lambda x, cost, letter: f"printf('%09d', CAST({x}[1:9] AS INT) + {cost}) || {x}[10:] || '{letter}'"
    least = lambda *xs: f"least({', '.join(xs)})"
    rest = "(CASE WHEN cut THEN 3 ELSE 0 END)"
    keep = lambda x, role: f"CASE WHEN NOT faulty AND initial = '{role}' THEN {plus(x, rest, 'K')} END"
    rerole = lambda x: f"CASE WHEN NOT faulty THEN {plus(x, '3 + ' + rest, 'R')} END"
    moved = [plus("s0", 4, "D"), least(plus("s1", 4, "D"), keep("s0", "s")), least(plus("s2", 4, "D"), *[f(s) for s in ("s0", "s1", "s3") for f in (lambda x: keep(x, "u"), rerole)]), least(plus("s3", 4, "D"), keep("s2", "a"), rerole("s2"))]
    closed = ["q0", "q1", least("q2", *[plus(q, 3, "I") for q in ("q0", "q1", "q3")]), least("q3", plus("q2", 3, "I"), plus("q0", 6, "II"), plus("q1", 6, "II"))]
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS fault FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, (VALUES (1), (2)) c(copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM r),
g AS (SELECT conv_id, turn, role, text, i, role[1:1] AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM o),
f AS MATERIALIZED (SELECT *, blank OR seen AS faulty, open AND NOT blank AND NOT seen AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM g),
t AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {", ".join(closed)} FROM (SELECT t.conv_id, f.i, {", ".join(f"{m} AS q{k}" for k, m in enumerate(moved))} FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1)),
b AS (SELECT conv_id, least(s0, s3) AS best FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
e AS (SELECT conv_id, unnest(string_split(best[10:], '')) AS letter, unnest(range(1, length(best) - 8)) AS p FROM b WHERE length(best) > 9),
x AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM e),
y AS (SELECT x.conv_id, p, letter, f.role, f.text, f.initial, (letter = 'K' AND f.initial = 's') AS system FROM x LEFT JOIN f ON letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE letter <> 'D'),
z AS (SELECT *, count(*) FILTER (NOT system) OVER (PARTITION BY conv_id ORDER BY p) % 2 AS odd FROM y),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM z GROUP BY 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2, "op3_warc": OP3, "op6_minhash": OP6, "op11_collocations": OP11, "op12_conversation_repair": _op12()}
