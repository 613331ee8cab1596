"""Vector search, reranking and the status cascade for batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulselake.functions import fixed_values as fixed
from pulselake.operators import vector_index
from pulselake.sources.tables import scratch
from pulselake.streaming.limits import LIMITS, OK, Windows, limited_table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def nearest(queries: DataFrame, collection: DataFrame, k: int, dimensions: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest rows of the collection for every query, exactly, by an index for this search alone.

    ``queries``: (query_id, embedding); ``collection``: (id, embedding) and what ``where`` filters by.
    See ``vector_index`` for ties and vectors of another length.
    """
    path = scratch(queries.sparkSession, "index")
    vector_index.build(collection, path, dimensions, keep=tuple(c for c in collection.columns if c not in ("id", "embedding")))
    return vector_index.search(queries, path, k, dimensions, where).drop("cells_read")


def metadata_filter(where: dict) -> Column:
    """A filter in the vector store's language (equality, ``$in``, ``$and``) as a Column."""
    if "$and" in where:
        parts = [metadata_filter(w) for w in where["$and"]]
        found = parts[0]
        for part in parts[1:]:
            found = found & part
        return found
    found = F.lit(True)
    for key, value in where.items():
        found = found & (F.col(key).isin(value["$in"]) if isinstance(value, dict) else F.col(key) == F.lit(value))
    return found


def within(where: dict | None, key: str, allowed: list[str]) -> dict:
    """A caller's filter that cannot leave the ``allowed`` values of ``key``.

    A single allowed value stays; of a list the allowed ones stay, or all allowed values where
    none is; another value, or no condition, becomes the whole list; conditions on other keys only
    are joined to it.
    """
    whole = {key: {"$in": allowed}}
    if not where:
        return whole
    if key not in where:
        return {"$and": [whole, where]}
    asked = where[key]
    if isinstance(asked, dict) and "$in" in asked:
        return {key: {"$in": [a for a in asked["$in"] if a in allowed] or allowed}}
    return {key: asked} if asked in allowed else whole


def query_tokens(query: Column) -> Column:
    """Distinct tokens that count in reranking: longer than two characters, or one of a few short ones."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9áéíóúüñ]{2,})"), F.lit(1))
    short = F.array(*map(F.lit, fixed.SHORT_TOKENS))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) | F.array_contains(short, t)))


def lexical_score(tokens: Column, text: Column, tags: Column) -> Column:
    """Five times the share of tokens found, a fifth per occurrence (at most ten), and one per token among the tags."""
    found = F.filter(tokens, lambda t: F.contains(text, t))
    occurrences = F.aggregate(found, F.lit(0), lambda s, t: s + ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int"))
    tagged = F.size(F.filter(found, lambda t: F.contains(tags, t)))
    share = F.size(found) / F.greatest(F.size(tokens), F.lit(1))
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(share * 5.0 + F.least(occurrences, F.lit(10)) * 0.2 + tagged * 1.0)


def rerank(candidates: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of dense and lexical ranks, with a small bonus for the lexical score.

    ``candidates``: query_id, query, id, distance, text (lower case), tags. Ties keep the order of ``id``.
    """
    scored = candidates.withColumn("lexical", lexical_score(query_tokens(F.col("query")), F.concat_ws(" ", "tags", "text"), F.col("tags")))
    rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ranked = scored.withColumn("dense_rank", rank("distance", "id")).withColumn("lexical_rank", rank(F.desc("lexical"), "id"))
    fused = 0.55 / (constant + F.col("dense_rank")) + 0.45 / (constant + F.col("lexical_rank")) + F.col("lexical") / 10.0 * 0.005
    done = ranked.withColumn("rerank_score", F.round(fused, 6))
    return done.withColumn("rank", rank(F.desc("rerank_score"), "id")).filter(F.col("rank") <= k)


def domain_gate(text: Column, similarity: Column, terms: list[str] | None = None, least: float = 0.52) -> list[Column]:
    """(in_domain, score, method) of normalised texts: a term of the lexicon lifts the score to 0.7 at
    least, else the similarity to the domain's centroid decides. Brand names are the caller's to add."""
    lexical = F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms or fixed.DOMAIN_TERMS]), F.lit(False))
    score = F.when(lexical, F.greatest(similarity, F.lit(0.7))).otherwise(similarity)
    method = F.when(lexical, "lexicon_match").when(similarity >= least, "semantic_similarity").otherwise("out_of_domain")
    return [(lexical | (similarity >= least)).alias("in_domain"), F.round(score, 4).alias("score"), method.alias("method")]


def candidate_pool(k: int, n: Column) -> Column:
    """Candidates that a search for ``k`` takes from a collection of ``n``."""
    return F.least(F.lit(max(3 * k, 10)).cast("bigint"), n)


def ask_status(language: Column, attack: Column, similarity: Column, candidates: Column, least: float = 0.52) -> Column:
    """Outcome of a query in the order of the checks: language, attack, domain, evidence."""
    return (
        F.when(language == "other", "unsupported_language")
        .when(attack.isNotNull(), "rejected")
        .when(similarity < least, "out_of_domain")
        .when(candidates == 0, "no_matching_evidence")
        .otherwise("success")
    )


#: Outcomes of the checks that stand before the budget; questions that got further are counted (``ask_status``).
_BEFORE_BUDGET = ("unsupported_language", "rejected", "out_of_domain")


def within_budget(checked: DataFrame, key: str, at: Column, limits: Windows = LIMITS, stored: int | None = None, client: Column | None = None) -> DataFrame:
    """(key, status, budget) of questions with a ``status`` of the earlier checks, asked at a time by a client.

    An empty collection (``stored`` is 0) answers ``empty_knowledge_base`` before the budget is
    looked at. The others use up their client's budget in order of time; one that finds a window
    full is ``budget_exceeded``, and does not count itself. ``budget`` is the full window,
    ``ok``, or ``not asked``. Keys are whole numbers, one a question.
    """
    rows = checked.select(F.col(key), "status", at.alias("_at"), (client if client is not None else F.lit(0)).cast("long").alias("_client"))
    passed = ~F.col("status").isin(*_BEFORE_BUDGET)
    if stored == 0:
        return rows.select(key, F.when(passed, "empty_knowledge_base").otherwise(F.col("status")).alias("status"), F.lit("not asked").alias("budget"))
    calls = rows.filter(passed).select(F.col("_client"), F.col(key).alias("event_id"), F.col("_at").alias("ts"))
    used = limited_table(calls, "_client", limits).select(F.col("event_id").alias("_id"), "outcome")
    told = rows.join(used, F.col(key) == F.col("_id"), "left")
    full = F.coalesce(F.col("outcome") != OK, F.lit(False))
    return told.select(key, F.when(full, "budget_exceeded").otherwise(F.col("status")).alias("status"), F.coalesce("outcome", F.lit("not asked")).alias("budget"))
