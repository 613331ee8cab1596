"""Conversational training data: validity, splits with exact sizes, distributions, rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROLES = ["system", "user", "assistant"]


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its ``messages`` in order."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    ordered = turns.groupBy(key).agg(F.sort_array(F.collect_list(message)).alias("m"))
    return ordered.select(key, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def is_valid(messages: Column) -> Column:
    """Three turns, the roles in their order, and no empty content."""
    roles = F.transform(messages, lambda m: m["role"])
    filled = F.forall(messages, lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False)))
    return F.coalesce((F.size(messages) == 3) & (roles == F.array(*map(F.lit, ROLES))) & filled, F.lit(False))


def violation(messages: Column) -> Column:
    """The first rule that is broken; null for valid ones."""
    return (
        F.when(F.size(messages) != 3, "turn count")
        .when(F.transform(messages, lambda m: m["role"]) != F.array(*map(F.lit, ROLES)), "role order")
        .when(~F.forall(messages, lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False))), "empty content")
    )


def exact_split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: the floor(n * ratio) rows of least hash are 'validation', the others 'train'.

    Rows are ranked by hash prefix and inside prefixes, so no task ranks all of them; what is
    broadcast is one row for each of 4096 prefixes.
    """
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy())
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.floor(total * ratio).alias("_take"))
    ranked = hashed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))).join(F.broadcast(offsets), "_p")
    split = F.when(F.col("_before") + F.col("_i") <= F.col("_take"), "validation").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "_p", "_i", "_before", "_take")


def rubric(content: Column, sections: list[str], markers: list[str]) -> list[Column]:
    """(word_count, approx_tokens, has_all_sections, matched_markers, in_token_range) of a response."""
    from pulselake.functions.text import approximate_tokens

    words, tokens = approximate_tokens(content)
    low = F.lower(content)
    whole = F.forall(F.array(*map(F.lit, sections)), lambda s: F.contains(content, s))
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    return [words.alias("word_count"), tokens.alias("approx_tokens"), whole.alias("has_all_sections"), F.concat_ws(",", found).alias("matched_markers"), tokens.between(190, 360).alias("in_token_range")]
