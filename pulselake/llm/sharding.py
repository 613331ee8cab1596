"""Sharding by weighted rendezvous hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulselake.llm.common import materialise, ranked


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """Shard (0-based) that ``key`` goes to among shards of the given weights.

    Each shard draws a uniform number from the hash of (key, shard); the least
    ``-ln(u) / weight`` wins, so a shard gets keys in proportion to its weight, and
    appending a shard or changing one weight moves keys only into or out of that shard.
    A null key is a key like any other. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = []
    for shard, weight in enumerate(weights):
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.ln(uniform) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def shard(df: DataFrame, key: str, weights: list[float], shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of every row; all rows and columns are kept."""
    return df.withColumn(shard_col, rendezvous_shard(F.col(key), weights))


def shard_slots(docs: DataFrame, shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """Shard, position within the shard, and the shard after growing by one, of each document.

    Takes ``doc_id`` and ``text`` (other columns are ignored). Size is the text's UTF-8
    bytes plus 1; null text counts as empty (crc 0). Rows with equal or null ``doc_id``
    share a shard but get different slots. Empty input gives an empty result. Slots are
    gapless per shard; the largest task holds one of 256 hash buckets of a shard.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).cast("int").alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, weights[-1]]).cast("int").alias("grown_shard"),
    )
    slots = ranked(materialise(placed), ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets=256)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
