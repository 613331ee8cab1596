"""Idempotent table mutations as declarative rewrites: upserts, locks, deletes, precedence merges.

Parquet has no MERGE, so every mutation is a function of (existing, incoming) that returns
the new table; ``sources.tables.replace`` swaps it in. All of them are one shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def merge_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key: an aggregate with partial results, so hot keys do not gather."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*rows.columns)


def merge_keep_old(rows: DataFrame, keys: list[str], order: list[str], sticky: list[str]) -> DataFrame:
    """As ``merge_latest``, but the ``sticky`` columns keep their last value that is not null."""
    rest = [c for c in rows.columns if c not in keys and c not in sticky]
    seq = F.struct(*order)
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in sticky]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"), *kept).select(*keys, "_last.*", *sticky).select(*rows.columns)


def lock_first_write(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows already there stay as they are; only keys not yet present are added."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def force_replace(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming keys are replaced."""
    return incoming.unionByName(existing.join(incoming.select(*keys).distinct(), keys, "left_anti"))


def delete_from(rows: DataFrame, column: str, first: Column) -> DataFrame:
    """Without rows at or after ``first``; rows whose column is null stay."""
    return rows.filter(F.col(column).isNull() | (F.col(column) < first))


def extract_precedence(existing: DataFrame, extracted: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Extracted rows win over existing ones of the same key; days from ``as_of`` on are not closed and go."""
    kept = existing.join(extracted.select(key), key, "left_anti")
    return kept.unionByName(extracted).filter(F.col(key) < as_of)


def state_diff(current: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) by one full outer join: new, changed, backfill (stored digest empty), unchanged, orphan."""
    a, b = current.select(key, F.col(digest).alias("_now")), stored.select(key, F.lit(True).alias("_there"), F.col(digest).alias("_was"))
    status = (
        F.when(F.col("_there").isNull(), "new")
        .when(F.col("_now").isNull(), "orphan")
        .when(F.coalesce("_was", F.lit("")) == "", "backfill")
        .when(F.col("_was") != F.col("_now"), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def payload_field(payload: str, envelope: str, field: str) -> Column:
    """A field of a JSON payload that comes in an envelope, bare, or as a list whose first element counts."""
    return F.coalesce(*[F.get_json_object(payload, path) for path in (f"$.{envelope}.{field}", f"$.{field}", f"$[0].{field}")])
