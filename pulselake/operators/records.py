"""Records that other programs read: anomalies, forecast summaries, registries, checked seeds, formatted values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from pulselake.operators.windows import fill_both

#: Defaults of metrics that have no value at all, filled forward and backward before (fixed values).
FILLED = {
    "resting_heart_rate": 58.0, "hrv_rmssd": 55.0, "daily_avg_stress": 25.0, "sleep_score": 80.0, "chronological_age": 40.0, "fitness_age": 34.8,
    "achievable_fitness_age": 34.5, "body_fat_pct": 16.6, "vigorous_minutes_avg": 35.0,
}
#: Defaults of metrics that are not filled from other days (fixed values).
PLAIN = {"total_steps": 5000.0, "active_kilocalories": 300.0, "total_kilocalories": 2100.0}
#: Heart rates of activities, whose default is the mean of what was observed (fixed values).
OBSERVED = {"running_avg_hr": 145.0, "gym_avg_hr": 110.0, "walking_avg_hr": 115.0}
LEAST_RESTING = 800.0
#: Headers that an answer has to have, by language (fixed values).
SECTIONS = {
    "en": ["### 1. Quick Diagnosis", "### 2. Physiological Breakdown", "### 3. Today's Work"],
    "es": ["### 1. El Diagnóstico Rápido", "### 2. La Explicación Fisiológica", "### 3. La Chamba de Hoy"],
}


def with_defaults(rows: DataFrame, series: list[str], order: str) -> DataFrame:
    """Every known metric column without nulls: filled within its series, then by the domain's default; resting energy derived.

    A heart rate of an activity falls back on the mean of the series. Columns that are absent
    stay absent; columns that are no known metric stay as they are.
    """
    have, number = set(rows.columns), lambda c: F.col(c).cast("double")
    whole = Window.partitionBy(*series)
    new = {c: F.coalesce(fill_both(c, series, order).cast("double"), F.lit(d)) for c, d in FILLED.items() if c in have}
    new |= {c: F.coalesce(number(c), F.lit(d)) for c, d in PLAIN.items() if c in have}
    new |= {c: F.round(F.coalesce(fill_both(c, series, order).cast("double"), F.avg(number(c)).over(whole), F.lit(d)), 1) for c, d in OBSERVED.items() if c in have}
    filled = rows.withColumns(new) if new else rows
    if {"active_kilocalories", "total_kilocalories"} <= have:
        filled = filled.withColumn("resting_kilocalories", F.greatest(F.col("total_kilocalories") - F.col("active_kilocalories"), F.lit(LEAST_RESTING)))
    return filled


def anomaly_records(rows: DataFrame, keys: list[str], forest: str, outlier: str, metrics: list[str]) -> DataFrame:
    """(keys, is_anomaly, severity, isolation_forest_score, lof_score, contributing_factors, metrics): scores to four places, metrics to two.

    ``rows`` have ``severity`` and ``factors``; ``metrics`` is a map, without metrics that are null.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics])
    named = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    rounded = F.transform_values(named, lambda _, v: F.round(v, 2))
    return rows.select(*keys, (F.col("severity") != "NORMAL").alias("is_anomaly"), "severity", F.round(forest, 4).alias("isolation_forest_score"), F.round(outlier, 4).alias("lof_score"), F.col("factors").alias("contributing_factors"), rounded.alias("metrics"))


def forecast_summaries(forecasts: DataFrame, target: str, ds: str, shown: list[str], measures: dict[str, Column], model: str, last: int = 7) -> DataFrame:
    """(target, model, metrics, forecast_sample): rounded measures of each target, and its ``last`` rows in order."""
    late = Window.partitionBy(target).orderBy(F.desc(ds))
    measured = forecasts.groupBy(target).agg(*[F.round(m, 4).alias(name) for name, m in measures.items()])
    tail = forecasts.withColumn("_back", F.row_number().over(late)).filter(F.col("_back") <= last)
    sample = tail.groupBy(F.col(target).alias("_of")).agg(F.sort_array(F.collect_list(F.struct(ds, *shown))).alias("forecast_sample"))
    joined = measured.join(sample, measured[target].eqNullSafe(sample["_of"]), "left")
    return joined.select(target, F.lit(model).alias("model"), F.struct(*measures).alias("metrics"), "forecast_sample")


def registry_record(rows: DataFrame, name: str, strategy: str, baselines: dict[str, float], day: str) -> DataFrame:
    """(name, metadata): one JSON record of what a stored table holds and how its gaps were filled."""
    features = F.array(*[F.lit(c) for c in rows.columns])
    known = F.create_map(*[F.lit(x) for pair in baselines.items() for x in pair])
    found = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.max(day).cast("string").alias("last_calendar_date"))
    record = F.to_json(F.struct(F.lit(strategy).alias("imputation_strategy"), known.alias("domain_baselines"), F.size(features).alias("feature_count"), features.alias("features"), "total_rows", "last_calendar_date"))
    return found.select(F.lit(name).alias("name"), record.alias("metadata"))


def seed_violations(messages: Column, language: Column) -> Column:
    """Everything that is wrong with a seed conversation, in order: turns, roles, missing headers of its language."""
    roles = F.transform(messages, lambda m: m["role"])
    answer = F.get(messages, F.lit(2))["content"]
    has = lambda s: F.coalesce(F.contains(answer, s), F.lit(False))
    missing = lambda names: F.transform(F.filter(F.array(*map(F.lit, names)), lambda s: ~has(s)), lambda s: F.concat(F.lit("missing "), s))
    wrong = lambda bad, text: F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    sections = F.when(language == "en", missing(SECTIONS["en"])).otherwise(missing(SECTIONS["es"]))
    return F.concat(wrong(F.size(messages) != 3, "turn count"), wrong(roles != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "role order"), sections)


def require_valid(rows: DataFrame, violations: str, key: str) -> DataFrame:
    """The rows, if none of them has a violation; otherwise fails with the first few."""
    bad = rows.filter(F.size(violations) > 0).select(key, violations).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r[0]}: {', '.join(r[1])}" for r in bad))
    return rows


def response_of(messages: Column, response: Column, content: Column) -> Column:
    """What is scored: the first assistant's message, else the response, else the content."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return F.coalesce(first, response, content)


@F.pandas_udf(StringType())
def sample_number(v: pd.Series) -> pd.Series:
    """NULL, whole numbers without decimals, others with four significant digits (of the binary value, exactly)."""
    shown = ["NULL" if x is None or x != x else str(int(x)) if x == x // 1 and abs(x) != float("inf") else f"{x:.4g}" for x in v]
    return pd.Series(shown, dtype=object)


def sample_binary(b: Column) -> Column:
    """Length and first four bytes of a binary value."""
    return F.when(b.isNull(), "NULL").otherwise(F.concat(F.lit("<BLOB "), F.octet_length(b).cast("string"), F.lit("B: 0x"), F.lower(F.hex(F.substring(b, 1, 4))), F.lit("...>")))


def context_block(rank: Column, document: Column, source: Column, distance: Column, score: Column, text: Column) -> Column:
    """One cited document of an answer's context, headed by its place, name, source, distance and score (fixed wording)."""
    head = F.format_string("[Documento %d: %s | Fuente: %s | Distancia Coseno: %.4f | Rerank Score: %.5f]\n", rank, document, source, distance, score)
    return F.concat(head, text)
