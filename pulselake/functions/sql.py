"""The library's small functions for use in SQL text, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result type, body
FUNCTIONS = [
    ("valid_or_null", "v DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(v) AND v > 0 THEN v END"),
    ("clamp", "v DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END"),
    ("safe_ratio", "a DOUBLE, b DOUBLE", "DOUBLE", "a / (b + 1e-6)"),
    ("band", "v DOUBLE, lo DOUBLE, hi DOUBLE", "STRING", "CASE WHEN v BETWEEN lo AND hi THEN 'normal' WHEN v < lo THEN 'low' ELSE 'high' END"),
    ("horizon_end", "d DATE", "DATE", "date_add(d, 13 - weekday(d))"),
]


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; their bodies are inlined by the optimiser."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
