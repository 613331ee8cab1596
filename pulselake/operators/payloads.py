"""JSON payloads of several shapes, parsed once a row into a VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parsed(rows: DataFrame, payload: str, envelope: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the columns ``fields`` (name: (path, type)), ``shape`` and ``error``, in place of ``payload``.

    A payload comes in an object under ``envelope``, bare, or as a list whose first element
    counts; it is parsed once and the shape is looked at on the parsed value. A payload that
    is no JSON keeps its row: its fields and shape are null and ``error`` says so. A field that is absent, or
    cannot be read as its type, is null. A null payload has neither shape nor error.
    """
    value = F.try_parse_json(payload)
    held = rows.withColumn("_parsed", value)
    kind = F.schema_of_variant("_parsed")
    inner = F.try_variant_get("_parsed", f"$.{envelope}", "variant")
    wrapped = F.coalesce(inner.isNotNull() & ~F.is_variant_null(inner), F.lit(False))
    body = F.when(wrapped, inner).when(kind.startswith("ARRAY"), F.try_variant_get("_parsed", "$[0]", "variant")).otherwise(F.col("_parsed"))
    shape = F.when(F.col("_parsed").isNull(), None).when(wrapped, "envelope").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "bare").otherwise("other")
    error = F.when(F.col(payload).isNotNull() & F.col("_parsed").isNull(), F.concat(F.lit("no JSON: "), F.substring(payload, 1, 40)))
    shown = held.withColumn("_body", body).withColumn("shape", shape).withColumn("error", error)
    rest = [c for c in rows.columns if c != payload]
    return shown.select(*rest, *[F.try_variant_get("_body", path, of).alias(name) for name, (path, of) in fields.items()], "shape", "error")


def payload_schema(rows: DataFrame, payload: str) -> DataFrame:
    """(schema, rows, bad): the one schema that all payloads fit, merged in an aggregate, and how many are no JSON."""
    held = rows.select(F.col(payload).isNotNull().alias("there"), F.try_parse_json(payload).alias("v"))
    return held.agg(F.schema_of_variant_agg("v").alias("schema"), F.count("v").alias("rows"), F.count_if(F.col("there") & F.col("v").isNull()).alias("bad"))
