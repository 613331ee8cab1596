"""Catalog profile of tables: rows, columns, nulls, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def profile(rows: DataFrame, name: str, samples: int = 3) -> DataFrame:
    """(table_name, column_name, column_id, data_type, n_rows, n_nulls, samples) for every column.

    Counts are one aggregate. Samples are the smallest distinct values as text: each is the
    least one after the sample before it, for all columns in one aggregate, which combines on
    the map side; so no distinct values are shuffled.
    """
    columns = rows.columns
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("column_id"), F.lit(t).alias("data_type"), (F.col("_n") - F.col(c)).alias("n_nulls")) for i, (c, t) in enumerate(rows.dtypes)]
    stats = counts.select("_n", F.explode(F.array(*cells)).alias("c")).select("c.*", F.col("_n").alias("n_rows"))
    values = rows.select(*[F.col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(columns)])
    last = None
    for k in range(samples):
        after = values if last is None else values.join(F.broadcast(last))  # one row
        least = [F.min(F.col(f"_v{i}") if last is None else F.when(F.col(f"_v{i}") > F.col(f"_s{k - 1}_{i}"), F.col(f"_v{i}"))).alias(f"_s{k}_{i}") for i in range(len(columns))]
        carried = [F.first(f"_s{j}_{i}").alias(f"_s{j}_{i}") for j in range(k) for i in range(len(columns))]
        last = after.agg(*carried, *least)
    shown = [F.struct(F.lit(c).alias("column_name"), F.nullif(F.concat_ws(", ", *[f"_s{k}_{i}" for k in range(samples)]), F.lit("")).alias("samples")) for i, c in enumerate(columns)]
    some = last.select(F.explode(F.array(*shown)).alias("x")).select("x.*")
    return stats.join(some, "column_name", "left").select(F.lit(name).alias("table_name"), "column_name", "column_id", "data_type", "n_rows", "n_nulls", F.coalesce("samples", F.lit("(none)")).alias("samples"))


def render(profiled: list) -> str:
    """Fixed-width report of collected profile rows (one per column, so bounded by the schemas)."""
    head = ("table", "column", "type", "rows", "nulls", "samples")
    lines = [head] + [(r.table_name, r.column_name, r.data_type, str(r.n_rows), str(r.n_nulls), r.samples if len(r.samples) <= 42 else r.samples[:39] + "...") for r in profiled]
    widths = [max(len(x[k]) for x in lines) for k in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in lines)
