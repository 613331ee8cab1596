"""Keys of tables and links between them, found from the data: sketches first, one exact shuffle after."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from pulselake.operators.vector_index import settled

#: Hashes that a column's sample holds, about; share of distinct values below which a sketch rules a key out.
SAMPLE, CLOSE = 2048, 0.85
_KINDS = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "string": "text", "date": "date"}


def _columns(df: DataFrame) -> dict[str, str]:
    """Columns that may be keys, and the kind of their values; only values of one kind are compared."""
    return {name: _KINDS[kind] for name, kind in df.dtypes if kind in _KINDS}


def _hash(*columns: str) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns])


def sketches(tables: dict[str, DataFrame]) -> dict[tuple[str, str], dict]:
    """Of each column: rows, nulls, estimated distinct values, and a hash sample of its values that is drawn alike for all columns.

    Two aggregates a table. A value is in the samples of all columns that hold it, or of none.
    """
    out: dict[tuple[str, str], dict] = {}
    for name, df in tables.items():
        columns = _columns(df)
        stats = [F.count(F.lit(1)).alias("n")]
        for k, c in enumerate(columns):
            stats += [F.count(F.col(f"`{c}`")).alias(f"c{k}"), F.approx_count_distinct(_hash(c), 0.02).alias(f"d{k}")]
        row = df.agg(*stats).first()
        for k, (c, kind) in enumerate(columns.items()):
            out[name, c] = {"n": row["n"], "nulls": row["n"] - row[f"c{k}"], "distinct": row[f"d{k}"], "kind": kind}
    most = max((s["distinct"] for s in out.values()), default=1)
    bound = F.lit((2**63 - 1) * SAMPLE // max(SAMPLE, most))
    for name, df in tables.items():
        columns = list(_columns(df))
        if not columns:
            continue
        drawn = [F.collect_set(F.when(F.col(f"`{c}`").isNotNull() & (F.shiftrightunsigned(_hash(c), 1) <= bound), _hash(c))).alias(f"s{k}") for k, c in enumerate(columns)]
        row = df.agg(*drawn).first()
        for k, c in enumerate(columns):
            out[name, c]["sample"] = set(row[f"s{k}"])
    return out


def _no_repeats(tables: dict[str, DataFrame], sets: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, tuple[str, ...]]]:
    """Those sets of columns whose values never occur twice, by one exact count of all."""
    if not sets:
        return []
    values = [tables[t].select(F.lit(k).alias("k"), F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])).alias("value")) for k, (t, columns) in enumerate(sets)]
    counted = reduce(DataFrame.unionAll, values).groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    repeated = {r.k for r in counted.filter("n > 1").select("k").distinct().collect()}
    return [s for k, s in enumerate(sets) if k not in repeated]


def keys(tables: dict[str, DataFrame], known: dict | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """(table, columns) of every column, or pair where a table has no such column, without nulls and repeats.

    Estimates rule most columns and pairs out; what is left is counted exactly, all in one shuffle.
    An empty table has no keys.
    """
    known = known or sketches(tables)
    full = [(t, c) for (t, c), s in known.items() if s["n"] and not s["nulls"]]
    single = _no_repeats(tables, [(t, (c,)) for t, c in full if known[t, c]["distinct"] >= CLOSE * known[t, c]["n"]])
    done, pairs = {t for t, _ in single}, []
    for name, df in tables.items():
        mine = [c for t, c in full if t == name]
        likely = [p for p in combinations(mine, 2) if known[name, p[0]]["distinct"] * known[name, p[1]]["distinct"] >= CLOSE**2 * known[name, p[0]]["n"]]
        if name in done or not likely:
            continue
        row = df.agg(*[F.approx_count_distinct(_hash(*p), 0.02).alias(f"p{k}") for k, p in enumerate(likely)]).first()
        pairs += [(name, p) for k, p in enumerate(likely) if row[f"p{k}"] >= CLOSE * known[name, p[0]]["n"]]
    return single + _no_repeats(tables, pairs)


def links(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, child_column, parent, parent_column, n_values): columns all of whose values are values of another table's key.

    A sampled value of the child that the parent's sample lacks rules a pair out, and so do too many
    distinct values. The rest is decided exactly: every value once with the set of columns that
    hold it (as many as there are columns, however often it occurs), so one shuffle answers all pairs.
    Nulls link with nothing; a column without values has no links.
    """
    known = sketches(tables)
    parents = [(t, c[0]) for t, c in keys(tables, known) if len(c) == 1]
    asked = [(child, p) for child, s in known.items() for p in parents if child[0] != p[0] and s["kind"] == known[p]["kind"] and s["n"] > s["nulls"] and s["distinct"] <= known[p]["distinct"] * 1.15 + 8 and s["sample"] <= known[p]["sample"]]
    spark = next(iter(tables.values())).sparkSession
    schema = "child string, child_column string, parent string, parent_column string, n_values long"
    used = sorted({c for pair in asked for c in pair})
    if not used:
        return spark.createDataFrame([], schema)
    number = {c: k for k, c in enumerate(used)}
    values = [tables[t].filter(F.col(f"`{c}`").isNotNull()).select(F.lit(number[t, c]).alias("column"), F.lit(known[t, c]["kind"]).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for t, c in used]
    held = settled(reduce(DataFrame.unionAll, values).groupBy("kind", "value").agg(F.collect_set("column").alias("held")), "values")
    pairs = spark.createDataFrame([(*child, *parent, number[child], number[parent]) for child, parent in asked], "child string, child_column string, parent string, parent_column string, a int, b int")
    found = held.select(F.explode("held").alias("a"), "held").join(F.broadcast(pairs), "a")
    counted = found.groupBy("child", "child_column", "parent", "parent_column").agg(F.count(F.lit(1)).alias("n_values"), F.min(F.array_contains("held", F.col("b")).cast("int")).alias("whole"))
    return counted.filter("whole = 1").drop("whole")
