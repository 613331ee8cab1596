"""Keys and links of the star schema, found from its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulselake.operators import keys
from pulselake.plans.registry import query
from pulselake.session import table

#: Tables and the whole-number, text and date columns that the SQL asks about.
_TABLES = {
    "region": {"r_regionkey": 1, "r_name": 2},
    "nation": {"n_nationkey": 1, "n_name": 2, "n_regionkey": 1},
    "customer": {"c_custkey": 1, "c_name": 2, "c_nationkey": 1, "c_mktsegment": 2},
    "orders": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 2, "o_orderpriority": 2},
    "lineitem": {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_returnflag": 2, "l_linestatus": 2},
    "part": {"p_partkey": 1, "p_name": 2},
    "supplier": {"s_suppkey": 1, "s_name": 2, "s_nationkey": 1},
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t).select(*columns) for t, columns in _TABLES.items()}


def _one(t: str, c: str) -> str:
    return f"SELECT '{t}' AS name, '{c}' AS columns, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS yes FROM {t}"


_SINGLE = " UNION ALL ".join(_one(t, c) for t, columns in _TABLES.items() for c in columns)
_PAIRS = " UNION ALL ".join(
    f"SELECT '{t}', '{a},{b}', count({a}) = count(*) AND count({b}) = count(*) AND count(DISTINCT ({a}, {b})) = count(*) FROM {t}" for t, columns in _TABLES.items() for a in columns for b in columns if list(columns).index(a) < list(columns).index(b)
)


@query(f"WITH s AS ({_SINGLE}), p(name, columns, yes) AS ({_PAIRS}) SELECT name, columns FROM s WHERE yes UNION ALL SELECT name, columns FROM p WHERE yes AND name NOT IN (SELECT name FROM s WHERE yes)")
def n1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, or pairs of columns, that tell a table's rows apart."""
    found = keys.keys(_tables(spark, sf_dir))
    return spark.createDataFrame([(t, ",".join(c)) for t, c in found], "name string, columns string")


_PARENTS = [(t, c) for t, columns in _TABLES.items() for c in columns]


@query(f"WITH k AS ({_SINGLE}), l AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS child, '{c}' AS child_column, '{p}' AS parent, '{q}' AS parent_column, count(DISTINCT {c}) AS n_values, count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {q} FROM {p} WHERE {q} IS NOT NULL)) AS strangers FROM {t}"
    for t, c in _PARENTS for p, q in _PARENTS if t != p and _TABLES[t][c] == _TABLES[p][q]
) + ") SELECT child, child_column, parent, parent_column, n_values FROM l JOIN k ON k.name = parent AND k.columns = parent_column AND yes WHERE strangers = 0 AND n_values > 0")
def n1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose values all are keys of another table."""
    return keys.links(_tables(spark, sf_dir))
