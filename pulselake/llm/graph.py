"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulselake.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node.

    Randomised contraction: each node is merged into the node of lowest hash among itself and
    its neighbours, links are redrawn between what nodes were merged into, and those inside one
    node go. A link to the node merged into is redrawn as well, so nothing comes apart. Nodes
    are expected to fall by a quarter or more in every second round, as the hash is then a new
    one, so all rounds together handle rows in proportion to the links, whatever the length of
    chains; a star is one node after two rounds. Rounds are written to the shared folder.
    Joins on a hub's key have plain exchanges on both sides, which adaptive execution can
    split. Nothing reaches the driver but whether links are left.
    """
    tidy = lambda df, x, y: materialise(df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a != b").distinct())
    left = tidy(links, a, b)
    merged: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c, seed=len(merged) // 2: F.struct(F.xxhash64(F.lit(seed), c).alias("hash"), F.col(c).alias("node"))
        both = left.union(left.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        into = materialise(lowest.select(F.col("a").alias("node"), F.least("near", rank("a"))["node"].alias("component")))
        of = lambda side, t=into: t.select(F.col("node").alias(side), F.col("component").alias(f"into_{side}"))
        left = tidy(left.join(of("a"), "a").join(of("b"), "b"), "into_a", "into_b")
        merged.append(into)
    if not merged:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = merged.pop()
    while merged:
        later = named.select(F.col("node").alias("component"), F.col("component").alias("last"))
        named = merged.pop().join(later, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    named = materialise(named)
    smallest = named.groupBy("component").agg(F.min("node").alias("smallest"))
    return named.join(smallest, "component").select("node", F.col("smallest").alias("component"))


def cross_blocks(members: DataFrame, node: str, weight: Column, size: int) -> DataFrame:
    """Deals the members of each bucket (``key``) so that any two of different ``component`` meet: adds (block, other, side).

    Rows of one (key, block, other) are compared with each other, side 0 with side 1, or all
    if ``block`` equals ``other``. A bucket of up to ``size`` in sum of ``weight`` (a whole
    number) is one block. In a larger one the heaviest component, whose members need not meet
    each other, is dealt into blocks of its own (negative ``block``), which only the blocks of
    the rest meet; so rows grow with its size times the blocks of the rest.
    """
    weighed = members.withColumn("_weight", weight.cast("long"))
    parts = weighed.groupBy("key", "component").agg(F.sum("_weight").alias("w"))
    top = F.max(F.struct("w", "component"))
    sums = parts.groupBy("key").agg(top.alias("top"), F.sum("w").alias("w"))
    count = lambda w: F.greatest(F.ceil(w / F.lit(size)), F.lit(1)).cast("int")
    counts = sums.select("key", F.col("top.component").alias("_top"), count(F.col("top.w")).alias("_main"), count(F.col("w") - F.col("top.w")).alias("_rest"), (F.col("w") <= size).alias("_one"))

    spot = F.xxhash64(F.lit(5), node)
    pair = lambda block, other, side: F.struct(block.alias("block"), other.alias("other"), side.cast("int").alias("side"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    u, v, zero = F.pmod(spot, "_main").cast("int"), F.pmod(spot, "_rest").cast("int"), F.lit(0)
    main = F.transform(numbers("_rest"), lambda k: pair(-1 - u, k, zero))
    rest = F.concat(
        F.transform(numbers("_main"), lambda k: pair(-1 - k, v, F.lit(1))),
        F.transform(numbers("_rest"), lambda k: pair(F.least(v, k), F.greatest(v, k), v > k)),
    )
    pairs = F.when(F.col("_one"), F.array(pair(zero, zero, zero))).when(F.col("component") == F.col("_top"), main).otherwise(rest)
    placed = weighed.join(counts, "key").withColumn("_pair", F.explode(pairs))
    return placed.select(*members.columns, "_pair.block", "_pair.other", "_pair.side")
