"""Exact nearest neighbours within series of any size, by cells with bounds.

Points of a series go to the nearest of its pivots (hash-drawn points, one for about
``CELL_ROWS`` points); a cell knows how far its points reach. A point is compared with its own
cell first; the distance of its k-th neighbour there tells which other cells can hold nearer
ones (the distance to their pivot less their reach). Cells are dealt in blocks, and points
stream past them, so a task holds one block or the pivots of one series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulselake.operators.vector_index import settled

#: Points of a cell, about; cells of a series at most; points of a block; points that look for pivots together.
CELL_ROWS, CELLS, BLOCK, DEALT = 2048, 4096, 4096, 32_768
#: Points that are compared at once.
AT_ONCE = 256


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, without an array of differences."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += np.square(a[:, k : k + 1] - b[:, k])
    return np.sqrt(total)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table | None, pa.RecordBatch]]:
    """Of rows sorted by ``keys`` and ``side``: the rows of side 0 of a key, with each run of its rows of side 1."""
    key, held, table = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        where = list(zip(*(batch.column(k).to_pylist() for k in keys), batch.column("side").to_pylist()))
        edges = [0, *[i for i in range(1, len(where)) if where[i] != where[i - 1]], len(where)]
        for i, j in zip(edges, edges[1:]):
            if where[i][:-1] != key:
                key, held, table = where[i][:-1], [], None
            if where[i][-1] == 0:
                held.append(batch.slice(i, j - i))
                table = None
            else:
                if table is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                yield table, batch.slice(i, j - i)


def _meet(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    both = one.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "side", "id")


def _compared(pairs: DataFrame, placed: DataFrame, k: int, width: int) -> DataFrame:
    """(id, near, distance): the ``k`` nearest of each visited block, not counting the point itself."""
    schema = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in met(batches, ["cell", "block"]):
            ids = block.column("id").to_numpy()
            points = matrix(block.column("x").combine_chunks(), width)
            mine, x = rows.column("id").to_numpy(), matrix(rows.column("x"), width)
            for at in range(0, len(mine), AT_ONCE):
                away = distances(x[at : at + AT_ONCE], points)
                away[mine[at : at + AT_ONCE, None] == ids] = np.inf
                least = np.partition(away, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1 : min(k, len(ids))]
                below, level = away < least, (away == least) & np.isfinite(away)
                chosen = below | (level & (np.cumsum(level, axis=1) <= k - below.sum(axis=1, keepdims=True)))
                row, column = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(mine[at : at + AT_ONCE][row]), pa.array(ids[column]), pa.array(away[row, column])], schema=schema)

    found = _meet(placed.select("cell", "block", "id", "x"), pairs.select("cell", "block", "id", "x"), ["cell", "block"]).mapInArrow(run, "id long, near long, distance double")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "near")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("id", "near", "distance", "place")


def nearest_points(points: DataFrame, k: int, width: int) -> DataFrame:
    """(id, near, distance, place): the ``k`` nearest other points of the same ``g`` for each of (id, g, x), or all if there are fewer.

    ``id`` is unique; ``x`` holds ``width`` finite numbers; equal distances go by ``id``.
    """
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(7), "id"), 1)
    sizes = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("least"))
    sizes = sizes.select("g", "least", F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(CELLS)).alias("cells"), F.col("n"), F.least(F.ceil(F.col("n") / DEALT), F.lit(256)).alias("deals"))
    known = settled(points.join(sizes, "g").withColumn("deal", F.pmod(F.xxhash64(F.lit(8), "id"), "deals").cast("int")).select("id", "g", "x", "deal", "deals", spot.alias("spot"), "least", "cells", "n"), "points")
    drawn = (F.col("spot") == F.col("least")) | (F.col("spot") < F.col("cells") / F.col("n") * float(2**63))
    deals = F.explode(F.sequence(F.lit(0), F.col("deals").cast("int") - 1)).alias("deal")
    pivots = settled(known.filter(drawn).select(F.col("id"), "g", "x", "deals"), "pivots")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in met(batches, ["g", "deal"]):
            names, centres = held.column("id").to_numpy(), matrix(held.column("x").combine_chunks(), width)
            x = matrix(rows.column("x"), width)
            for at in range(0, len(x), AT_ONCE):
                away = distances(x[at : at + AT_ONCE], centres)
                at_home = np.argmin(away, axis=1)
                part = rows.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "g", "x", "deal")], pa.array(names[at_home]), pa.array(away[np.arange(len(away)), at_home])], names=["id", "g", "x", "deal", "cell", "away"])

    placed = settled(_meet(pivots.select("id", "g", "x", deals), known.select("id", "g", "x", "deal"), ["g", "deal"]).mapInArrow(home, "id long, g long, x array<double>, deal int, cell long, away double"), "placed")
    reach = placed.groupBy("cell").agg(F.max("away").alias("reach"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = settled(pivots.join(reach, pivots["id"] == reach["cell"]).select("id", "g", "x", "deals", "reach", "blocks"), "cells")
    placed = placed.join(cells.select(F.col("id").alias("cell"), "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "id"), "blocks").cast("int"))
    own = placed.select("id", "x", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = settled(_compared(own, placed, k, width), "near")
    bounds = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    asking = placed.join(bounds, "id", "left").select("id", "g", "x", "deal", F.col("cell").alias("home"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in met(batches, ["g", "deal"]):
            names, centres = held.column("id").to_numpy(), matrix(held.column("x").combine_chunks(), width)
            far, blocks = held.column("reach").to_numpy(), held.column("blocks").to_numpy()
            x = matrix(rows.column("x"), width)
            for at in range(0, len(x), AT_ONCE):
                part = rows.slice(at, AT_ONCE)
                bound, at_home = part.column("bound").to_numpy()[:, None], part.column("home").to_numpy()[:, None]
                least = distances(x[at : at + AT_ONCE], centres) - far
                row, cell = np.nonzero((least <= bound + 1e-9 * (1 + np.abs(bound))) & (names != at_home))
                many = blocks[cell]
                block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), part.column("x").take(pa.array(row)), pa.array(names[cell]), pa.array(block.astype(np.int32))], names=["id", "x", "cell", "block"])

    visits = _meet(cells.select("id", "g", "x", "reach", "blocks", deals), asking, ["g", "deal"]).mapInArrow(others, "id long, x array<double>, cell long, block int")
    found = near.drop("place").unionByName(_compared(visits, placed, k, width).drop("place"))
    return _first(found, k)
