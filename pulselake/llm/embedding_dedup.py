"""Embedding near-dedup: spherical k-means cells, blocked cosines inside cells, exact links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulselake.llm.common import materialise
from pulselake.llm.graph import components

#: Vectors that the cells are fitted on, at most.
FIT_ROWS = 20_000
#: Vectors at home in a cell that a task holds at most, fewest of a cell, and vectors streamed past at once.
BLOCK, SMALLEST, STREAM = 32_768, 512, 1024
#: Cells at least, as long as none gets smaller than ``SMALLEST``, and at most.
CELLS, MOST_CELLS = 24, 4096


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


def unit_vector(values: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or has a null or non-finite component."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (x != 0).any():
        return None
    x = x / np.abs(x).max()  # no overflow or underflow in the norm
    return x / math.sqrt(x @ x)


def normalise(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit binary) of every row; unit is null for unusable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit_vector(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], names=["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, unit binary")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def assign_cells(units: DataFrame, centers: dict[int, np.ndarray], least: float) -> DataFrame:
    """(rep, weight, unit, cell, home): each vector in its nearest cell, and in those where a partner may be at home.

    If y's nearest centre is d and x's is c, then y lies on d's side of the plane between
    c and d; x can have cosine >= ``least`` with such a y only if its distance to that plane,
    (x.c - x.d) / |c - d|, is at most sin(acos(``least``)). So no link is lost.
    """
    reach = math.sqrt(1 - least * least) + 1e-9
    apart = {size: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) for size, c in centers.items()}
    shared = units.sparkSession.sparkContext.broadcast((centers, apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, apart = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                blobs = part.column(2).to_pylist()
                rows, cells, homes = [], [], []
                for size in {len(b) for b in blobs}:
                    at = np.array([i for i, b in enumerate(blobs) if len(b) == size])
                    c, gaps = (centers[size // 8], apart[size // 8]) if size // 8 in centers else (np.eye(1, size // 8), np.zeros((1, 1)))
                    dots = _matrix([blobs[i] for i in at]) @ c.T
                    home = dots.argmax(axis=1)
                    near = dots[np.arange(len(at)), home][:, None] - dots <= reach * gaps[home] + 1e-9
                    near[np.arange(len(at)), home] = True
                    i, k = np.nonzero(near)
                    rows.append(at[i])
                    cells.append(k + size * 1_000_000)
                    homes.append(home[i] == k)
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))],
                    names=["rep", "weight", "unit", "cell", "home"],
                )

    return units.select("rep", "weight", "unit").mapInArrow(run, "rep long, weight long, unit binary, cell long, home boolean")


def _linked(block: tuple[np.ndarray, np.ndarray], part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``part``, rows of ``block``, which of them have cosine >= ``least``).

    Single precision leaves out all that is clearly below; double precision decides the rest.
    """
    whole, single = block
    slack = 1e-6 + 1.2e-7 * whole.shape[1]
    dots = part.astype(np.float32) @ single.T
    likely = dots >= np.float32(least - slack)
    rows = np.flatnonzero(likely.any(axis=1))
    columns = np.flatnonzero(likely[rows].any(axis=0))
    dots = dots[np.ix_(rows, columns)]
    linked = dots >= least + slack
    i, j = np.nonzero(np.abs(dots - least) <= slack)
    linked[i, j] = np.einsum("ij,ij->i", part[rows[i]], whole[columns[j]]) >= least
    return rows, columns, linked


def compare_cells(members: DataFrame, least: float) -> DataFrame:
    """Links found in each cell, as sums and a spanning forest: (rep, links, root).

    ``members``: cell, block, side, rep, weight, unit, sorted into groups of a cell and block.
    A group begins with its block of vectors at home (side 0, bounded), which is held; all
    vectors of the cell (side 1) are streamed past it. A streamed vector gets the weight
    of what it links to in the block, so each link counts once in each direction, where
    the partner is at home. The output grows with the rows and not with the links.
    """

    def compare(home: list, rep: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        mine, weights, block = home
        rows, columns, linked = _linked(block, part, least)
        rep, mine = rep[rows], mine[columns]
        linked &= rep[:, None] != mine[None, :]
        links = linked @ weights[columns]
        some, near = linked.any(axis=1), linked.any(axis=0)
        rep, links, mine, linked = rep[some], links[some], mine[near], linked[some][:, near]
        root, other, far = rep, mine, np.iinfo(np.int64).max
        while len(rep):
            low = np.minimum(root, np.where(linked, other[None, :], far).min(axis=1))
            lower = np.minimum(other, np.where(linked, low[:, None], far).min(axis=0))
            if (low == root).all() and (lower == other).all():
                break
            root, other = low, lower
        out = (np.concatenate((rep, mine)), np.concatenate((links, np.zeros(len(mine), np.int64))), np.concatenate((root, other)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, home = None, [], None
        for batch in batches:
            cell, block, side, rep, weight = (batch.column(k).to_numpy() for k in range(5))
            edges = np.flatnonzero(np.diff(cell) | np.diff(block) | np.diff(side)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if hi == lo:
                    continue
                if now != (cell[lo], block[lo]):
                    now, parts, home = (cell[lo], block[lo]), [], None
                if side[lo] == 0:
                    parts.append((rep[lo:hi].copy(), weight[lo:hi].copy(), _matrix(batch.column(5).slice(lo, hi - lo).to_pylist())))
                    continue
                if home is None:
                    whole = np.concatenate([p[2] for p in parts])
                    home = [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), (whole, whole.astype(np.float32))]
                    parts = []
                for at in range(lo, hi, STREAM):
                    end = min(hi, at + STREAM)
                    yield compare(home, rep[at:end], _matrix(batch.column(5).slice(at, end - at).to_pylist()))

    ordered = members.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    return ordered.mapInArrow(run, "rep long, links long, root long")


def embedding_duplicates(vectors: DataFrame, least: float = 0.95, rows_per_cell: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Equal directions first fall together by their unit vector's bytes. Cells come from
    spherical k-means on a bounded hash sample (``FIT_ROWS``); a vector is compared within
    its cell and in those where a partner may be at home (``assign_cells``). Cells are as large
    as a task can hold (``BLOCK``), or smaller where that would make fewer than ``CELLS`` of
    them; a task holds the vectors at home in a cell, and those placed in it stream past once.
    A larger cell is dealt into blocks, so neither a hot cell nor a large group of copies is
    held whole. All links with cosine >= ``least`` in double precision are found and none below.

    Where vectors are clustered, one is placed in few cells. Where they are scattered, no exact
    bound keeps it out of most: rows that stream then grow with rows * rows / ``BLOCK``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing; vectors of different lengths do not link. Repeated rows of one ``vec_id`` and
    vector link with each other; a null ``vec_id`` counts as a link of others but its own
    component is null and it is kept. Empty input gives an empty result.
    """
    spark = vectors.sparkSession
    units = materialise(normalise(vectors).withColumn("digest", F.sha2("unit", 256)))
    groups = materialise(units.filter("unit is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")))
    members = groups.filter("rep is not null")
    n = members.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    sample = members.filter(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(share * 1_000_000)).select("unit").orderBy("unit").limit(FIT_ROWS).collect()
    by_length: dict[int, list[bytes]] = {}
    for row in sample:
        by_length.setdefault(len(row.unit) // 8, []).append(bytes(row.unit))
    held = rows_per_cell or min(BLOCK, max(SMALLEST, n // CELLS))
    cells = max(1, min(MOST_CELLS, n // held))
    centers = {size: fit_cells(_matrix(blobs), cells) for size, blobs in by_length.items()}
    placed = materialise(assign_cells(members, centers, least))
    sizes = placed.filter("home").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / min(BLOCK, 2 * held)).cast("int").alias("blocks"))
    spread = placed.join(F.broadcast(sizes), "cell")
    at_home = spread.filter("home").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("side", F.lit(0))
    passing = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    columns = ["cell", "block", "side", "rep", "weight", "unit"]
    found = materialise(compare_cells(at_home.select(*columns).union(passing.select(*columns)), least))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.filter("rep != root").select("rep", "root").distinct(), "rep", "root").withColumnRenamed("node", "rep")
    named = materialise(members.join(links, "rep", "left").join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    usable = units.filter("unit is not null").select("vec_id", "digest").join(named, "digest", "left").select("vec_id", "component_id", "n_links")
    others = units.filter("unit is null").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return usable.union(others).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
