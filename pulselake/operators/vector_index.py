"""A stored vector index: vectors by cell, bounds of each cell, exact search on the executors.

``build`` puts each vector into the cell of its nearest centre and writes the vectors sorted by
cell, beside a table of the cells (at most ``CELLS``) with their centres and the widest angle
from the centre to a vector. ``search`` deals the queries to tasks by their nearest cell, and the
tasks read the cells from the stored files. A query is compared with its nearest cells first; the
k-th best similarity found there tells which other cells can hold better ones, by the angle
between query and centre less the cell's widest, and it is compared with those as well. A task
holds a group of queries and their best so far while the vectors go by, so neither is written
again, whatever the number of cells that a query has to see. Tasks read the files by their URI,
so an index has to be in a store that pyarrow opens (local and mounted folders, ``hdfs``, ``s3``,
``gs``, ``abfs``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulselake.sources.tables import scratch

CELLS, FIT_ROWS, ROUNDS = 4096, 20_000, 8
#: Vectors of a cell that are kept together when cells are dealt to files; bytes of a file that are read or passed over as one.
BLOCK, ROW_GROUP = 8192, 4 << 20
#: Queries that a task holds at once, and those whose cells are told at once; results that it holds at once.
GROUP, QUERIES, RESULTS = 8192, 256, 4 << 20
#: Queries and vectors that are multiplied at once; pairs that are computed exactly at once.
ROWS, COLUMNS, PAIRS = 512, 4096, 32_768
#: Room for rounding when bounds of angles are compared with similarities.
SLACK = 1e-7
#: The cell of vectors without a direction; their similarity to everything is 0.
NOWHERE = -1


def settled(df: DataFrame, kind: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def units(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 0, x / np.where(size > 0, size, 1), 0)


def usable(embedding: str, dimensions: int) -> Column:
    """Vectors of the index's length with finite components only."""
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & finite, F.lit(False))


def vector(rows: DataFrame, name: str) -> Column:
    """The column of vectors: single precision stays as it is, all else becomes double."""
    return F.col(name) if dict(rows.dtypes)[name] == "array<float>" else F.col(name).cast("array<double>").alias(name)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def homes(x: np.ndarray, middles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, similarity to it) of unit vectors; those of zeros are ``NOWHERE``."""
    home, cosine = np.full(len(x), NOWHERE), np.ones(len(x))
    for at in range(0, len(x) if len(middles) else 0, 1024):
        s = x[at : at + 1024] @ middles.T
        home[at : at + 1024], cosine[at : at + 1024] = np.argmax(s, axis=1), np.max(s, axis=1)
    nowhere = ~x.any(axis=1)
    home[nowhere], cosine[nowhere] = NOWHERE, 1.0
    return home, cosine


def centres(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    if len(sample) <= cells:
        return sample
    found = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        home = homes(sample, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def build(collection: DataFrame, path: str, dimensions: int, keep: tuple[str, ...] = (), cells: int | None = None) -> None:
    """Writes the index of (id, embedding, ``keep``...) to ``path``: ``vectors`` sorted by cell, and ``cells``.

    Centres are fitted on a hash sample of about ``FIT_ROWS``; every vector is placed. There are
    as many cells as the root of the number of vectors, ``CELLS`` at most. Vectors of
    another length or with components that are null or not finite, and rows without an id, are
    left out; vectors of zeros have a cell of their own.
    """
    spark, kinds = collection.sparkSession, dict(collection.dtypes)
    rows = collection.select(F.col("id").cast("long"), vector(collection, "embedding"), *keep).filter(F.col("id").isNotNull() & usable("embedding", dimensions))
    n = rows.count()
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 1) <= F.lit((2**63 - 1) * min(FIT_ROWS, n) // max(1, n))
    sample = rows.filter(drawn).select("embedding").toArrow()["embedding"].combine_chunks()
    fitted = units(sample, dimensions) if len(sample) else np.zeros((0, dimensions))
    found = centres(fitted[np.abs(fitted).sum(axis=1) > 0], cells or max(1, min(CELLS, round(n**0.5))))
    # blocks by the sample's share of each cell, the last that of vectors without a direction: they even out files, and nothing else depends on them
    share = np.bincount(homes(fitted, found)[0] % (len(found) + 1), minlength=len(found) + 1) * (n / max(1, len(fitted)))
    blocks = np.maximum(1, np.ceil(share / BLOCK)).astype(np.int32)
    shared = spark.sparkContext.broadcast((found, blocks))
    kept = "".join(f"`{c}` {kinds[c]}, " for c in keep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles, blocks = shared.value
        for batch in batches:
            home, cosine = homes(units(batch.column(1), dimensions), middles)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(blocks[home]), pa.array(cosine)], names=["id", "embedding", *keep, "cell", "blocks", "cosine"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(3, "unit", lists(units(batch.column(3), dimensions)))

    placed = rows.mapInArrow(place, f"id long, embedding {dict(rows.dtypes)['embedding']}, {kept}cell int, blocks int, cosine double")
    dealt = placed.select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "embedding", "cosine", *keep)
    stored = dealt.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(shorten, f"cell int, block int, id long, unit array<double>, cosine double, {kept}".rstrip(", "))
    stored.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/vectors")
    middles = spark.createDataFrame([(k, int(blocks[k]), m.tolist()) for k, m in enumerate(found)] + [(NOWHERE, int(blocks[NOWHERE]), [0.0] * dimensions)], "cell int, blocks int, centre array<double>")
    counted = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    counted.join(middles, "cell").select("cell", "n", "blocks", "least", "centre").coalesce(1).write.parquet(f"{path}/cells")


class Cells:
    """The cells of an index, as many as ``CELLS``: numbers, sizes, centres, widest angles."""

    def __init__(self, spark: SparkSession, path: str, sizes: dict[int, int] | None):
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        rows = [r for r in rows if sizes is None or sizes.get(r.cell)]
        self.cell = np.array([r.cell for r in rows], np.int64)
        self.n = np.array([r.n if sizes is None else sizes[r.cell] for r in rows], np.int64)
        self.centre = np.array([r.centre for r in rows], np.float64)
        self.wide = np.arccos(np.clip(np.array([r.least for r in rows]), -1, 1))

    def near(self, x: np.ndarray) -> np.ndarray:
        """Similarity of unit vectors to the cells' centres."""
        return np.clip(x @ self.centre.T, -1, 1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Greatest possible similarity of unit vectors to a vector of each cell."""
        most = np.cos(np.maximum(0, np.arccos(self.near(x)) - self.wide))
        most[:, self.cell == NOWHERE] = 0
        most[~x.any(axis=1)] = 0
        return most

    def first(self, x: np.ndarray, k: int) -> np.ndarray:
        """True for the nearest cells that hold ``k`` vectors together."""
        order = np.argsort(-self.near(x), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        found = np.zeros(order.shape, bool)
        np.put_along_axis(found, order, before < k, axis=1)
        return found


class Best:
    """The ``k`` vectors of greatest similarity that each query has met, best first; of equals (to twelve places) those of smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.similarity = np.full((queries, k), -np.inf)
        #: The k-th similarity to twelve places; a vector of less is not among the best.
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, id: np.ndarray, similarity: np.ndarray) -> None:
        met = np.unique(query)
        query = np.concatenate([np.repeat(met, self.k), query])
        id = np.concatenate([self.id[met].ravel(), id])
        similarity = np.concatenate([self.similarity[met].ravel(), similarity])
        order = np.lexsort((id, -np.round(similarity, 12), query))
        start = np.searchsorted(query[order], met)
        order = order[(start[:, None] + np.arange(self.k)).ravel()]
        self.id[met], self.similarity[met] = id[order].reshape(-1, self.k), similarity[order].reshape(-1, self.k)
        self.floor[met] = np.round(self.similarity[met, -1], 12)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, the kind of each row), where rows of equal bytes are one kind."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, one, kind = np.unique(rows, return_index=True, return_inverse=True)
    return one, kind


def first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of equal rows, ascending."""
    one, kind = distinct(x)
    if len(one) == len(x):
        return np.arange(len(x))
    order = np.argsort(kind, kind="stable")
    start = np.searchsorted(kind[order], np.arange(len(one)))
    return np.sort(order[np.arange(len(x)) - start[kind[order]] < k])


def compare(best: Best, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Takes ``vectors`` among the ``best`` of those rows of ``x`` that ``queries`` names (ascending).

    Products in single precision, whose error is less than ``slack``, leave out what cannot be
    among the best; the rest is computed pair by pair in double precision, alike for equal vectors.
    """
    order = np.argsort(ids, kind="stable")
    if len(ids) > best.k:  # more copies of a vector than are wanted change nothing
        order = order[first_copies(vectors[order], best.k)]
    ids, vectors = ids[order], vectors[order]
    slack = (x.shape[1] + 8) * 2.0**-23
    short, room = np.ascontiguousarray(vectors.T, np.float32), np.empty((min(ROWS, len(queries)), len(ids)), np.float32)
    for at in range(0, len(queries), ROWS):
        part = queries[at : at + ROWS]
        similar = np.matmul(x[part].astype(np.float32), short, out=room[: len(part)])
        least = best.floor[part] - slack
        new = np.flatnonzero(np.isinf(least))
        if len(new) and len(ids) > best.k:
            least[new] = np.partition(similar[new], -best.k, axis=1)[:, -best.k] - 2 * slack
        some = np.flatnonzero(similar.max(axis=1) >= least)
        row, column = np.nonzero(similar[some] >= least[some, None])
        row = part[some[row]]
        for i in range(0, len(row), PAIRS):
            query, other = row[i : i + PAIRS], column[i : i + PAIRS]
            exact = np.einsum("ij,ij->i", x[query], vectors[other])
            good = np.round(exact, 12) >= best.floor[query]
            if good.any():
                best.add(query[good], ids[other[good]], exact[good])


class Stored:
    """The files of an index's vectors, as a task reads them."""

    def __init__(self, uris: list[str], dimensions: int):
        self.dimensions, self.files = dimensions, []
        for uri in uris:
            store, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            with store.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
            groups = [footer.row_group(g) for g in range(footer.num_row_groups)]
            cell = [next(c for c in map(g.column, range(g.num_columns)) if c.path_in_schema == "cell").statistics for g in groups]
            self.files.append((store, path, footer, [(c.min, c.max) if c is not None and c.has_min_max else (NOWHERE, CELLS) for c in cell]))

    def of(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, ids, vectors) of ``cells`` (ascending), some thousand at a time; row groups without them are passed over."""
        rows = max(1, min(COLUMNS, (1 << 21) // self.dimensions))
        for store, path, footer, ranges in self.files:
            groups = [g for g, (low, high) in enumerate(ranges) if np.searchsorted(cells, low) < np.searchsorted(cells, high, "right")]
            if not groups:
                continue
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file, metadata=footer).iter_batches(rows, groups, ["cell", "id", "unit"], use_threads=False):
                    cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
                    vectors = batch.column("unit").flatten().to_numpy().reshape(len(ids), self.dimensions)
                    edges = [0, *np.flatnonzero(np.diff(cell)) + 1, len(cell)]
                    for i, j in zip(edges, edges[1:]):
                        if np.searchsorted(cells, cell[i]) < np.searchsorted(cells, cell[i], "right"):
                            yield int(cell[i]), ids[i:j], vectors[i:j]


def answers(x: np.ndarray, cells: Cells, stored: Stored, k: int) -> tuple[Best, np.ndarray]:
    """(the best, the number of cells compared with) of unit vectors."""
    best, first, more = Best(len(x), k), *np.zeros((2, len(x), len(cells.cell)), bool)

    def meet(visit: np.ndarray) -> None:
        for cell, ids, vectors in stored.of(cells.cell[visit.any(axis=0)]):
            compare(best, np.flatnonzero(visit[:, np.searchsorted(cells.cell, cell)]), x, ids, vectors)

    for at in range(0, len(x), QUERIES):
        first[at : at + QUERIES] = cells.first(x[at : at + QUERIES], k)
    meet(first)
    for at in range(0, len(x), QUERIES):
        more[at : at + QUERIES] = cells.bounds(x[at : at + QUERIES]) >= best.floor[at : at + QUERIES, None] - SLACK
    more &= ~first
    meet(more)
    return best, first.sum(axis=1) + more.sum(axis=1)


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of ``size``, the last with the rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while sum(map(len, held)) + len(batch) >= size:
            room = size - sum(map(len, held))
            yield pa.Table.from_batches([*held, batch.slice(0, room)])
            held, batch = [], batch.slice(room)
        held += [batch] if len(batch) else []
    if held:
        yield pa.Table.from_batches(held)


def search(queries: DataFrame, path: str, k: int, dimensions: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, rank, cells_read): the ``k`` vectors of greatest cosine for each query, exactly.

    Ties (to twelve places) go to the smaller id; ``where`` filters by kept columns before the
    search; queries of another length or with components that are null or not finite find
    nothing; a query of zeros is alike (0) to all; with fewer vectors than ``k`` all are found;
    several queries of one id count as one, the least. An empty index or table gives an empty
    result. ``cells_read`` is the number of cells that the query was compared with.
    """
    spark, sizes = queries.sparkSession, None
    vectors = spark.read.parquet(f"{path}/vectors")
    if where is not None:
        kept = scratch(spark, "kept")
        vectors.filter(where).select("cell", "id", "unit").write.option("parquet.block.size", ROW_GROUP).parquet(kept)
        vectors = spark.read.schema("cell int, id long, unit array<double>").parquet(kept)
        sizes = {r.cell: r.n for r in vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    uris, cells = vectors.inputFiles(), Cells(spark, path, sizes)
    k = max(1, min(k, int(cells.n.sum())))
    group = max(1, min(GROUP, RESULTS // k))
    shared = spark.sparkContext.broadcast((cells, uris))
    asked = queries.select(F.col("query_id").cast("long"), vector(queries, "embedding")).filter(F.col("query_id").isNotNull() & usable("embedding", dimensions))
    n, most = asked.groupBy("query_id").count().agg(F.count(F.lit(1)), F.max("count")).first()
    if (most or 0) > 1:
        asked = asked.groupBy("query_id").agg(F.min("embedding").alias("embedding"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles = shared.value[0].centre
        for batch in batches:
            yield batch.append_column("home", pa.array(homes(units(batch.column(1), dimensions), middles)[0].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, uris = shared.value
        stored = Stored(uris, dimensions) if len(cells.cell) else None
        for rows in grouped(batches, group) if stored else ():
            x = units(rows["embedding"].combine_chunks(), dimensions)
            one, kind = distinct(x)
            best, read = answers(x[one], cells, stored, k)
            names = rows["query_id"].to_numpy()
            for at in range(0, len(x), max(1, 65_536 // k)):
                some = kind[at : at + max(1, 65_536 // k)]
                row, rank = np.nonzero(best.similarity[some] > -np.inf)
                found = (names[at + row], best.id[some[row], rank], best.similarity[some[row], rank], (rank + 1).astype(np.int32), read[some[row]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "id", "similarity", "rank", "cells_read"])

    # as many tasks as groups, and some for each core if there are queries for them
    tasks = max(1, -(-n * 4 // (group * 3)), min(-(-n // QUERIES), 3 * spark.sparkContext.defaultParallelism))
    placed = asked.mapInArrow(place, f"query_id long, embedding {dict(asked.dtypes)['embedding']}, home int")
    return placed.repartitionByRange(tasks, "home", "query_id").mapInArrow(run, "query_id long, id long, similarity double, rank int, cells_read long")
