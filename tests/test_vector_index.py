"""The stored vector index against exhaustive search."""

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulselake.operators import retrieval, vector_index
from pulselake.sources import tables

D = 8


def clustered(n, seed, clusters=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, D))
    x = middle[rng.integers(0, clusters, n)] + rng.normal(scale=0.05, size=(n, D))
    x[3] = 0
    x[10:14] = x[10]
    return [(k, [float(v) for v in row], k % 5) for k, row in enumerate(x)]


def exhaustive(queries, rows, k):
    out = {}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, x, *_ in queries:
        found = sorted((-round(float(unit(x) @ unit(v)), 12), i) for i, v, *_ in rows)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def shown(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.similarity))
    return out


def equal(found, want):
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert all(math.isclose(a, b, abs_tol=1e-11) for (_, a), (_, b) in zip(found[q], want[q]))


@pytest.fixture(scope="module", params=[None, 16])
def index(spark, request, tmp_path_factory):
    rows, path = clustered(1500, 1), f"file://{tmp_path_factory.mktemp('index')}/i"
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, tag int").repartition(4)
    before, vector_index.BLOCK = vector_index.BLOCK, request.param or vector_index.BLOCK
    vector_index.build(frame, path, D, keep=("tag",), cells=20)
    vector_index.BLOCK = before
    return rows, path


def test_search_is_exact_and_reads_few_cells(spark, index):
    rows, path = index
    queries = clustered(200, 1)[:100] + [(1000 + q, x) for q, x, _ in clustered(60, 2)]
    frame = spark.createDataFrame([r[:2] for r in queries], "query_id long, embedding array<double>").repartition(3)
    found = vector_index.search(frame, path, 7, D)
    equal(shown(found), exhaustive(queries, rows, 7))
    read = {r.query_id: r.cells_read for r in found.select("query_id", "cells_read").distinct().collect()}
    cells = spark.read.parquet(f"{path}/cells").count()
    assert read[3] == cells  # a query of zeros is alike to everything
    near = [read[q] for q in range(100) if q != 3]
    assert np.mean(near) < cells / 2, (np.mean(near), cells)


def test_filtered_search_is_exact(spark, index):
    rows, path = index
    frame = spark.createDataFrame([r[:2] for r in rows[:40]], "query_id long, embedding array<double>")
    for tags, k in (([1, 4], 5), ([2], 400), ([9], 3)):
        want = exhaustive(rows[:40], [r for r in rows if r[2] in tags], k)
        equal(shown(vector_index.search(frame, path, k, D, F.col("tag").isin(tags))), {q: w for q, w in want.items() if w})


def test_vectors_are_stored_by_cell_with_their_bounds(spark, index):
    rows, path = index
    stored = spark.read.parquet(f"{path}/vectors")
    cells = {r.cell: r for r in spark.read.parquet(f"{path}/cells").collect()}
    assert stored.count() == len(rows) == sum(c.n for c in cells.values())
    for r in stored.collect():
        cell = cells[r.cell]
        assert 0 <= r.block < cell.blocks and (r.cell == vector_index.NOWHERE or np.dot(r.unit, cell.centre) >= cell.least - 1e-12)


def test_odd_vectors_find_nothing_and_are_not_found(spark, tmp_path):
    one, nan = [1.0] * D, [float("nan")] + [1.0] * (D - 1)
    odd = [(1, one), (2, None), (3, [1.0]), (4, nan), (5, [None] + one[1:]), (6, [float("inf")] + one[1:]), (None, one), (7, [0.0] * D)]
    frame = spark.createDataFrame(odd, "id long, embedding array<double>")
    asked = spark.createDataFrame(odd + [(1, one)], "query_id long, embedding array<double>")
    assert shown(retrieval.nearest(asked, frame, 5, D)) == {1: [(1, pytest.approx(1.0)), (7, 0.0)], 7: [(1, 0.0), (7, 0.0)]}
    assert retrieval.nearest(asked, frame.limit(0), 5, D).collect() == []
    assert retrieval.nearest(asked.limit(0), frame, 5, D).collect() == []


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Bytes that Spark has put into the shared folder and its own folders since."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv
    own = lambda: {f: f.stat().st_size for d in env.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("*.data")}
    before = own()
    monkeypatch.setitem(tables._own, spark.sparkContext.applicationId, f"file://{tmp_path}")
    return lambda: sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) + sum(n for f, n in own().items() if f not in before)


def test_queries_that_see_all_cells_are_not_written_for_each(spark, written):
    x = np.random.default_rng(4).normal(size=(6000, D))
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)]
    frame = spark.createDataFrame([r[:2] for r in rows], "id long, embedding array<double>").repartition(4).cache()
    frame.count()
    path = tables.scratch(spark, "index")
    vector_index.build(frame, path, D, cells=300)
    found = vector_index.search(frame.withColumnRenamed("id", "query_id"), path, 4, D).cache()
    assert found.agg(F.avg("cells_read")).first()[0] > 30
    assert written() < 6 * x.nbytes, (written(), x.nbytes)
    equal({q: f for q, f in shown(found.filter("query_id < 200")).items()}, exhaustive(rows[:200], rows, 4))


def test_copies_beyond_k_and_single_precision(spark, tmp_path):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(6, D)).astype(np.float32)
    kinds[0] = 0
    rows = [(int(k), [float(v) for v in kinds[k % 11 % 6]], 0) for k in rng.permutation(700)]
    frame = spark.createDataFrame([r[:2] for r in rows], "id long, embedding array<float>").repartition(3)
    asked = [(q, x) for q, x, _ in rows[:90]]
    vector_index.build(frame, str(tmp_path / "i"), D, cells=4)
    found = vector_index.search(spark.createDataFrame(asked, "query_id long, embedding array<float>"), str(tmp_path / "i"), 3, D)
    equal(shown(found), exhaustive(asked, rows, 3))


@pytest.mark.parametrize("k", [1, 4, 60])
def test_best_are_found_where_single_precision_cannot_tell(monkeypatch, k):
    monkeypatch.setattr(vector_index, "ROWS", 7)
    monkeypatch.setattr(vector_index, "PAIRS", 5)
    rng = np.random.default_rng(k)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    middle = unit(rng.normal(size=(3, D)))
    x = unit(middle[rng.integers(0, 3, 40)] + rng.normal(scale=1e-5, size=(40, D)))
    x[5] = 0
    vectors = unit(middle[rng.integers(0, 3, 50)] + rng.normal(scale=1e-5, size=(50, D)))
    vectors[20:32] = vectors[20]
    vectors[40] = 0
    ids, best = rng.permutation(1000)[:50].astype(np.int64), vector_index.Best(40, k)
    queries = np.delete(np.arange(40), 9)
    for at in (0, 17, 34):
        vector_index.compare(best, queries, x, ids[at : at + 17], vectors[at : at + 17])
    similar = np.einsum("qd,vd->qv", x, vectors)
    for q in queries:
        order = np.lexsort((ids, -np.round(similar[q], 12)))[:k]
        assert best.id[q, : len(order)].tolist() == ids[order].tolist()
        assert np.allclose(best.similarity[q, : len(order)], similar[q, order], atol=1e-14)
        assert np.isneginf(best.similarity[q, len(order) :]).all()
    assert np.isneginf(best.similarity[9]).all()


def test_tasks_read_the_row_groups_of_their_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ROW_GROUP", 1024)
    frame = spark.createDataFrame(clustered(1500, 3), "id long, embedding array<double>, tag int")
    vector_index.build(frame, str(tmp_path), D, keep=("tag",), cells=20)
    rows = spark.read.parquet(f"{tmp_path}/vectors")
    stored = vector_index.Stored(rows.inputFiles(), D)
    groups = [g for *_, ranges in stored.files for g in ranges]
    assert len(groups) > 3 and groups == sorted(groups)
    want = {(r.cell, r.id): r.unit for r in rows.filter("cell in (-1, 4, 15)").collect()}
    found = {(cell, int(i)): u.tolist() for cell, ids, units in stored.of(np.array([vector_index.NOWHERE, 4, 15])) for i, u in zip(ids, units)}
    assert found == want and len({cell for cell, _ in found}) == 3


def test_queries_are_held_in_groups():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 18), (18, 20))]
    for size in (1, 5, 7, 20, 50):
        found = [t["n"].to_pylist() for t in vector_index.grouped(iter(batches), size)]
        assert sum(found, []) == list(range(20)) and all(len(n) == size for n in found[:-1]) and 0 < len(found[-1]) <= size


def test_callers_stay_within_allowed_sources():
    allowed, within = ["a", "b"], retrieval.within
    assert within(None, "s", allowed) == within({}, "s", allowed) == within({"s": "x"}, "s", allowed) == within({"s": {"$in": ["x"]}}, "s", allowed) == {"s": {"$in": allowed}}
    assert within({"s": "b"}, "s", allowed) == {"s": "b"} and within({"s": {"$in": ["x", "b"]}}, "s", allowed) == {"s": {"$in": ["b"]}}
    assert within({"t": 1}, "s", allowed) == {"$and": [{"s": {"$in": allowed}}, {"t": 1}]}
