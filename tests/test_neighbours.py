"""Nearest points and local outlier factors against all distances."""

import numpy as np
import pytest

from pulselake.operators import neighbours
from pulselake.operators.anomaly import local_outlier_factor


@pytest.fixture(params=["small cells", "as they are"])
def cells(request, monkeypatch):
    if request.param == "small cells":
        for name, value in (("CELL_ROWS", 30), ("BLOCK", 16), ("DEALT", 100)):
            monkeypatch.setattr(neighbours, name, value)
    return request.param


def points(seed):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in ((10, 400), (20, 1), (30, 2), (40, 6), (50, 150)):
        x = np.round(rng.normal(size=(n, 2)) * rng.choice([0.1, 3], (n, 1)), 1 if g == 50 else 6)
        x[: n // 3] = x[0]  # a third is one point
        out += [(g, tuple(map(float, p))) for p in x]
    return [(i, g, list(p)) for i, (g, p) in enumerate(out)]


def test_nearest_points_equal_all_distances(spark, cells):
    rows = points(1)
    frame = spark.createDataFrame(rows, "id long, g long, x array<double>").repartition(5)
    found = {}
    for r in neighbours.nearest_points(frame, 5, 2).orderBy("id", "place").collect():
        found.setdefault(r.id, []).append((r.distance, r.near))
    want = {}
    for i, g, x in rows:
        others = sorted((float(np.sqrt(np.square(x[0] - y[0]) + np.square(x[1] - y[1]))), j) for j, h, y in rows if h == g and j != i)
        if others:
            want[i] = others[:5]
    assert found == want


def plain_factors(x, k=5, contamination=0.15):
    if len(x) == 1:
        return [1.0], [False]
    near = min(k, len(x) - 1)
    distance = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    others = distance + np.where(np.eye(len(x), dtype=bool), np.inf, 0)
    order = np.argsort(others, axis=1, kind="stable")[:, :near]
    k_distance = np.take_along_axis(others, order[:, -1:], axis=1)[:, 0]
    density = 1 / (np.maximum(k_distance[order], np.take_along_axis(others, order, axis=1)).mean(axis=1) + 1e-10)
    own = np.argsort(distance, axis=1, kind="stable")[:, :near]
    reach = np.maximum(k_distance[own], np.take_along_axis(distance, own, axis=1))
    factor = (density[own] * (reach.mean(axis=1) + 1e-10)[:, None]).mean(axis=1)
    cut = np.percentile((density[order] / density[:, None]).mean(axis=1), 100 * (1 - contamination))
    return factor.tolist(), (factor > cut).tolist()


def test_outlier_factors_equal_all_distances(spark, cells):
    rows = points(2)
    frame = spark.createDataFrame([(None if g == 40 else g, i, *x) for i, g, x in rows], "s long, day long, a double, b double").repartition(3)
    found = {(r.s, r.day): (r.lof, r.lof_flag) for r in local_outlier_factor(frame, "day", ["a", "b"], ["s"]).collect()}
    assert len(found) == len(rows)
    for group in {g for _, g, _ in rows}:
        mine = [(i, x) for i, g, x in rows if g == group]
        lof, flag = plain_factors(np.array([x for _, x in mine]))
        close = 0
        for (i, _), f, o in zip(mine, lof, flag):
            got = found[None if group == 40 else group, i]
            assert got[0] == pytest.approx(f, rel=1e-6)
            close += got[1] == o
        assert close >= len(mine) - 1  # a factor at the cut may fall on either side by rounding
    assert local_outlier_factor(frame.limit(0), "day", ["a", "b"], ["s"]).collect() == []
