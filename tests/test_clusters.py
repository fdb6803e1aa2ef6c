"""Density clusters by cells against all pairs of points."""

import math

import numpy as np
import pytest

from tamarack.operators import clusters


def brute(rows, eps, mps):
    """Cluster numbers by id, from the whole matrix of distances."""
    good = sorted(r for r in rows if all(x is not None and math.isfinite(x) for x in r[1:]))
    ids, x = [r[0] for r in good], np.array([r[1:] for r in good], float).reshape(len(good), -1)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= mps
    root = np.where(core, np.arange(len(ids)), len(ids))
    for _ in ids:
        root = np.where(core, np.min(np.where(near & core[None], root[None], len(ids)), axis=1, initial=len(ids)), len(ids))
    every = np.min(np.where(near & core[None], root[None], len(ids)), axis=1, initial=len(ids))
    root = np.where(core, root, every)
    names, sizes = np.unique(root, return_counts=True)
    kept = [r for r, n in zip(names, sizes) if r < len(ids) and n >= mps]
    numbers = {r: i + 1 for i, r in enumerate(kept)}
    return {r[0]: -1 for r in rows} | {i: numbers.get(r, -1) for i, r in zip(ids, root)}


def found(spark, rows, eps, mps):
    names = [f"c{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "cell long, " + ", ".join(f"{n} double" for n in names))
    out = clusters.dbscan(df, eps, mps, "cell", names).collect()
    assert all(r["score"] == (r["cluster"] > 0) for r in out) and len(out) == len(rows)
    return {r["id"]: r["cluster"] for r in out}


@pytest.mark.parametrize(("slots", "eps", "mps"), [(1, 0.02, 4), (2, 0.15, 5), (3, 0.3, 4), (5, 0.9, 3), (2, 0.02, 1)])
def test_against_all_pairs(spark, monkeypatch, slots, eps, mps):
    monkeypatch.setattr(clusters, "PART", 8)  # full cells stand under several keys
    rng = np.random.default_rng(slots)
    x = np.concatenate([rng.normal(0, 1, (150, slots)), np.tile(rng.normal(0, 1, slots), (80, 1)), rng.normal(0.5, 0.03, (70, slots))])
    order = rng.permutation(len(x))
    rows = [(int(i), *map(float, v)) for i, v in zip(order, x)]
    rows += [(1000 + i, *[v] * slots) for i, v in enumerate((None, math.nan, math.inf, -math.inf))]
    assert found(spark, rows, eps, mps) == brute(rows, eps, mps)


def test_cells_that_only_inner_points_link(spark):
    """The ends of the slots are far from the other cell; a point between them is near it."""
    eps, mps = 1.0, 3
    left = [(0, 0.30, 0.02), (1, 0.69, 0.30), (2, 0.02, 0.69), (3, 0.60, 0.60)]
    right = [(4, 1.45, 1.69), (5, 1.98, 1.43), (6, 1.69, 1.98)]
    for shift in (0.0, -0.12, -0.2, -0.3, 0.3):
        rows = left + [(i, a + shift, b + shift) for i, a, b in right]
        assert found(spark, rows, eps, mps) == brute(rows, eps, mps), shift


def test_rings_and_grids(spark):
    """Distances that equal the radius count; two rings stay apart."""
    grid = [(10 * i + j, 0.5 * i, 0.5 * j) for i in range(10) for j in range(10)]
    assert set(found(spark, grid, 0.5, 4).values()) == {1}
    assert set(found(spark, grid, 0.49, 2).values()) == {-1}
    angles = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    rings = [(k * 200 + i, r * math.cos(a), r * math.sin(a)) for k, r in enumerate((1.0, 1.5)) for i, a in enumerate(angles)]
    got = found(spark, rings, 0.1, 4)
    assert all(c == 1 + (i >= 200) for i, c in got.items())


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert clusters.dbscan(empty, 1.0, 3, "id", ["x", "y"]).count() == 0
    with pytest.raises(ValueError):
        clusters.dbscan(empty, 0.0, 3, "id", ["x", "y"])
    far = spark.createDataFrame([(1, 1e300)], "id long, x double")
    with pytest.raises(Exception, match="2\\^40 cells"):
        clusters.dbscan(far, 1.0, 3, "id", ["x"]).count()
