"""Centroid clustering against a plain loop, with vectors to leave out, ties, repeats and clashing names."""

import hashlib
import math

import numpy as np
import pytest

from tamarack.llm.centroids import centroid_clusters


def brute(rows, k, dim, scale, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, a in placed if a == j) for _, _, j in placed}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), tuple(centroids[j])) for i, d, j in placed), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    equal = [(100 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(150)]  # most rows are one vector
    bad = [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    return good + equal + bad + [good[3], (None, good[4][1]), (None, [9.0, 9.0, 9.0, 9.0]), ((1 << 53) + 1, good[5][1])]


def found(df):
    return sorted((tuple(r[:5]) + (tuple(r[5]),) for r in df.collect()), key=str)


def test_rounds(spark, rows):
    schema = "vec_id long, embedding array<double>, cluster string, inertia int"
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(5)
    for k, rounds in ((5, 3), (1, 1), (16, 0), (500, 2)):
        got = centroid_clusters(table, k=k, dim=4, scale=64, rounds=rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
        assert found(got) == brute(rows, k, 4, 64, rounds)
    assert centroid_clusters(table.limit(0), dim=4).count() == 0
    assert centroid_clusters(table.where("vec_id in (300, 302)"), dim=4).count() == 0


def test_key_named_as_a_result(spark):
    table = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "cluster string, v array<float>")
    got = centroid_clusters(table, "cluster", "v", k=2, dim=1)
    assert got.columns[:2] == ["cluster", "cluster_"] and {r["cluster_"] for r in got.collect()} == {0}  # equal centroids: the smaller number


def test_too_large(spark):
    with pytest.raises(Exception, match="a component times"):
        centroid_clusters(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dim=1)
