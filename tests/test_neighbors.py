"""Pruned neighbour and range search against all pairs, and how many pairs of blocks meet."""

import numpy as np
import pytest

from tamarack.operators import neighbors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 50, (12, 6))
    x = [centers[i % 12] + rng.normal(0, 0.5, 6) for i in range(360)] + [centers[0]] * 120 + [np.zeros(6)] * 3  # a third of one kind
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5, [float(c) for c in x[7]]), (1000, None)]
    return rows[:-1], spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_pruned_neighbors(vectors, spark, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for metric in ("L2", "L1", "cosine"):
        got: dict = {}
        for r in neighbors.knn(df, df, 4, metric).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["distance"]))
        d = neighbors._distances(x, x, metric)
        for i, row in zip(ids, d):
            if i != 5:  # stands twice: its neighbours are those of both rows
                want = sorted(zip(row, ids))[:4]
                if metric != "cosine":  # there equal angles differ by rounding
                    assert [n for _, n, _ in sorted(got[i])] == [n for _, n in want], (metric, i)
                assert np.allclose([v for *_, v in sorted(got[i])], [v for v, _ in want])
        assert len(got) == len(set(ids))
    many = neighbors.knn(df, df.where("vec_id < 40"), 50, "L2")  # more than there are
    assert many.groupBy("id").count().where("id <> 5 and count <> 41").count() == 0
    assert neighbors.knn(df, df.limit(0), 3).count() == neighbors.knn(df.limit(0), df, 3).count() == 0


def test_range_search(vectors, spark, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for metric, radius in (("L2", 1.5), ("L1", 3.0), ("cosine", 0.001), ("L2", 0.0)):
        got = sorted((r["id"], r["neighbor"]) for r in neighbors.range_search(df, df, radius, metric).collect())
        d = neighbors._distances(x, x, metric)
        assert got == sorted((int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(d <= radius)))
    assert neighbors.range_search(df, df.limit(0), 1.0).count() == neighbors.range_search(df.limit(0), df, 1.0).count() == 0


def test_few_blocks_meet(vectors, monkeypatch):
    """Twelve far groups: blocks meet those of their own group, not all."""
    _, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    met = []
    inner = neighbors._met
    monkeypatch.setattr(neighbors, "_met", lambda q, i, wanted, *rest: met.append((wanted.count(), q.count(), i.count())) or inner(q, i, wanted, *rest))
    neighbors.range_search(df, df, 3.0).count()
    neighbors.knn(df, df, 3).count()
    (searched, q, i), *found = met
    assert searched <= q * i / 3 and sum(n for n, _, _ in found) <= q * i / 3


def plans_met(monkeypatch):
    """The plans of all that ``_met`` returns from now on."""
    plans, inner = [], neighbors._met

    def met(*rest):
        out = inner(*rest)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(neighbors, "_met", met)
    return plans


def test_vectors_meet_without_a_shuffle(vectors, monkeypatch):
    """Shuffled pairs of blocks take disk with the square of the rows."""
    _, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    plans = plans_met(monkeypatch)
    neighbors.knn(df, df, 3).count()
    assert len(plans) == 2
    for plan in plans:
        exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
        assert "CartesianProduct" in plan and not any("i_pivot" in line.split("hashpartitioning")[-1].split(")")[0] for line in exchanges)


def blocks_of(x, y):
    import pyarrow as pa

    flat = lambda v: pa.array([v.ravel()], pa.list_(pa.float64()))
    parts = [(np.arange(len(y))[::2][::-1], y[::2][::-1]), (np.arange(len(y))[1::2], y[1::2])]
    for ids, part in parts:
        yield pa.RecordBatch.from_pydict({"q_pivot": [0], "q_block": [0], "q_ids": [np.arange(len(x))], "q_vectors": flat(x), "i_ids": [ids], "i_vectors": flat(part)})


def odd_vectors():
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (70, 7)), rng.normal(0, 1, (90, 7))
    y[:20] = y[20]  # ties
    yield x, y
    yield 1e-25 * x, 1e-25 * y
    yield 1e6 + 1e-3 * x, 1e6 + 1e-3 * y  # near each other, far from zero
    yield 1e200 * x, 1e200 * y  # squares overflow
    yield np.ones((3, 2)), np.ones((5, 2))
    yield np.zeros((3, 2)), np.array([[0.0, 0.0], [1.0, 0.0], [0.0, -1.0]])
    yield np.where(x > 2, np.nan, x), np.where(y > 2, np.inf, y)
    yield rng.normal(0, 1, (300, 1100)), rng.normal(0, 1, (40, 1100))  # sums of many bytes


def nearest_of(x, y, metric):
    with np.errstate(all="ignore"):
        d = neighbors._distances(x, y, metric)
        got = [b.to_pydict() for b in neighbors._nearest(4, metric)(blocks_of(x, y))]
        assert len(got) == 1  # all blocks of items are merged in the task
        near = np.array(got[0]["distance"]).reshape(len(x), -1)
        assert np.allclose(near, np.sort(d, axis=1)[:, :4], rtol=1e-9, atol=0 if metric != "cosine" else 1e-12, equal_nan=True)
        if metric != "cosine" and np.isfinite(d).all():  # there equal angles differ by rounding
            assert got[0]["neighbor"] == np.argsort(d, axis=1, kind="stable")[:, :4].ravel().tolist()


def test_estimated_l2_loses_nothing():
    for x, y in odd_vectors():
        nearest_of(x, y, "L2")


def test_estimated_cosine_loses_nothing():
    for x, y in odd_vectors():
        if np.abs(x[np.isfinite(x)]).max() < 1e100:  # squares that overflow have no angle
            nearest_of(x, y, "cosine")


def test_estimated_l1_loses_nothing():
    for x, y in odd_vectors():
        nearest_of(x, y, "L1")


def test_votes_search_once(vectors, monkeypatch):
    """Shares come from one search: each vote is counted and summed from the same rows."""
    _, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    labelled = df.where("embedding is not null").withColumn("label", df["vec_id"] % 3)
    votes = neighbors.knn_classify(labelled, labelled, "label", 4)
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 1
    assert votes.groupBy("id").agg({"score": "sum"}).where("abs(`sum(score)` - 1) > 1e-9").isEmpty()


def test_range_search_meets_without_a_shuffle(vectors, monkeypatch):
    _, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    plans = plans_met(monkeypatch)
    neighbors.range_search(df, df, 1.0).count()
    assert len(plans) == 1 and "CartesianProduct" in plans[0]


def test_few_items_copy_few_queries(spark, monkeypatch):
    """Many queries and few items: blocks of queries are copied only while cores would be idle."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "LEAST_BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1, (640, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts, inner = {}, neighbors._blocks
    monkeypatch.setattr(neighbors, "_blocks", lambda *rest: counts.update({rest[-2]: rest[-1]}) or inner(*rest))
    near = neighbors.append_neighbors(df, 2, items=df.where("vec_id < 64"))
    assert counts == {"q": 10, "i": 1}
    x = np.array([v for _, v in rows])
    want = np.argsort(neighbors._distances(x, x[:64], "L2"), axis=1, kind="stable")[:, :2]
    assert {r["vec_id"]: r["idNeighbors"] for r in near.collect()} == {i: w.tolist() for i, w in enumerate(want)}


def test_saved_neighbors_meet_without_a_shuffle(vectors, spark, monkeypatch, tmp_path):
    """A loaded model searches its saved rows in blocks, and once."""
    from tamarack.plans import pipeline

    rows, df = vectors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    labelled = df.where("embedding is not null and vec_id <> 5").withColumn("label", (df["vec_id"] % 3).cast("int"))
    pipeline.Pipeline([], "kNNmc{k=3 id=vec_id}", "embedding", "label").train(labelled).save(spark, str(tmp_path / "model"))
    asked = pipeline.Pipeline.load(spark, str(tmp_path / "model")).predict(labelled).select("vec_id", "prediction")
    assert asked._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 1
    ids, x = np.array([i for i, _ in rows if i != 5]), np.array([v for i, v in rows if i != 5])
    want = {}
    for i, d in zip(ids, neighbors._distances(x, x, "L2")):
        near = [int(n) % 3 for _, n in sorted(zip(d, ids))[:3]]
        want[int(i)] = min(near, key=lambda label: (-near.count(label), label))
    assert {r["vec_id"]: r["prediction"] for r in asked.collect()} == want
