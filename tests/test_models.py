"""Calibrators, one against all, and ranking by pairs against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import calibration, ranking
from tamarack.plans import trainers

NAN = float("nan")


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        s = rng.choice([round(rng.gauss(0, 2), 1), 0.5])  # one score has half of all rows
        rows.append((s, float(rng.random() < 1 / (1 + math.exp(-s)))))
    rows += [(None, 1.0), (NAN, 1.0), (1.0, None), (float("inf"), 1.0)]
    return rows, spark.createDataFrame(rows, "s double, y double").repartition(4)


def test_isotonic(scored, spark):
    rows, df = scored
    good = [(s, y) for s, y in rows if s is not None and y is not None and math.isfinite(s)]
    got = calibration.Isotonic.fit(df, F.col("s"), F.col("y"))
    xs = sorted({s for s, _ in good})
    n = {x: sum(s == x for s, _ in good) for x in xs}
    t = {x: sum(y for s, y in good if s == x) for x in xs}

    def mean(a, b):
        return sum(t[x] for x in xs[a : b + 1]) / sum(n[x] for x in xs[a : b + 1])

    want = {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}
    assert all(abs(got.value(x) - p) < 1e-12 for x, p in want.items())
    shown = df.select("s", got.column(F.col("s")).alias("p")).collect()
    assert all(r["p"] == got.value(r["s"]) for r in shown)
    assert got.value(-1e9) == got.values[0] and got.value(1e9) == got.values[-1] and got.values == sorted(got.values)
    assert calibration.Isotonic.fit(df.limit(0), F.col("s"), F.col("y")).value(3.0) == 0.5


def test_isotonic_pools(spark, monkeypatch):
    monkeypatch.setattr(calibration, "STEPS", 20)
    df = spark.range(5000).select((F.col("id") / 100).alias("s"), (F.rand(3) < F.col("id") / 5000).cast("double").alias("y"))
    got = calibration.Isotonic.fit(df, F.col("s"), F.col("y"))
    assert len(got.values) <= 21 and all(abs(got.value(x) - x / 50) < 0.1 for x in range(3, 48))


def test_platt(scored):
    rows, df = scored
    good = [(s, y) for s, y in rows if s is not None and y is not None and math.isfinite(s)]
    two = calibration.Platt.fit_all(df, [F.col("s"), -F.col("s")], [F.col("y"), F.col("y")])
    a, b = two[0].a, two[0].b
    pos = sum(y for _, y in good)
    aim = [(pos + 1) / (pos + 2) if y else 1 / (len(good) - pos + 2) for _, y in good]
    off = [t - 1 / (1 + math.exp(a * s + b)) for (s, _), t in zip(good, aim)]
    assert abs(sum(off)) < 1e-4 and abs(sum(o * s for o, (s, _) in zip(off, good))) < 1e-4  # the loss's slope is 0
    assert abs(two[1].a + a) < 1e-6 and abs(two[1].b - b) < 1e-6
    shown = df.where("s is not null").select("s", two[0].column(F.col("s")).alias("p")).collect()
    assert all(r["p"] is two[0].value(r["s"]) or abs(r["p"] - two[0].value(r["s"])) < 1e-12 for r in shown)
    same = calibration.Platt.fit(df.select(F.lit(1.0).alias("s"), F.lit(1.0).alias("y")), F.col("s"), F.col("y"))
    assert 0.9 < same.value(1.0) <= 1
    none = calibration.Platt.fit(df.limit(0), F.col("s"), F.col("y"))
    assert abs(none.value(2.0) - 0.5) < 1e-9


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        c = int(rng.integers(0, 3)) if i > 20 else 0
        rows.append((i, float(c), [float(x) for x in rng.normal([c, -c, c * c], 0.4)]))
    rows += [(900, None, [0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, Label double, Features array<double>")


@pytest.mark.parametrize("text", ["OOVA{p=lr{maxIter=8}}", "OOVA{p=lr{maxIter=8} cali=isotonic ds=0.5}", "OOVA{p=lr{maxIter=8} useprob=-}", "OOVA{p=ap{maxIter=8}}", "OOVA{p=lr{maxIter=5} cali=none}"])
def test_one_against_all(classes, text):
    got = trainers.make(text).fit(classes).transform(classes).where("Label is not null").collect()
    assert sum(r["prediction"] == r["Label"] for r in got) > 0.85 * len(got)
    if "useprob" not in text:
        assert all(abs(sum(r["scores"]) - 1) < 1e-9 and min(r["scores"]) >= 0 for r in got)


def test_probabilities_of_odd_scores(spark):
    rows = [(NAN, -1.0, None), (2.0, 0.5, 0.5), (0.0, 0.0, 0.0), (0.2, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "a double, b double, c double").select(trainers.normalised([F.col(c) for c in "abc"]).alias("p"))
    assert [[round(x, 6) for x in r["p"]] for r in df.collect()] == [[0.333333] * 3, [0.5, 0.25, 0.25], [0.333333] * 3, [0.25, 0.25, 0.5]]


def test_ranking_by_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([0, 1, 2, None]), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(150)]
    rows += rows[:4] + [("a", 1, None), ("a", 1, [1.0, None, 2.0]), ("one", 2, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "g string, y int, x array<double>").repartition(4)
    square, line = np.eye(3) * 0.5, np.zeros(3)
    for g, y, x in rows:
        for h, z, w in rows:
            if g == h and None not in (y, z) and y > z and x and w and None not in x and None not in w:
                d = np.array(x) - np.array(w)
                square, line = square + np.outer(d, d), line + d
    assert np.allclose(ranking.fit_ranker(df, "x", "y", "g", 0.5), np.linalg.solve(square, line))
    assert ranking.fit_ranker(df.limit(0), "x", "y", "g") == []
    assert ranking.fit_ranker(df.where("g = 'one'"), "x", "y", "g") == [0.0, 0.0, 0.0]
    renamed = df.withColumnRenamed("y", "c").withColumnRenamed("g", "v")  # columns named as inner ones
    assert np.allclose(ranking.fit_ranker(renamed, "x", "c", "v", 0.5), np.linalg.solve(square, line))


def test_ranking_of_classes(classes):
    got = trainers.make("iOVArk").fit(classes)
    rows = [(r["Label"], [*r["Features"], 1.0]) for r in classes.where("Label is not null").collect()]
    square, line = np.eye(12), np.zeros(12)
    for y, x in rows:
        for c in range(3):
            if c != y:
                d = np.zeros((3, 4))
                d[int(y)] += x
                d[c] -= x
                square, line = square + np.outer(d.ravel(), d.ravel()), line + d.ravel()
    assert np.allclose(np.ravel(got.weights), np.linalg.solve(square, line))
    shown = got.transform(classes).where("Label is not null").collect()
    assert sum(r["prediction"] == r["Label"] for r in shown) > 0.85 * len(shown)
