"""Places without moving rows, masks and lists of values, bounded folds, key ranges, exported models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import aggregate, frame
from tamarack.operators import transforms as X
from tamarack.plans import exported, pipeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    # half of all rows share one key; a null key is first
    data = [(rng.choice([None, 7, 7, 7, *range(12)]), f"r{i}") for i in range(200)]
    return data, spark.createDataFrame(data, "k int, v string").repartition(4)


def test_take_among_equal_keys(rows):
    data, df = rows
    keys = sorted((k for k, _ in data), key=lambda k: (k is not None, k))
    got = frame.take(df, [0, 199, 60, 61, 60, 500, -1], "k").collect()
    assert [r["k"] for r in got] == [keys[0], keys[199], keys[60], keys[61], keys[60]]
    assert got[2] == got[4] and got[2] != got[3]
    everything = frame.take(df, range(200), "k").collect()
    assert sorted(map(tuple, everything), key=str) == sorted(data, key=str) and [r["k"] for r in everything] == keys
    assert frame.take(df, [], "k").count() == 0 and frame.take(df.limit(0), [0], "k").count() == 0
    assert frame.row_at(df, 500, "k") is None and frame.cell(df, 199, 0, "k") == keys[199]


def test_set_at_among_equal_keys(rows):
    data, df = rows
    got = frame.set_at(df, "v", [60, 61, 150, 900], "new", "k")
    assert got.count() == 200 and got.where("v = 'new'").count() == 3
    assert {(r["k"], r["v"]) for r in got.where("v <> 'new'").collect()} <= set(data)


def test_mask_and_values(rows, spark):
    data, df = rows
    assert sorted(r["v"] for r in frame.pick(df, F.col("k") == 7, ["v"]).collect()) == sorted(v for k, v in data if k == 7)
    some = spark.createDataFrame([(1, 1.0, True), (2, 2.0, None), (3, 3.0, True), (4, 4.0, False)], "id int, x double, m boolean")
    got = frame.set_values(some, "x", "m", [10.0, 30.0], "id")
    assert sorted((r["id"], r["x"]) for r in got.collect()) == [(1, 10.0), (2, 2.0), (3, 30.0), (4, 4.0)]
    with pytest.raises(ValueError):
        frame.set_values(some, "x", "m", [1.0], "id")
    assert frame.set_values(some.limit(0), "x", "m", [], "id").count() == 0
    typed = frame.override_types(some, {"x": "R4", "id": "I8"})
    assert typed.dtypes == [("id", "bigint"), ("x", "float"), ("m", "boolean")] and typed.count() == 4
    with pytest.raises(ValueError):
        frame.override_types(some, {"none": "R4"})


def test_bounded_folds(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", None]), i % 90, rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o int, t string").repartition(5)
    want = {k: "".join(t or "" for _, _, t in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2] or ""))) for k in {r[0] for r in data}}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["k"]: r["value"] for r in aggregate.text_sums(df, ["k"], "t", ["o"]).collect()} == want
        # an affine map for each row, composed: (m, a) then (n, b) is (m n, a n + b)
        pair = lambda m, a: F.struct(F.lit(m).cast("double").alias("m") if not hasattr(m, "alias") else m.alias("m"), F.lit(a).cast("double").alias("a") if not hasattr(a, "alias") else a.alias("a"))
        got = aggregate.ordered_fold(df, ["k"], "o", ["o", "t"], pair(1.0, 0.0), lambda s, x: pair(s["m"] * 0.5, s["a"] * 0.5 + x), lambda s, t: pair(s["m"] * t["m"], s["a"] * t["m"] + t["a"]))
        for r in got.collect():
            x = 0.0
            for _, o, _ in sorted((q for q in data if q[0] == r["k"]), key=lambda q: (q[1], q[2] is not None, q[2] or "")):
                x = x * 0.5 + o
            assert math.isclose(r["value"]["a"], x)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert aggregate.text_sums(df.limit(0), ["k"], "t", ["o"]).count() == 0


def test_folds_take_few_rows(spark, monkeypatch):
    """One key holds all rows: no fold takes more than FOLD of them; text comes in order through all levels."""
    df = spark.range(7000).select(F.lit("k").alias("k"), "id")
    longest = aggregate.ordered_fold(df, ["k"], "id", ["id"], F.lit(0), lambda a, x: a + 1, F.greatest).collect()
    assert [tuple(r) for r in longest] == [("k", aggregate.FOLD)]
    monkeypatch.setattr(aggregate, "FOLD", 4)
    monkeypatch.setattr(aggregate, "MERGE", 2)
    texts = aggregate.text_sums(df.where("id < 700").withColumn("t", F.concat("id", F.lit(","))), ["k"], "t", ["id"]).collect()
    assert [tuple(r) for r in texts] == [("k", "".join(f"{i}," for i in range(700)))]
    assert [r[0] for r in aggregate.text_sums(df.where("id < 20").withColumn("t", F.col("id").cast("string")), [], "t", ["id"]).collect()] == ["".join(map(str, range(20)))]


def test_key_ranges(spark):
    df = spark.createDataFrame([(1.0, 3), (2.5, 4), (None, None), (float("nan"), 0), (9.0, 9), (0.0, -1)], "x double, n int")
    got = X.KeyToLabel("k:[1-3]:x,u:U4:n,p:n", type="R8").transform(df)
    assert [r["k"] for r in got.collect()] == [1, 0, 0, 0, 0, 0] and dict(got.dtypes) == {"x": "double", "n": "int", "k": "bigint", "u": "bigint", "p": "double"}
    assert got.schema["k"].metadata == {"kind": "U4", "key": {"min": 1, "count": 3}} and got.schema["u"].metadata == {"kind": "U4"}
    open_ = X.KeyToLabel("k:x", key="0-*").transform(df)
    assert [r["k"] for r in open_.collect()] == [2, 0, 0, 0, 10, 1] and open_.schema["k"].metadata["key"] == {"min": 0, "count": 0}
    again = X.KeyToLabel("j:I4[1-3]:k").transform(got)
    assert [r["j"] for r in again.collect()] == [1, 0, 0, 0, 0, 0] and dict(again.dtypes)["j"] == "int" and again.schema["j"].metadata["kind"] == "I4"
    assert X.KeyToLabel("j:[1-3]:j").transform(again).schema["j"].metadata["kind"] == "I4"  # a key keeps its kind
    with pytest.raises(ValueError):
        X.KeyToLabel("j:[1-4]:k").transform(got)
    with pytest.raises(ValueError):
        X.KeyToLabel("j:R4[1-4]:x").transform(df)
    assert dict(X.KeyToLabel("y:x").transform(df).dtypes)["y"] == "float"
    assert X.KeyToLabel("k:[1-3]:x").transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("trainer", ["ols", "lr{maxIter=8}", "mlr{maxIter=8}", "ap{maxIter=8}", "ft{maxIter=3 maxDepth=3}", "ftr{maxIter=3 maxDepth=3}", "OOVA{p=lr{maxIter=4}}", "OOVA{p=ap{maxIter=4} cali=isotonic}", "iOVArk"])
def test_exported_models(spark, trainer):
    rng = random.Random(5)
    many = trainer.startswith(("mlr", "OOVA", "iOVArk"))
    data = [(i, float(c), [rng.gauss(c, 1), rng.gauss(-c, 1)]) for i in range(120) for c in [rng.randint(0, 2 if many else 1)]]
    df = spark.createDataFrame(data, "id int, Label double, Features array<float>")
    steps = ["Scaler{col=Features}", "Poly{col=Features d=2}"]
    trained = pipeline.Pipeline(steps, trainer).train(df)
    made = exported.Exported.from_json(exported.export(trained).to_json())
    want = {r["id"]: r["prediction"] for r in trained.predict(df).collect()}
    got = {r["id"]: r["prediction"] for r in made.transform(df).collect()}
    rows = {r["id"]: made.predict_row(r.asDict(), singles=True) for r in df.collect()}
    assert len(want) == 120 and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-6) and math.isclose(rows[i], want[i], rel_tol=1e-6, abs_tol=1e-6) for i in want)
    odd = spark.createDataFrame([(1, None), (2, [1.0, None])], "id int, Features array<float>")
    assert [r["prediction"] for r in made.transform(odd).collect()] == [None, None]
    assert made.predict_row({"Features": None}) is None and made.predict_row({"Features": [1.0, None]}) is None


def test_what_cannot_be_exported(spark):
    df = spark.createDataFrame([(1, 0.0, [1.0]), (2, 1.0, [2.0])], "id int, Label double, Features array<double>")
    with pytest.raises(TypeError):
        exported.export(pipeline.Pipeline([], "knn{k=1}").train(df))
    with pytest.raises(TypeError):
        exported.export(pipeline.Pipeline(["NAFilter{col=Features}"], "ols").train(df))
