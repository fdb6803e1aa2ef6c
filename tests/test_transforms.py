import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import clusters, density, neighbors
from tamarack.operators import transforms as X
from tamarack.plans import pipeline


@pytest.fixture()
def three(spark):
    return spark.createDataFrame([([1.0, 2.0],), ([2.0, 3.0],), ([10.0, 11.0],)], "X array<float>")


def test_poly(three):
    assert [r["X"] for r in X.Polynomial("X").transform(three).collect()] == [[1, 2, 1, 2, 4], [2, 3, 4, 6, 9], [10, 11, 100, 110, 121]]
    assert [r["X"] for r in X.Polynomial("X", 3).transform(three).limit(1).collect()][0][5:] == [1, 2, 4, 8]


def test_scalers(three):
    got = [r["Y"] for r in X.Scaler("Y:X").fit(three).transform(three).collect()]
    assert np.allclose(got, [[-0.8276059] * 2, [-0.5793242] * 2, [1.40693] * 2], atol=1e-5)
    got = [r["Y"][0] for r in X.Scaler("Y:X", "minMax").fit(three).transform(three).collect()]
    assert np.allclose(got, [0, 1 / 9, 1])


def test_detrend(spark):
    df = spark.createDataFrame([(5.0, 0.0), (7.0, 1.0), (9.0, 2.0), (11.0, 3.0)], "X float, time float")
    assert all(abs(r["X"]) < 1e-5 for r in X.Detrend("X").fit(df).transform(df).collect())


def test_split_and_resample_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for t in (X.SplitTrainTest("k"), X.Resample("k", 1.5), X.AddRandom("z:k", "k")):
        a, b = (sorted(map(tuple, t.transform(d).collect())) for d in (df, df.repartition(7)))
        assert a == b
    parts = X.SplitTrainTest("k").parts(df)
    assert sum(p.count() for p in parts) == 1000 and abs(parts[0].count() - 667) < 60
    assert abs(X.Resample("k", 1.5).transform(df).count() - 1500) < 150


def test_class_expansion(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "k int, Y int")
    assert X.MultiToBinary("Y", "b", m=5).fit(df).transform(df).where("b").count() == 3
    assert X.MultiToBinary("Y", "b", m=2, key="k").fit(df).transform(df).count() == 6


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for metric in ("L1", "L2", "cosine"):
        got = {(r["id"], r["rank"]): r["neighbor"] for r in neighbors.knn(df, df, 3, metric).collect()}
        d = neighbors._distances(x, x, metric)
        assert all(got[i, j + 1] == np.lexsort((range(60), d[i]))[j] for i in range(60) for j in range(3))
        pair = df.alias("a").join(df.alias("b"), F.expr("a.vec_id = 0 and b.vec_id = 1")).select(neighbors.distance(F.col("a.embedding"), F.col("b.embedding"), metric)).first()[0]
        assert abs(pair - d[0, 1]) < 1e-9


def test_dbscan_and_optics(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(3, 0.05, (30, 2)), [[10, 10]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    found = {r["id"]: r["cluster"] for r in clusters.dbscan(df, 0.5, 4, "id", ["x", "y"]).collect()}
    assert {found[i] for i in range(30)} == {1} and {found[i] for i in range(30, 60)} == {2} and found[60] == -1
    order = neighbors.optics(df, 0.5, 4, "id", ["x", "y"]).toPandas()
    assert len(order) == 61 and np.isinf(order["reachability"]).sum() == 3


def density_order(ids, x, eps, mps):
    """The order over all points at once, as (id, reachability, core)."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = [np.sort(row)[mps - 1] if (row <= eps).sum() >= mps else np.inf for row in d]
    reach, left, out = dict.fromkeys(range(len(ids)), np.inf), set(range(len(ids))), []
    while left:
        at = min(left, key=lambda i: (reach[i], ids[i]))
        left.remove(at)
        out.append((ids[at], reach[at], core[at]))
        for i in left:
            if d[at, i] <= eps and np.isfinite(core[at]):
                reach[i] = min(reach[i], max(d[at, i], core[at]))
    return out


def test_optics_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(rng.integers(-4, 4, 3), 0.3, (25, 3)) for _ in range(5)] + [rng.uniform(-9, 9, (25, 3))]).round(2)
    ids = rng.permutation(1000)[: len(x)].tolist()
    rows = [(i, n % 2, *map(float, p)) for n, (i, p) in enumerate(zip(ids, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, z double")
    for group in (None, "g"):
        got = neighbors.optics(df, 0.6, 4, "id", ["x", "y", "z"], group).orderBy("group", "place").toPandas()
        for g in (0, 1) if group else (0,):
            chosen = [n for n in range(len(x)) if not group or n % 2 == g]
            want = density_order([ids[n] for n in chosen], x[chosen], 0.6, 4)
            part = got[got["group"] == g]
            assert part["id"].tolist() == [w[0] for w in want] and part["place"].tolist() == list(range(len(want)))
            assert np.allclose(part["reachability"], [w[1] for w in want]) and np.allclose(part["core"], [w[2] for w in want])
    vectors = df.select("id", F.array("x", "y", "z").alias("Features"))
    cut = {r["id"]: (r["ClusterId_0"], r["ClusterId_1"]) for r in density.Optics(eps="0.3,0.6", mps=4).transform(vectors).collect()}
    number = [0, 0]
    for i, reach, core in density_order(ids, x, 0.6, 4):
        for n, e in enumerate((0.3, 0.6)):
            number[n] += reach > e >= core
            assert cut[i][n] == (-1 if reach > e and core > e else number[n])
    alone = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    assert neighbors.optics(alone, 1.0, 2, "id", ["x", "y"]).count() == 3
    assert neighbors.optics(alone.limit(0), 1.0, 2, "id", ["x", "y"]).count() == 0


def test_minilanguage_and_pipeline(spark, three, tmp_path):
    assert pipeline.parse("a{b=c{d=e f=g} h=+}") == ("a", {"b": "c{d=e f=g}", "h": "+"})
    with pytest.raises(ValueError):
        pipeline.build("nothing{x=1}")
    made = pipeline.Pipeline(["Scaler{col=Y:X}", "poly{col=P:Y d=2}"]).train(three)
    made.save(spark, str(tmp_path / "p"))
    again = pipeline.Pipeline.load(spark, str(tmp_path / "p"))
    assert made.transform(three).collect() == again.transform(three).collect()
    tags = pipeline.Tags()
    tags.tag("a", three)
    assert tags.append(three, "a").count() == 6
    with pytest.raises(ValueError):
        tags.tag("a", three)


def test_trainer(spark):
    df = spark.createDataFrame([([float(i), 1.0], float(i > 10)) for i in range(20)], "Features array<double>, Label double")
    model = pipeline.Pipeline([], "lr{maxIter=20}").train(df)
    assert model.predict(df).where("prediction = Label").count() >= 18


def test_missing_cells_and_dropped_columns(spark):
    rows = [(1, 1.0, [1.0, 2.0]), (2, float("nan"), [1.0]), (3, 1.0, [float("nan")]), (4, None, [1.0]), (5, 1.0, None), (6, 1.0, [1.0, None])]
    df = spark.createDataFrame(rows, "a int, b double, v array<double>")
    assert [r[0] for r in X.MissingFilter().transform(df).collect()] == [1]
    assert [r[0] for r in X.MissingFilter("b").transform(df).collect()] == [1, 3, 5, 6]
    assert X.DropColumns("a,v").transform(df).columns == ["b"]


def test_passing_dumping_and_caching(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.0), (1, 2.0)], "a int, b double")
    dumped = X.PassThrough(str(tmp_path / "d")).transform(df)
    assert dumped.collect() == df.collect() and spark.read.parquet(str(tmp_path / "d")).count() == 2
    cached = X.Cache(str(tmp_path / "c"), r=True)
    assert cached.transform(df).count() == 2 and cached.transform(df.limit(0)).count() == 2  # the file is used again
    assert [r[0] for r in X.SortRows("a").transform(df).collect()] == [1, 2] and [r[0] for r in X.SortRows("a", True).transform(df).collect()] == [2, 1]
    assert X.Concat("f:a,b").transform(df).select("f").first()[0] == [2.0, 1.0]


def test_split_parts_are_written(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "k")
    parts = X.SplitTrainTest("k", a="0.5,0.3,0.2").parts(df, [str(tmp_path / str(i)) for i in range(3)])
    counts = [spark.read.parquet(str(tmp_path / str(i))).count() for i in range(3)]
    assert sum(counts) == 300 and counts == [p.count() for p in parts] and counts[0] > counts[1] > counts[2]
