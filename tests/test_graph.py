import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import density, frame
from tamarack.operators import transforms as X
from tamarack.plans import graph, pipeline, trainers


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 3), (rng.normal(0, 0.2, 2) + 3 * np.eye(3)[i % 3][:2]).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, Label double, Features array<double>").cache()


def right(df):
    return df.where("prediction = Label").count()


@pytest.mark.parametrize("text", ["kNNmc{k=3}", "iOVA{p=ft{maxIter=3}}", "iOVArk{p=ftr{maxIter=3} onehot=-}", "OOVA{p=lr{maxIter=10}}", "PrePost{pre=Scaler{col=Features} p=mlr{maxIter=10}}"])
def test_trainers_separate_three_classes(classes, text):
    found = trainers.make(text).fit(classes).transform(classes)
    assert found.count() == 60 and right(found) >= 57


def test_binary_neighbors(classes):
    two = classes.withColumn("Label", (F.col("Label") > 0).cast("double"))
    found = trainers.make("kNN{k=3}").fit(two).transform(two)
    assert right(found) == 60 and found.where("score between 0 and 1").count() == 60
    with pytest.raises(ValueError):
        trainers.make("nothing")


def test_graph(classes, tmp_path):
    g = graph.Graph()
    two = classes.withColumn("Label", (F.col("Label") > 0).cast("double"))
    steps = ["Tag{t=raw}", f"TagTrainScore{{tr=lr{{maxIter=10}} tag=m out={tmp_path}/m}}", "SelTag{t=scored s=raw}", "Predict{tag=m col=P p=+}"]
    out = g.run(two, steps)
    assert out.columns == [*two.columns, "P"] and out.where("(P > 0.5) = (Label = 1)").count() >= 58
    assert g.run(two, [f"TagPredict{{f={tmp_path}/m}}"]).columns[-1] == "Score"
    assert g.run(two, ["Chain{xf2=Append{t=raw} xf1=poly{col=Features d=2}}"]).count() == 120
    with pytest.raises(KeyError):
        g.run(two, ["TagScore{tag=other}"])
    with pytest.raises(ValueError):
        g.run(two, ["SelTag{t=x}"])


def test_saved_model(spark, classes, tmp_path):
    two = classes.withColumn("Label", (F.col("Label") > 0).cast("double"))
    made = pipeline.Pipeline(["Scaler{col=Features}"], "lr{maxIter=10}").train(two)
    made.save(spark, str(tmp_path / "p"))
    again = pipeline.Pipeline.load(spark, str(tmp_path / "p"))
    pick = lambda p: sorted(map(tuple, p.predict(two).select("id", "prediction").collect()))
    assert pick(made) == pick(again)


SAVED = [
    "kNNmc{k=3 d=L1}", "kNN{k=2 w=inverse}", "iOVA{p=ft{maxIter=2}}", "iOVArk{p=ftr{maxIter=2} onehot=-}", "iOVArk", "OOVA{p=lr{maxIter=5} ds=0.2}", "OOVA{cali=isotonic p=lr{maxIter=5}}",
    "OOVA{useprob=- p=ap{maxIter=5}}", "rank{group=g}", "km{k=3 seed=1}", "PrePost{pre=Scaler{col=Features} pret=cachedf p=OOVA{p=lr{maxIter=5}} post=Scaler{col=shown:id scale=minMax}}",
]


@pytest.mark.parametrize("text", SAVED)
def test_saved_models(spark, classes, tmp_path, text):
    """A loaded model gives the rows of the one that was saved, under another column's name too."""
    df = classes.withColumn("g", F.col("id") % 4)
    made = trainers.make(text).fit(df)
    path = str(tmp_path / "m")
    made.save(path)
    made.save(path)  # again, over itself
    rows = lambda model, frame: sorted((repr(r.asDict()) for r in model.transform(frame).drop("Features", "Other").collect()))
    again = trainers.load(spark, path)
    assert rows(made, df) == rows(again, df) and len(rows(made, df)) == df.count()
    if "pre=" not in text:
        assert rows(trainers.load(spark, path, "Other"), df.withColumnRenamed("Features", "Other")) == rows(made, df)
    assert made.transform(df.limit(0)).count() == again.transform(df.limit(0)).count() == 0


def test_saved_rows_of_steps(spark, classes, tmp_path):
    made = pipeline.Pipeline(["knntr{k=2}", "Scaler{col=Features}"], "kNNmc{k=3}").train(classes)
    made.save(spark, str(tmp_path / "p"))
    again = pipeline.Pipeline.load(spark, str(tmp_path / "p"))
    pick = lambda p: sorted(map(repr, p.predict(classes).select("id", "Distances", "idNeighbors", "score", "prediction").collect()))
    assert pick(made) == pick(again)


def test_density_transforms(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 0.05, (20, 4)), rng.normal(2, 0.05, (20, 4)), [[9, 9, 9, 9]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, Features array<double>")
    found = {r["id"]: (r["ClusterId"], r["Score"]) for r in pipeline.build("DBScan{eps=0.5 mps=4}").transform(df).collect()}
    assert {found[i] for i in range(20)} == {(1, 1.0)} and {found[i] for i in range(20, 40)} == {(2, 1.0)} and found[40] == (-1, 0.0)
    cut = pipeline.build("OPTICS{eps=0.5,1.0 mps=4}").transform(df).toPandas().set_index("id")
    assert cut["ClusterId_0"].loc[:19].nunique() == 1 and cut["ClusterId_0"].loc[40] == -1 and cut["ClusterId_1"].loc[20:39].nunique() == 1
    assert set(pipeline.build("OPTICSOrd{eps=0.5}").transform(df).columns) == {"id", "Features", "Order", "Reachability", "CoreDistance"}
    assert 0 < density.estimate_radius(df, "id", "Features") < 20
    near = pipeline.build("knntr{k=2}").fit(df).transform(df).toPandas()
    assert all(r.idNeighbors[0] == r.id and r.Distances[0] == 0 for r in near.itertuples())


def test_shake_describe_and_codes(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "k int, v array<double>")
    shaken = X.ShakeInput("v", (0, 1), ((5.0,), (7.0, 8.0)), "o", lambda v: v[0] + v[1]).transform(df)
    assert shaken.first()["o"] == [7.0, 8.0, 9.0]
    d = X.Describe("k", "k").fit(df)
    assert d.found.first()["nb"] == 1 and d.counts["k"].first()["n"] == 1
    assert np.isnan(X.CodeToLabel("l:k").transform(df).first()["l"])
    with pytest.raises(ValueError):
        pipeline.build("Scaler{nothing=1}")


def test_order(spark):
    df = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "k int, x int")
    assert [r["place"] for r in frame.argsort(df, "x", "k").orderBy("rank").collect()] == [1, 2, 0]
    assert frame.order_columns(df, ["x"]).columns == ["x"] and frame.cell(df, 1, "x", "k") == 1 and frame.cell(df, 9, 0, "k") is None
    assert sorted(r["k"] for r in frame.shuffle(df, "k").collect()) == [0, 1, 2]


def test_description_as_json(spark):
    rows = [(1, "a"), (3, None), (None, "a"), (1, 'b"')]
    df = spark.createDataFrame(rows, "name int, t string")  # a column may be called name
    texts = sorted((json.loads(r["json"]) for r in X.Describe("name", "t,name", "d").fit(df).as_json().collect()), key=str)
    want = [{"name": "d", "column": "name", "min": 1.0, "max": 3.0, "sum": 5.0, "sum2": 11.0, "nb": 3}]
    want += [{"name": "d", "column": "t", "n": 1}, {"name": "d", "column": "t", "value": "a", "n": 2}, {"name": "d", "column": "t", "value": 'b"', "n": 1}]
    want += [{"name": "d", "column": "name", "n": 1}, {"name": "d", "column": "name", "value": 1, "n": 2}, {"name": "d", "column": "name", "value": 3, "n": 1}]
    assert texts == sorted(want, key=str)
    empty = X.Describe("name", "t").fit(df.limit(0)).as_json().collect()
    assert [json.loads(r["json"]) for r in empty] == [{"name": "desc", "column": "name", "nb": 0}]
    with pytest.raises(ValueError):
        X.Describe().fit(df).as_json()
