"""Comparison of special reals, first rows of indexed files, rows of mixed numbers."""

import pytest

from tamarack.operators import frame
from tamarack.sources import delimited

NAN, INF = float("nan"), float("inf")


def test_almost_equal_of_special_reals(spark):
    pairs = [(NAN, NAN), (INF, INF), (-INF, -INF), (None, None), (0.0, 0.0), (1.0, 1.0 + 1e-9), (NAN, 5.0), (5.0, NAN), (INF, -INF), (INF, 5.0), (NAN, INF), (None, 1.0), (NAN, None), (1.0, 1.1), (0.0, 1e-9)]
    a = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "k int, x double")
    b = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(pairs)], "k int, x double")
    assert sorted({r["k"] for r in frame.differences(a, b, 1e-6, "k").collect()}) == list(range(6, len(pairs)))
    assert frame.equal(a, a, 1e-6, "k") and not frame.equal(a, b, 1e-6, "k")
    with pytest.raises(AssertionError):
        frame.assert_equal(a.withColumn("x", frame.F.lit(NAN)), a, 1e-6, "k")


def test_first_rows(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i / 2}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = delimited.read_csv(spark, str(path), nrows=3, index=True)
        assert got.columns == ["index", "a", "b"] and [tuple(r) for r in got.orderBy("index").collect()] == [(i, i, i / 2) for i in range(3)]
        assert sorted(r["a"] for r in delimited.read_csv(spark, str(path), nrows=20_000).collect()) == list(range(20_000))
        assert delimited.read_csv(spark, str(path), nrows=0, index=True).count() == 0
        whole = delimited.read_csv(spark, str(path), index=True)
        assert whole.where("index <> a").count() == 0 and whole.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_mixed_numbers(spark):
    got = delimited.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2.5}, {"b": 3}])
    assert [r["a"] for r in got.collect()][:2] == [1.0, 2.5] and dict(got.dtypes)["a"] == "double"
