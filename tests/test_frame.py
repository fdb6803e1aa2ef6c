import math

import pytest
from pyspark.sql import functions as F

from tamarack.functions import expressions as E
from tamarack.functions.kinds import guess_kind, widest
from tamarack.operators import aggregate, frame
from tamarack.sources import delimited


@pytest.fixture()
def five(spark):
    rows = [(0, 1.0, "text", 0), (1, 1.1, "text2", 1), (0, 1.1, "text3", 2), (2, 1.1, "text4", 3), (1, 1.1, "text5", 4)]
    return spark.createDataFrame(rows, "AA int, BB double, CC string, n int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kinds():
    assert [guess_kind(x) for x in ("true", "1", "3000000000", "-3000000000", "1.5", "1.23456789012", "x", "")] == ["BL", "I4", "U4", "I8", "R4", "R8", "TX", None]
    assert widest(["I4", None, "R4"]) == "R4" and widest(["BL", "I4"]) == "TX" and widest([None]) == "TX"


def test_read_str_and_arithmetic(spark):
    df = delimited.read_str(spark, "AA,BB,CC\n0,1,text\n1,1.1,text2")
    assert [t for _, t in df.dtypes] == ["int", "float", "string"]
    out = df.select(E.arithmetic(df, "AA", "+", E.Name("BB")).alias("s"), E.arithmetic(df, "AA", "+", 10).alias("t"), E.arithmetic(df, "CC", "+", "!").alias("u"))
    assert [t for _, t in out.dtypes] == ["float", "int", "string"]
    assert [(round(a, 4), b, c) for a, b, c in rows(out)] == [(1.0, 10, "text!"), (2.1, 11, "text2!")]
    with pytest.raises(ValueError):
        delimited.read_str(spark, "")


def test_csv_round_trip(spark, tmp_path):
    df = delimited.read_str(spark, "a,b\n1,x\n2,y")
    delimited.write_csv(df, str(tmp_path / "o"))
    assert sorted(rows(delimited.read_csv(spark, str(tmp_path / "o")))) == [(1, "x"), (2, "y")]
    assert delimited.to_csv_string(df) == "a,b\n1,x\n2,y"


def test_nan_comparisons(spark):
    df = spark.createDataFrame([(math.nan,), (2.0,)], "x double")
    out = df.select(*(E.compare(df, "x", op, 1.0).alias(op) for op in ("==", "!=", "<", "<=", ">", ">=")))
    assert rows(out) == [(False, True, False, False, False, False), (False, True, False, False, True, True)]


def test_integer_division_truncates(spark):
    df = spark.createDataFrame([(-7,), (7,)], "x int")
    assert rows(df.select(E.arithmetic(df, "x", "/", 2))) == [(-3,), (3,)]


def test_groups(five):
    out = aggregate.group_aggregate(five, "AA", "sum", order=["n"]).select("AA", F.round("BB", 6), "CC")
    assert rows(out) == [(0, 2.1, "texttext3"), (1, 2.2, "text2text5"), (2, 1.1, "text4")]
    assert [(r[0], r[2]) for r in rows(aggregate.group_aggregate(five, "AA", "count"))] == [(0, ""), (1, ""), (2, "")]
    assert rows(aggregate.aggregate(five.limit(2), "mean", ["AA"])) == [(0,)]


def test_joins(spark):
    left = spark.createDataFrame([(0, 1.0, "text0"), (1, 1.1, "text2")], "AA int, BB float, CC string")
    right = spark.createDataFrame([(2, 3.0, "TEXT2", 1), (1, 4.1, "TEXT1", 0)], "AA2 int, BB2 float, CC string, DD int")
    sizes = {how: frame.join(left, right, "AA", "AA2", how).count() for how in ("inner", "left", "right", "outer")}
    assert sizes == {"inner": 1, "left": 2, "right": 2, "outer": 3}
    filled = frame.join(left, right, "AA", "AA2", "left", missing="sentinel").orderBy("AA")
    assert filled.columns == ["AA", "BB", "CC", "AA2", "BB2", "CC_y", "DD"]
    first = filled.first()
    assert first["AA2"] == -(2**31) and math.isnan(first["BB2"]) and first["CC_y"] == ""
    with pytest.raises(TypeError):
        frame.join(left, right, "AA", "BB2")


def test_positions(five):
    assert [r["index"] for r in frame.with_index(five, "n").orderBy("n").collect()] == [0, 1, 2, 3, 4]
    assert [r["n"] for r in frame.take(five, [3, 1, 3], "n").collect()] == [3, 1, 3]
    assert [r["n"] for r in frame.tail(five, "n", 2).collect()] == [3, 4]
    assert frame.row_at(five, 2, "n")["CC"] == "text3" and frame.row_at(five, 9, "n") is None
    assert frame.sample(five, 3, "n", distinct=True).distinct().count() == 3 and frame.sample(five, 9, "n").count() == 9
    assert frame.resize(five, 7, "n").count() == 7 and frame.resize(five, 2, "n").count() == 2


def test_flatten_and_concat(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0],)], "X array<double>")
    flat = frame.flatten(df)
    assert flat.columns == ["X.0", "X.1", "X.2"] and math.isnan(rows(flat)[1][2])
    both = frame.concat([spark.createDataFrame([(1, "a")], "i int, t string"), spark.createDataFrame([(2,)], "i int")])
    assert sorted(rows(both)) == [(1, "a"), (2, "")]


def test_sets_and_renames(five):
    changed = frame.set_where(five, "AA", F.col("AA") == 2, 9)
    assert sorted(r["AA"] for r in changed.collect()) == [0, 0, 1, 1, 9]
    assert frame.rename(five, ["a", "", "c", "d"]).columns == ["a", "BB", "c", "d"]
    with pytest.raises(TypeError):
        frame.filter_rows(five, "AA")
    with pytest.raises(TypeError):
        frame.assign(five, "AA", F.lit("x"))


def test_a_text_constant_is_no_column(spark):
    df = spark.createDataFrame([("status", "x"), ("x", "x")], "name string, status string")
    out = df.select(E.compare(df, "name", "==", "status").alias("a"), E.compare(df, "name", "==", E.Name("status")).alias("b"), E.arithmetic(df, E.Text("name"), "+", "!").alias("c"))
    assert rows(out) == [(True, False, "name!"), (False, True, "name!")]


def test_integer_means_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (None, None), (3, 3.0)], "a int, b double")
    assert rows(aggregate.aggregate(df, "mean")) == [(2, 2.0)]
    grouped = aggregate.group_aggregate(df.withColumn("k", F.lit(1)), "k", "mean", sort=False)
    assert rows(grouped) == [(1, 2, 2.0)]


def test_columns_from_arrays_and_functions(five, spark):
    import dataclasses

    import numpy as np

    out = frame.add_column(five, "DD", np.array([5, 4, 3, 2, 1]), "int", "n")
    assert [(r["n"], r["DD"]) for r in out.orderBy("n").collect()] == [(0, 5), (1, 4), (2, 3), (3, 2), (4, 1)]
    with pytest.raises(ValueError):
        frame.add_column(five, "DD", [1], "int", "n")
    with pytest.raises(TypeError):
        frame.add_column(five, "AA", ["x"] * 5, "string", "n")
    table = delimited.from_arrays(spark, {"a": np.array([1, 2]), "b": [0.5, float("nan")], "c": ["x", None]})
    assert table.dtypes == [("a", "int"), ("b", "double"), ("c", "string")] and [r[0] for r in table.collect()] == [1, 2]
    with pytest.raises(ValueError):
        delimited.from_arrays(spark, {"a": [1], "b": [1, 2]})

    @dataclasses.dataclass
    class Row:
        AA: int
        CC: str

    assert [r for r in frame.rows_as(five.orderBy("n").select("AA", "CC"), Row)][1] == Row(1, "text2")
    assert rows(frame.apply(five, "s", lambda a, n: a + n, ["AA", "n"], "long").select("s").orderBy("s")) == [(0,), (2,), (2,), (5,), (5,)]
    assert rows(frame.filter_by(five, lambda x: x > 1, "AA").select("n")) == [(3,)]
    assert rows(frame.map_rows(five, lambda r: [{"n": r["n"]}] * r["AA"], "n int").orderBy("n")) == [(1,), (3,), (3,), (4,)]
    total = aggregate.combine(five.repartition(3), "n", lambda x: int(x.sum()), lambda x: int(x.sum()), "long")
    assert rows(total) == [(10,)] and rows(aggregate.combine(five.limit(0), "n", lambda x: 1, lambda x: 1, "long")) == []


def test_frames_compare(five):
    assert frame.equal(five, five.orderBy(F.desc("n"))) and not frame.equal(five, five.limit(4)) and not frame.equal(five, five.drop("n"))
    near = five.withColumn("BB", F.col("BB") * (1 + 1e-9))
    assert not frame.equal(five, near) and frame.equal(five, near, 1e-6, "n")
    twice = five.union(five.limit(1))
    assert not frame.equal(five, twice)
    odd = five.withColumn("BB", F.when(F.col("n") == 0, float("nan")).when(F.col("n") > 1, F.col("BB")))
    assert frame.equal(odd, odd) and frame.equal(odd, odd, 1e-6, "n")
    with pytest.raises(AssertionError, match="side='right'"):
        frame.assert_equal(five, odd, 1e-6, "n")
    assert [t for _, t in frame.as_type(five, "BB", "I4").dtypes] == ["int", "int", "string", "int"]


def test_files_streams_and_encodings(spark, tmp_path):
    import io

    for i, name in enumerate("ab"):
        (tmp_path / f"{name}.csv").write_bytes(f"x;y\n{i};caf\u00e9\n{i + 2};th\u00e9\n".encode("latin-1"))
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    df = delimited.read_csv(spark, paths, sep=";", encoding="ISO-8859-1", index=True)
    assert rows(df.orderBy("index")) == [(0, 0, "caf\u00e9"), (1, 2, "th\u00e9"), (2, 1, "caf\u00e9"), (3, 3, "th\u00e9")]
    opened = delimited.read_from(spark, lambda: io.BytesIO("a,b\n1,caf\u00e9".encode("latin-1")), encoding="latin-1")
    assert rows(opened) == [(1, "caf\u00e9")] == rows(delimited.read_from(spark, lambda: io.StringIO("a,b\n1,caf\u00e9")))


def test_ordered_joins_by_place(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y"), (2, "w")], "k int, v string")
    b = spark.createDataFrame([("p", 2), ("q", 3)], "u string, k int")
    out = frame.join(a, b, 0, 1, "outer", order=["v"])
    assert out.columns == ["k", "v", "u", "k_y"] and [tuple(r) for r in out.collect()] == [(1, "y", None, None), (2, "w", "p", 2), (2, "x", "p", 2), (None, None, "q", 3)]


def test_blank_rows_dictionaries_and_text(spark):
    schema = spark.createDataFrame([], "a int, b double, c string, d boolean").schema
    (one, two) = rows(delimited.blank(spark, schema, 2))
    assert one[0] == 0 and math.isnan(one[1]) and one[2:] == ("", False) and two[0] == 0
    assert rows(delimited.from_dictionary(spark, {("b", 1): 2.0, ("a", 2): 1.0}, ["k", "n"])) == [("a", 2, 1.0), ("b", 1, 2.0)]
    text = delimited.to_csv_string(spark.createDataFrame([(None, "", float("nan"))], "a int, b string, c double"))
    assert text == 'a,b,c\n?,"",?'
    assert frame.has_vectors(spark.sql("select array(1) as v")) and not frame.has_vectors(spark.sql("select 1 as v"))
