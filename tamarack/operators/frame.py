"""The frame vocabulary over Spark DataFrames.

A frame has no row order of its own. Operators that speak of places take ``order``: the columns that
define it. Positions are then ranks in that order, found by a distributed index, never by collecting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import almost_equal
from ..functions.kinds import DEFAULTS, SPARK_TYPES, fill_missing, kind_of
from ..session import durable


def _keys(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def running_sums(df: DataFrame, order: str | Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with new columns: each value summed over the rows up to this one in ``order``.

    Rows are range-partitioned and sorted, summed by partition, and continued from these few sums: no
    window over the whole table in one task.
    """
    ordered = durable(df.orderBy(*_keys(order)).withColumns({"_part": F.spark_partition_id()} | values))
    sums = ordered.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in values))  # one row a partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in values))
    inside = Window.partitionBy("_part").orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ordered.withColumns({c: F.sum(c).over(inside) for c in values}).join(F.broadcast(before), "_part")
    return joined.withColumns({c: F.col(c) + F.col(f"_{c}") for c in values}).drop("_part", *(f"_{c}" for c in values))


def with_index(df: DataFrame, order: str | Sequence[str], name: str = "index") -> DataFrame:
    """``df`` with the place (from 0) of each row in ``order``; ``name`` gets a ``_`` while it is taken."""
    while name in df.columns:
        name += "_"
    return running_sums(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys' text alone: 48 bits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *((k if isinstance(k, Column) else F.col(f"`{k}`")).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def filter_rows(df: DataFrame, mask: str | Column) -> DataFrame:
    """Rows where a boolean column or condition is true; another type of column is an error."""
    if isinstance(mask, str):
        if not isinstance(df.schema[mask].dataType, T.BooleanType):
            raise TypeError(f"{mask} is not boolean")
        mask = F.col(f"`{mask}`")
    return df.where(mask)


def _hits(df: DataFrame, places: Sequence[int], order: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may stand at ``places``, with ``_place``; all other rows).

    Only the order's columns are sorted. The sizes of their range partitions (a number each) tell which few of these hold the
    places, and the counts of keys in those tell which keys: no more than there are places. The rows with these keys come by a
    broadcast join with them, and only they are numbered where keys repeat.
    """
    keys = _keys(order)
    spark, wanted = df.sparkSession, sorted({int(p) for p in places if p >= 0})
    o = [f"_o{i}" for i in range(len(keys))]
    sorted_keys = durable(df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, o, strict=True))).orderBy(*o).withColumn("_part", F.spark_partition_id()))
    start, parts = 0, []
    for part, n in sorted_keys.groupBy("_part").agg(F.count(F.lit(1))).orderBy("_part").collect():  # one row a partition
        if any(start <= p < start + n for p in wanted):
            parts.append((part, start))
        start += n
    bases = spark.createDataFrame(parts, "_part int, _base long")
    inside = Window.partitionBy("_part").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    tied = sorted_keys.join(F.broadcast(bases), "_part").groupBy("_part", "_base", *o).agg(F.count(F.lit(1)).alias("_n"))
    firsts = tied.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    holds = F.exists(F.array(*(F.lit(p) for p in wanted)).cast("array<bigint>"), lambda p: (p >= F.col("_first")) & (p < F.col("_first") + F.col("_n")))
    found = firsts.where(holds).select(*o, "_first", "_n").orderBy("_first").collect()  # no more than the places
    rows, before = [], 0
    for r in found:
        rows.append((*r[: len(o)], r["_first"], before))
        before += r["_n"]
    schema = T.StructType([*(T.StructField(n, df.schema[k].dataType) for k, n in zip(keys, o, strict=True)), T.StructField("_first", T.LongType()), T.StructField("_before", T.LongType())])
    chosen = F.broadcast(spark.createDataFrame(rows, schema))
    on = None
    for k, n in zip(keys, o, strict=True):
        one = F.col(f"`{k}`").eqNullSafe(F.col(n))
        on = one if on is None else on & one
    hits = df.join(chosen, on)
    if before > len(rows):  # keys that repeat
        hits = with_index(hits.withColumn("_tie", F.xxhash64(*(f"`{c}`" for c in df.columns))), [*o, "_tie"], "_nth").drop("_tie")
        hits = hits.withColumn("_place", F.col("_first") + F.col("_nth") - F.col("_before")).drop("_nth")
    else:
        hits = hits.withColumn("_place", F.col("_first"))
    return hits.drop(*o, "_first", "_before"), df.join(chosen, on, "left_anti")


def take(df: DataFrame, places: Sequence[int], order: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows at ``places`` in ``order``, repeats and their sequence kept; optionally only some columns. Equal keys are put in order by a hash of the row."""
    wanted = df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(places)], "_place long, _nth int")
    found = _hits(df, places, order)[0].join(F.broadcast(wanted), "_place").orderBy("_nth").drop("_place", "_nth")
    return found.select(*columns) if columns else found


def row_at(df: DataFrame, place: int, order: str | Sequence[str]) -> dict | None:
    """The row at one place as a dictionary, or None."""
    found = take(df, [place], order).first()
    return found.asDict() if found else None


def assign(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A new column, or one of the same kind in place of the old."""
    new = df.withColumn(name, value)
    if name in df.columns and new.schema[name].dataType != df.schema[name].dataType:
        raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {new.schema[name].dataType.simpleString()}")
    return new


def add_column(df: DataFrame, name: str, values: Sequence, kind: str, order: str | Sequence[str]) -> DataFrame:
    """A driver's array as a column of Spark type ``kind``: its values in ``order``, as many as rows."""
    values = [v.item() if hasattr(v, "item") else v for v in values]
    placed = with_index(df, order, "_place")
    if placed.count() != len(values):
        raise ValueError(f"{df.count()} values are needed, not {len(values)}")
    new = df.sparkSession.createDataFrame(list(enumerate(values)), f"_at long, _value {kind}")
    joined = placed.join(new, F.col("_place") == F.col("_at"))
    return assign(joined, name, F.col("_value")).drop("_place", "_at", "_value")


def apply(df: DataFrame, name: str, function: Callable, columns: str | Sequence[str], kind: str) -> DataFrame:
    """``name``, of Spark type ``kind``: ``function`` over pandas Series of ``columns``, batch by batch."""
    return df.withColumn(name, _series(function, kind)(*(F.col(f"`{c}`") for c in _keys(columns))))


def filter_by(df: DataFrame, function: Callable, columns: str | Sequence[str]) -> DataFrame:
    """Rows for which ``function`` over pandas Series of ``columns`` is true."""
    return df.where(_series(function, "boolean")(*(F.col(f"`{c}`") for c in _keys(columns))))


def _series(function: Callable, kind: str) -> Callable:
    def run(*columns):
        return function(*columns)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def map_rows(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """The rows, any number, that ``function`` makes of each row, both as dictionaries."""
    fields = T.StructType.fromDDL(schema).names

    def made(frames):
        for frame in frames:
            rows = [new for row in frame.to_dict("records") for new in function(row)]
            yield pd.DataFrame([[r.get(f) for f in fields] for r in rows], columns=fields)

    return df.mapInPandas(made, schema)


def rows_as(df: DataFrame, cls: Callable) -> Iterator:
    """The rows, one partition at a time, as ``cls(**cells)``: a dataclass or the like."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield cls(**row.asDict())


def as_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A column cast to a kind (BL, I4, U4, I8, R4, R8, TX); reals lose their fraction toward zero, NaN as an integer is an error."""
    field = F.col(f"`{name}`").cast(SPARK_TYPES[kind])
    return df.withColumn(name, field).withMetadata(name, {"kind": kind} if kind == "U4" else {})


def differences(a: DataFrame, b: DataFrame, precision: float | None = None, keys: str | Sequence[str] = ()) -> DataFrame:
    """Rows of either frame that the other lacks, with ``side`` (left or right); none: the frames are equal.

    Rows count as often as they repeat, whatever their order; null equals null and NaN equals NaN. With
    ``precision`` rows meet by ``keys``, and reals are equal within that relative error. Columns must have
    the same names and types.
    """
    if a.dtypes != b.dtypes:
        raise TypeError(f"columns differ: {a.dtypes}, {b.dtypes}")
    if precision is None:
        left, right = a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))
        return left.unionByName(right)
    on, rest = _keys(keys), [f for f in a.schema if f.name not in _keys(keys)]
    l, r = (df.select(*(F.col(f"`{k}`") for k in on), F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias(side)) for df, side in ((a, "left"), (b, "right")))
    same = F.lit(True)
    for f in rest:
        x, y = F.col("left")[f.name], F.col("right")[f.name]
        close = almost_equal(x, y, precision) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else x.eqNullSafe(y)
        same = same & close
    met = l.join(r, on, "full").where(F.col("left").isNull() | F.col("right").isNull() | ~same)
    return met.select(*on, F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("row")), F.struct(F.lit("right").alias("side"), F.col("right").alias("row")))).alias("d")).where("d.row is not null").select(*on, "d.row.*", "d.side")


def equal(a: DataFrame, b: DataFrame, precision: float | None = None, keys: str | Sequence[str] = ()) -> bool:
    """Whether two frames hold the same rows, as ``differences`` tells."""
    return a.dtypes == b.dtypes and differences(a, b, precision, keys).isEmpty()


def assert_equal(a: DataFrame, b: DataFrame, precision: float | None = None, keys: str | Sequence[str] = ()) -> None:
    """AssertionError with up to five rows that differ."""
    if some := differences(a, b, precision, keys).limit(5).collect():
        raise AssertionError("\n".join(map(str, some)))


def set_where(df: DataFrame, name: str, mask: Column, value) -> DataFrame:
    """``value`` in ``name`` where ``mask`` holds, the old cells elsewhere."""
    kind = df.schema[name].dataType
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, F.when(mask, value.cast(kind)).otherwise(F.col(f"`{name}`")))


def set_at(df: DataFrame, name: str, places: Sequence[int], value, order: str | Sequence[str]) -> DataFrame:
    """``value`` in ``name`` at ``places`` in ``order``."""
    hits, rest = _hits(df, places, order)
    changed = set_where(hits, name, F.col("_place").isin([int(p) for p in places]), value).drop("_place")
    return rest.unionByName(changed)


def pick(df: DataFrame, mask: str | Column, columns: Sequence[str | int] | None = None) -> DataFrame:
    """Rows where a mask is true, and some columns by name or number: the getter by mask."""
    found = filter_rows(df, mask)
    return found if columns is None else found.select(*(f"`{c}`" for c in _named(df, list(columns))))


def set_values(df: DataFrame, name: str, mask: str | Column, values: Sequence, order: str | Sequence[str]) -> DataFrame:
    """The rows where ``mask`` holds get ``values``, in ``order``: as many as there are such rows, or an error."""
    mask = F.col(f"`{mask}`") if isinstance(mask, str) else mask
    hit = F.coalesce(mask, F.lit(False))
    placed = with_index(df.where(hit), order, "_place")
    if (n := placed.count()) != len(values):
        raise ValueError(f"{n} values are needed, not {len(values)}")
    kind = df.schema[name].dataType
    new = df.sparkSession.createDataFrame([(i, v.item() if hasattr(v, "item") else v) for i, v in enumerate(values)], T.StructType([T.StructField("_at", T.LongType()), T.StructField("_value", kind)]))
    changed = placed.join(new, F.col("_place") == F.col("_at")).withColumn(name, F.col("_value")).select(*(f"`{c}`" for c in df.columns))
    return df.where(~hit).unionByName(changed)


def override_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The frame under a schema in which some columns have other kinds (BL, I4, U4, I8, R4, R8, TX), as ``DataFrame.to`` casts them."""
    if missing := [c for c in kinds if c not in df.columns]:
        raise ValueError(f"no column {missing[0]}")
    fields = [T.StructField(f.name, SPARK_TYPES[kinds[f.name]], f.nullable, {"kind": "U4"} if kinds[f.name] == "U4" else {}) if f.name in kinds else f for f in df.schema]
    return df.to(T.StructType(fields))


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names by position; an empty one keeps the old; the count must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} names are needed, not {len(names)}")
    return df.toDF(*(new or old for new, old in zip(names, df.columns, strict=True)))


def order_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the given sequence; those not named are left out."""
    return df.select(*(f"`{n}`" for n in names))


def cell(df: DataFrame, place: int, column: str | int, order: str | Sequence[str]):
    """One cell by place and name (or column number), or None."""
    name = df.columns[column] if isinstance(column, int) else column
    found = row_at(df, place, order)
    return found[name] if found else None


def has_vectors(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, T.ArrayType) for f in df.schema)


def flatten(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Vector columns as ``name.0`` to ``name.k-1``, k the largest length; missing slots get the kind's default."""
    vectors = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and (columns is None or f.name in columns)]
    if not vectors:
        return df
    sizes = df.agg(*(F.max(F.size(f"`{v}`")).alias(v) for v in vectors)).first()
    out = []
    for field in df.schema:
        if field.name not in vectors:
            out.append(F.col(f"`{field.name}`"))
            continue
        item = field.dataType.elementType
        default = F.lit(DEFAULTS.get(kind_of(T.StructField("x", item)))).cast(item)
        for i in range(max(sizes[field.name] or 0, 0)):
            out.append(F.coalesce(F.get(F.col(f"`{field.name}`"), F.lit(i)), default).alias(f"{field.name}.{i}"))
    return df.select(*out)


def concat(frames: Sequence[DataFrame], missing: str = "default") -> DataFrame:
    """All rows by column name, columns as first seen; cells of absent columns follow ``missing``."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for field in df.schema:
            if kinds.setdefault(field.name, field.dataType) != field.dataType:
                raise TypeError(f"{field.name} has two types")
    parts = []
    for df in frames:
        absent = [c for c in kinds if c not in df.columns]
        full = df.withColumns({c: F.lit(None).cast(kinds[c]) for c in absent}) if absent else df
        parts.append(fill_missing(full, missing, absent).select(*(f"`{c}`" for c in kinds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sort(df: DataFrame, columns: str | Sequence[str] | None = None, ascending: bool = True, nan_first: bool = False) -> DataFrame:
    """Sorted by columns (none: the first three), one direction for all; ``nan_first``: NaN below all numbers."""
    keys: list[Column] = []
    for name in _keys(columns) if columns else df.columns[:3]:
        column = F.col(f"`{name}`")
        if nan_first and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            keys.append(~F.isnan(column))
        keys.append(column)
    return df.orderBy(*(k.asc() if ascending else k.desc() for k in keys))


def argsort(df: DataFrame, column: str, order: str | Sequence[str], name: str = "place") -> DataFrame:
    """(rank, place): the places in ``order`` of the rows as ``column`` sorts them, ties by place."""
    placed = with_index(df.select(*dict.fromkeys([*_keys(order), column])), order, name)
    at = placed.columns[-1]
    return with_index(placed.select(F.col(f"`{column}`").alias("_value"), at), ["_value", at], "rank").select("rank", at)


def shuffle(df: DataFrame, key: str | Sequence[str], seed: int = 0) -> DataFrame:
    """Rows in a seeded random order that depends on their keys alone."""
    return df.orderBy(draw(seed, *_keys(key)), *_keys(key))


def head(df: DataFrame, order: str | Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*_keys(order)).limit(n)


def tail(df: DataFrame, order: str | Sequence[str], n: int = 5) -> DataFrame:
    """The last rows, in ``order``."""
    last = df.orderBy(*(F.col(f"`{k}`").desc() for k in _keys(order))).limit(n)
    return last.orderBy(*_keys(order))


def sample(df: DataFrame, n: int = 5, key: str | Sequence[str] = "index", distinct: bool = False, seed: int = 0) -> DataFrame:
    """``n`` rows: without repeats those whose seeded key hash is least; else n seeded draws of places."""
    if distinct:
        return df.orderBy(draw(seed, *_keys(key)), *_keys(key)).limit(n)
    numbered = with_index(df, key, "_place")
    rows = df.count()
    draws = df.sparkSession.range(n).select(F.floor(draw(seed, "id") * max(rows, 1)).alias("_place"), F.col("id").alias("_nth"))
    return numbered.join(draws, "_place").drop("_place", "_nth")


def resize(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows, with rows of default cells after them where there are fewer."""
    rows = df.count()
    if rows >= n:
        return head(df, order, n)
    blank = df.sparkSession.range(n - rows).select(*(F.lit(DEFAULTS.get(kind_of(f))).cast(f.dataType).alias(f.name) for f in df.schema))
    return df.unionByName(blank)


def multiply(df: DataFrame, n: int, how: str = "block", order: str | Sequence[str] | None = None) -> DataFrame:
    """Each row ``n`` times: as whole blocks one after the other, or each row by its copies."""
    if how not in ("block", "row"):
        raise ValueError(how)
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else df.limit(0).withColumn("_copy", F.lit(0))
    if order is not None:
        keys = _keys(order)
        copies = copies.orderBy(*(["_copy", *keys] if how == "block" else [*keys, "_copy"]))
    return copies.drop("_copy")


def _named(df: DataFrame, columns: str | int | Sequence[str | int]) -> list[str]:
    columns = [columns] if isinstance(columns, (str, int)) else columns
    return [df.columns[c] if isinstance(c, int) else c for c in columns]


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | int | Sequence[str | int],
    right_on: str | int | Sequence[str | int] | None = None,
    how: str = "inner",
    left_suffix: str = "",
    right_suffix: str = "",
    missing: str = "null",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join that keeps both key columns; keys are names or, as numbers, places of columns.

    With ``order`` (columns of the result) the rows come sorted by the keys and then by these. Left names get ``left_suffix``, right names ``right_suffix`` and then ``_y`` while they collide.
    Keys must be as many and of the same types on both sides, and not vectors. Null keys equal each other.
    Cells that an outer join leaves empty follow ``missing`` (null or sentinel). Spark picks the join.
    """
    a, b = _named(left, left_on), _named(right, right_on if right_on is not None else left_on)
    if len(a) != len(b):
        raise ValueError("both sides need as many keys")
    for x, y in zip(a, b, strict=True):
        kinds = left.schema[x].dataType, right.schema[y].dataType
        if kinds[0] != kinds[1] or isinstance(kinds[0], T.ArrayType):
            raise TypeError(f"{x} and {y} can't be joined: {kinds[0].simpleString()}, {kinds[1].simpleString()}")
    names = [c + left_suffix for c in left.columns]
    others: list[str] = []
    for c in right.columns:
        c += right_suffix
        while c in names or c in others:
            c += "_y"
        others.append(c)
    l, r = left.toDF(*names), right.toDF(*others)
    on = None
    for x, y in zip(a, b, strict=True):
        one = F.col(f"`{x + left_suffix}`").eqNullSafe(F.col(f"`{others[right.columns.index(y)]}`"))
        on = one if on is None else on & one
    joined = l.join(r, on, {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}[how])
    if how != "inner" and missing != "null":
        joined = fill_missing(joined, missing, {"left": others, "right": names}.get(how, names + others))
    if order is None:
        return joined
    keys = [F.coalesce(F.col(f"`{x + left_suffix}`"), F.col(f"`{others[right.columns.index(y)]}`")) for x, y in zip(a, b, strict=True)]
    return joined.orderBy(*keys, *(F.col(f"`{c}`") for c in order))
