"""The five frame aggregates, whole or by group, in each column's own kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import kind_of

FUNCTIONS = ("sum", "count", "mean", "min", "max")

#: Rows of one fold and results of one merge in ``ordered_fold``, powers of 2, and levels of merges before the last.
FOLD, MERGE, LEVELS = 1024, 256, 2


def _aggregate(field: T.StructField, function: str, order: Sequence[str], compat: bool) -> Column:
    """One column's aggregate. Sums and counts keep the kind, integer means truncate; text is joined in order."""
    kind, column, to = kind_of(field), F.col(f"`{field.name}`"), field.dataType
    if kind is None:
        raise TypeError(f"{field.name}: {to.simpleString()} has no aggregates")
    if function == "count":
        if compat and kind in ("BL", "TX"):
            return F.lit(False if kind == "BL" else "")
        return F.count(F.lit(1)).cast(to if compat and kind not in ("BL", "TX") else "long")
    if function == "mean":
        if kind in ("BL", "TX"):
            return F.lit(False if kind == "BL" else "") if compat else F.lit(None).cast(to)
        if kind in ("R4", "R8"):
            return F.avg(column).cast(to)
        return F.call_function("div", F.sum(column), F.count(column)).cast(to)
    if kind == "BL":
        return F.bool_or(column) if function in ("sum", "max") else F.bool_and(column)
    if function == "sum":
        if kind == "TX":
            if not order:
                raise ValueError(f"{field.name}: joining text needs an order")
            rows = F.array_sort(F.collect_list(F.struct(*(F.col(f"`{o}`") for o in order), column.alias("_text"))))
            return F.array_join(F.transform(rows, lambda r: r["_text"]), "")
        return F.sum(column).cast(to)
    return (F.min if function == "min" else F.max)(column)


def aggregate(df: DataFrame, function: str, columns: Sequence[str] | None = None, order: Sequence[str] = (), compat: bool = True) -> DataFrame:
    """One row: ``function`` (sum, count, mean, min, max) of every column, under the same names.

    ``compat``: counts and means of booleans and text are false and empty; else counts are long
    and such means null. ``order``: columns by which text is joined.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return df.agg(*(_aggregate(f, function, order, compat).alias(f.name) for f in fields))


def group_aggregate(df: DataFrame, keys: str | Sequence[str], function: str, order: Sequence[str] = (), sort: bool = True, compat: bool = True) -> DataFrame:
    """Keys first, then ``function`` of every other column; ascending keys if ``sort``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if any(isinstance(df.schema[k].dataType, T.ArrayType) for k in keys):
        raise TypeError("vectors are no keys")
    rest = [f for f in df.schema if f.name not in keys]
    out = df.groupBy(*keys).agg(*(_aggregate(f, function, order, compat).alias(f.name) for f in rest))
    return out.orderBy(*keys) if sort else out


def for_each_group(df: DataFrame, keys: str | Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` over each group's rows as one pandas frame: groups must fit a task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).applyInPandas(function, schema)


def label_histogram(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(label, weight): the sum of weights, or the number of rows, of each class."""
    value = F.sum(f"`{weight}`") if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(label).agg(value.alias("weight"))


def combine(df: DataFrame, column: str, partial: Callable[[pd.Series], object], merge: Callable[[pd.Series], object], kind: str) -> DataFrame:
    """One row (value): a function of a whole column, as ``merge`` of the ``partial`` results of its parts.

    Each part of the column is one Arrow batch; results are of Spark type ``kind``. They are merged as a
    tree: first within partitions, then the one result of each in a single task.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [partial(f[column]) for f in frames if len(f)]
        if found:
            yield pd.DataFrame({"value": [merge(pd.Series(found)) if len(found) > 1 else found[0]]})

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([f["value"] for f in frames] or [pd.Series(dtype=object)])
        if len(found):
            yield pd.DataFrame({"value": [merge(found) if len(found) > 1 else found.iloc[0]]})

    once = df.select(f"`{column}`").mapInPandas(parts, f"value {kind}")
    return once.repartition(1).mapInPandas(last, f"value {kind}")  # a value a partition


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, sum, sum2, nb) of numeric columns in one pass; NaN and infinite cells are left out."""
    parts = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum2"), F.count(x).alias("nb")
            )
        )
    return df.agg(F.array(*parts).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of each value of a column."""
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def fold(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, value): a left fold of ``column`` in ``order`` within each group."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(f"`{o}`") for o in order), F.col(f"`{column}`").alias("_x"))))
    return df.groupBy(*keys).agg(F.aggregate(rows, start, lambda a, r: step(a, r["_x"])).alias("value"))


def ordered_fold(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], start: Column, step: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, value): a left fold in ``order`` whose partial results ``merge`` joins: merge(fold(a), fold(b)) = fold(a then b).

    Rows are range-partitioned and sorted by (keys, order), so a hot key spreads, and numbered by partition and place. Each FOLD places in a row
    are one fold, and MERGE such results in a row one merge, level by level: no list is longer, and what grows as it is folded is copied
    once a level. ``start`` must not change what it is merged with. Null keys are a group; null cells reach ``step``; an empty table gives no
    rows; rows that are equal in ``order`` come by the cell.
    """
    o = [f"_o{i}" for i in range(len(order))]
    k = [f"_k{i}" for i in range(len(keys))]
    slim = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, k, strict=True)), *(F.col(f"`{c}`").alias(n) for c, n in zip(order, o, strict=True)), F.col(f"`{column}`").alias("_x"))
    # equal rows aside the order is whole, so that a task that runs again gives the same numbers
    ordered = slim.repartitionByRange(*k, *o, "_x").sortWithinPartitions(*k, *o, "_x").select(*k, F.monotonically_increasing_id().alias("_at"), F.col("_x").alias("_v"))

    def folded(rows: DataFrame, at: Column, then: Callable[[Column, Column], Column]) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("_at", "_v")))
        return rows.groupBy(*k, at.alias("_to")).agg(F.aggregate(listed, start, lambda a, r: then(a, r["_v"])).alias("_v")).withColumnRenamed("_to", "_at")

    parts = folded(ordered, F.shiftright("_at", FOLD.bit_length() - 1), step)
    for _ in range(LEVELS):
        parts = folded(parts, F.shiftright("_at", MERGE.bit_length() - 1), merge)
    whole = folded(parts, F.lit(0), merge)
    return whole.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), F.col("_v").alias("value"))


def text_sums(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): each group's text joined in order, nulls left out, by bounded partial folds."""
    return ordered_fold(df, keys, column, order, F.lit(""), lambda a, x: F.concat(a, F.coalesce(x, F.lit(""))), lambda a, b: F.concat(a, b))
