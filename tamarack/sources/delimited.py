"""Delimited text and other sources, and text sinks.

Cells are split at the separator and nothing else: no quoting. The schema comes from a bounded sample of
rows; the data itself is read by Spark's own reader with that schema.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import islice
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import DEFAULTS, SPARK_TYPES, guess_kind, infer_schema, kind_of, widest
from ..operators.frame import flatten, with_index


def _read(spark: SparkSession, source, sample: list[str], sep: str, header: bool, names, dtypes, guess_rows: int, encoding: str = "UTF-8") -> DataFrame:
    if not sample:
        raise ValueError("there is nothing to read")
    first = sample[0].split(sep)
    names = list(names) if names else [c.strip().lstrip("#") for c in first] if header else [f"c{i}" for i in range(len(first))]
    schema = infer_schema(names, [line.split(sep) for line in sample[1 if header else 0 :][:guess_rows]], dtypes)
    options = {"sep": sep, "header": str(header).lower(), "quote": "", "enforceSchema": "true", "encoding": encoding}
    df = spark.read.schema(schema).options(**options, ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true").csv(source)
    return df


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", header: bool = True, names: Sequence[str] | None = None,
    dtypes: dict[str, str] | None = None, nrows: int = -1, guess_rows: int = 10, encoding: str = "UTF-8", index: bool = False,
) -> DataFrame:
    """One or several delimited files; the schema comes from the first ``guess_rows`` rows of the first.

    ``nrows``: only the first rows by file and line; ``index`` puts the rows' places, in the same order, in front.
    """
    first = path if isinstance(path, str) else path[0]
    shown = spark.read.options(encoding=encoding, sep="\u0001", quote="").schema("value string").csv(first)  # the reader that knows encodings
    sample = [r["value"] for r in shown.where("trim(value) <> ''").take(guess_rows + 1)]
    if header:  # the parts of a folder each start with it
        sample = sample[:1] + [x for x in sample[1:] if x != sample[0]]
    df = _read(spark, path if isinstance(path, str) else list(path), sample, sep, header, names, dtypes, guess_rows, encoding)
    if not index and nrows < 0:
        return df
    order = ["_file", "_block", "_row"]
    placed = df.withColumns({"_file": F.input_file_name(), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    if nrows >= 0:  # the first rows, not any
        placed = placed.orderBy(*order).limit(nrows)
    return (indexed(placed, order) if index else placed).drop(*order)


def read_from(spark: SparkSession, opened: Callable[[], IO], encoding: str = "UTF-8", **options) -> DataFrame:
    """A small table from what ``opened()`` gives to read: text or bytes, of a file or anything like one."""
    with opened() as stream:
        content = stream.read()
    return read_str(spark, content.decode(encoding) if isinstance(content, bytes) else content, **options)


def from_arrays(spark: SparkSession, arrays: Mapping[str, Sequence], dtypes: dict[str, str] | None = None) -> DataFrame:
    """A small table from arrays of equal lengths, by column name; ``dtypes`` (name to kind) overrides their kinds."""
    columns = {name: [v.item() if hasattr(v, "item") else v for v in values] for name, values in arrays.items()}
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("the arrays have different lengths")
    kinds = {n: (dtypes or {}).get(n) or widest(map(_kind, v)) for n, v in columns.items()}
    schema = T.StructType([T.StructField(n, SPARK_TYPES[k], metadata={"kind": k} if k == "U4" else {}) for n, k in kinds.items()])
    return from_rows(spark, [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)], schema)


def read_str(spark: SparkSession, content: str, sep: str = ",", header: bool = True, names=None, dtypes=None, nrows: int = -1, guess_rows: int = 10, index: bool = False) -> DataFrame:
    """A small table from a string; ``index`` puts the rows' places in front."""
    lines = [x for x in content.splitlines() if x.strip()]
    if not lines:
        raise ValueError("there is nothing to read")
    first = lines[0].split(sep)
    names = list(names) if names else [c.strip().lstrip("#") for c in first] if header else [f"c{i}" for i in range(len(first))]
    rows = [line.split(sep) for line in lines[1 if header else 0 :]]
    schema = infer_schema(names, rows[:guess_rows], dtypes)
    rows = rows if nrows < 0 else rows[:nrows]
    return from_rows(spark, [dict(zip(names, r, strict=False)) for r in rows], schema, index)


def from_rows(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType | None = None, index: bool = False) -> DataFrame:
    """Dictionaries as rows; absent cells get their kind's default. Without a schema the first ten rows decide."""
    if schema is None:
        names = list(dict.fromkeys(k for r in islice(rows, 10) for k in r))
        schema = T.StructType([T.StructField(n, SPARK_TYPES[widest(_kind(r.get(n)) for r in islice(rows, 10))]) for n in names])
    cells = []
    for i, row in enumerate(rows):
        values = [_cell(row.get(f.name), f) for f in schema]
        cells.append([i, *values] if index else values)
    name = "index"
    while name in schema.names:
        name += "_"
    full = T.StructType([T.StructField(name, T.LongType()), *schema]) if index else schema
    return spark.createDataFrame(cells, full)


def _kind(value) -> str | None:
    return None if value is None else {bool: "BL", int: "I4", float: "R8"}.get(type(value)) or ("TX" if isinstance(value, str) else guess_kind(str(value)))


def _cell(value, field: T.StructField):
    kind = kind_of(field)
    if value is None or (value == "" and kind != "TX"):
        return DEFAULTS.get(kind)
    if isinstance(value, str) and kind != "TX":
        value = value.strip()
        return value.lower() == "true" if kind == "BL" else int(value) if kind in ("I4", "U4", "I8") else float(value)
    return str(value) if kind == "TX" else float(value) if kind in ("R4", "R8") else value


def from_dictionary(spark: SparkSession, values: Mapping, keys: Sequence[str], value: str = "value") -> DataFrame:
    """A dictionary, sorted by key, as key columns (tuples: several) and a value column."""
    rows = [dict(zip([*keys, value], [*(k if isinstance(k, tuple) else (k,)), v], strict=True)) for k, v in sorted(values.items())]
    return from_rows(spark, rows)


def blank(spark: SparkSession, schema: T.StructType, n: int = 1) -> DataFrame:
    """``n`` rows of default cells."""
    return spark.range(n).select(*(F.lit(DEFAULTS.get(kind_of(f))).cast(f.dataType).alias(f.name) for f in schema))


def indexed(df: DataFrame, order) -> DataFrame:
    """``df`` with its index column in front."""
    out = with_index(df, order)
    return out.select(out.columns[-1], *out.columns[:-1])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error") -> None:
    """Delimited text: nulls and NaN as ``?``, empty text as two quotes; vectors are flattened."""
    df = flatten(df)
    df.write.mode(mode).options(sep=sep, header=str(header).lower(), nullValue="?", nanValue="?", emptyValue='""', quote="").csv(path)


def to_csv_string(df: DataFrame, sep: str = ",") -> str:
    """A small frame as text, read row by row."""
    df = flatten(df)
    lines = [sep.join(df.columns)]
    for row in df.toLocalIterator():
        lines.append(sep.join(_text(v) for v in row))
    return "\n".join(lines)


def _text(value) -> str:
    if value is None or value != value:
        return "?"
    return '""' if value == "" else f"{value:.7g}" if isinstance(value, float) else str(value)
