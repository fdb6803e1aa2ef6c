"""Column kinds: the inference lattice, the mapping to Spark types, and the policies for missing cells."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From narrow to wide; a column takes the widest kind that one of its cells needs.
LATTICE = ("BL", "I4", "U4", "I8", "R4", "R8", "TX")

#: U4 has no Spark type of its own: a long whose metadata says so.
SPARK_TYPES = {
    "BL": T.BooleanType(),
    "I4": T.IntegerType(),
    "U4": T.LongType(),
    "I8": T.LongType(),
    "R4": T.FloatType(),
    "R8": T.DoubleType(),
    "TX": T.StringType(),
}

_OF_TYPE = {"boolean": "BL", "int": "I4", "smallint": "I4", "tinyint": "I4", "bigint": "I8", "float": "R4", "double": "R8", "string": "TX"}

_INT = re.compile(r"[+-]?\d+$")
_REAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|[+-]?(nan|inf|infinity)$", re.IGNORECASE)


def guess_kind(cell: str) -> str | None:
    """The narrowest kind of one cell; None for an empty one, which tells nothing."""
    cell = cell.strip()
    if not cell:
        return None
    if cell.lower() in ("true", "false"):
        return "BL"
    if _INT.match(cell):
        value = int(cell)
        if -(2**31) <= value < 2**31:
            return "I4"
        if 0 <= value < 2**32:
            return "U4"
        return "I8" if -(2**63) <= value < 2**63 else "R8"
    if _REAL.match(cell):
        digits = len(re.sub(r"[eE].*|\D", "", cell).lstrip("0"))
        return "R4" if digits <= 7 else "R8"
    return "TX"


def widest(kinds: Iterable[str | None]) -> str:
    """The join of kinds in the lattice; text if none is known. A boolean beside a number is text."""
    known = {k for k in kinds if k}
    if not known:
        return "TX"
    if "BL" in known and len(known) > 1:
        return "TX"
    return max(known, key=LATTICE.index)


def infer_schema(names: list[str], rows: Iterable[list[str]], dtypes: dict[str, str] | None = None) -> T.StructType:
    """A schema from sampled rows of cells; ``dtypes`` (name to kind) overrides what they say."""
    columns = list(zip(*rows, strict=False)) or [()] * len(names)
    fields = []
    for name, cells in zip(names, columns, strict=False):
        kind = (dtypes or {}).get(name) or widest(map(guess_kind, cells))
        fields.append(T.StructField(name, SPARK_TYPES[kind], metadata={"kind": kind} if kind == "U4" else {}))
    return T.StructType(fields)


def kind_of(field: T.StructField) -> str | None:
    """The kind of a scalar field, or None."""
    return field.metadata.get("kind") or _OF_TYPE.get(field.dataType.simpleString())


#: What a missing cell becomes: in outer joins, and where a frame lacks a column.
SENTINELS = {"I4": -(2**31), "U4": 2**32 - 1, "I8": -(2**63), "R4": float("nan"), "R8": float("nan"), "TX": ""}
DEFAULTS = {"BL": False, "I4": 0, "U4": 0, "I8": 0, "R4": float("nan"), "R8": float("nan"), "TX": ""}


def fill_missing(df: DataFrame, policy: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Nulls replaced by policy: "null" (kept), "sentinel" (joins) or "default" (concatenation).

    Booleans have no sentinel: they stay null under "sentinel". Vectors stay null.
    """
    if policy == "null":
        return df
    values = {"sentinel": SENTINELS, "default": DEFAULTS}[policy]
    wanted = set(df.columns if columns is None else columns)
    out = []
    for field in df.schema:
        kind, column = kind_of(field), F.col(f"`{field.name}`")
        if field.name in wanted and kind in values:
            column = F.coalesce(column, F.lit(values[kind]).cast(field.dataType)).alias(field.name, metadata=field.metadata)
        out.append(column)
    return df.select(*out)


def not_nan(column: Column, data_type: T.DataType) -> Column:
    """True unless a real cell is NaN."""
    return ~F.isnan(column) if isinstance(data_type, (T.FloatType, T.DoubleType)) else F.lit(True)


def key_to_label(column: Column, data_type: T.DataType) -> Column:
    """A 1-based category code as a float label: 0 is NaN, x is x - 1; real labels are unchanged."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.cast("float")
    return F.when(column == 0, F.lit(float("nan"))).otherwise(column - 1).cast("float")
