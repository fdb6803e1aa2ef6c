"""Typed column arithmetic and IEEE comparisons over Spark columns.

Spark widens more than the kinds do (a float plus an integer is a double) and takes NaN as equal to
itself and larger than all; these helpers keep the kind and guard NaN. They only build expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinds import LATTICE, SPARK_TYPES, kind_of, not_nan


class Name(str):
    """Marks a text on the right as a column's name; unmarked it is a constant."""


class Text(str):
    """Marks a text on the left as a constant; unmarked it is a column's name."""


def _named(value, left: bool) -> bool:
    return isinstance(value, Name) or (left and isinstance(value, str) and not isinstance(value, Text))


def _side(df: DataFrame, value, left: bool) -> tuple[Column, str]:
    """A column name or a constant, as (expression, kind); what a constant says never makes it a column."""
    if _named(value, left):
        return F.col(f"`{value}`"), kind_of(df.schema[value])
    if isinstance(value, bool):
        return F.lit(value), "BL"
    if isinstance(value, int):
        return F.lit(value), "I4" if -(2**31) <= value < 2**31 else "I8"
    if isinstance(value, float):
        return F.lit(value), "R8"
    return F.lit(value), "TX"


def _wider(a: str, b: str) -> str:
    return max(a, b, key=LATTICE.index)


def arithmetic(df: DataFrame, left, op: str, right, constant_kind: str | None = None) -> Column:
    """left op right (+ - * /) in the wider of both kinds.

    Text on the left is a column's name (``Text`` marks a constant), on the right a constant (``Name`` marks
    a column); other values are constants. ``constant_kind`` gives a constant another kind than its
    Python type's, such as R4. Text has only +, concatenation. Integers divide toward zero.
    """
    (a, ka), (b, kb) = _side(df, left, True), _side(df, right, False)
    if constant_kind:
        ka, kb = (k if _named(x, i == 0) else constant_kind for i, (x, k) in enumerate(((left, ka), (right, kb))))
    if "TX" in (ka, kb):
        if op != "+" or ka != kb:
            raise TypeError(f"{ka} {op} {kb} is not defined")
        return F.concat(a, b)
    if "BL" in (ka, kb):
        raise TypeError("booleans have no arithmetic")
    kind = _wider(ka, kb)
    to = SPARK_TYPES[kind]
    if op == "/":
        if kind in ("R4", "R8"):
            return (a.cast("double") / b.cast("double")).cast(to)
        return F.call_function("div", a.cast("long"), b.cast("long")).cast(to)
    a, b = a.cast(to), b.cast(to)
    return ({"+": a + b, "-": a - b, "*": a * b}[op]).cast(to)


def negative(df: DataFrame, name: str) -> Column:
    return (-F.col(f"`{name}`")).cast(df.schema[name].dataType)


def compare(df: DataFrame, left, op: str, right) -> Column:
    """left op right (== != < <= > >=), sides as in ``arithmetic``, as IEEE has it: with NaN only != is true."""
    (a, ka), (b, kb) = _side(df, left, True), _side(df, right, False)
    if ("TX" in (ka, kb) or "BL" in (ka, kb)) and ka != kb:
        raise TypeError(f"{ka} {op} {kb} is not defined")
    if ka == "BL" and op not in ("==", "!="):
        raise TypeError("booleans have no order")
    real = F.lit(True)
    for kind, side in ((ka, a), (kb, b)):
        if kind in ("R4", "R8"):
            real = real & not_nan(side, SPARK_TYPES["R8"])
    if op == "!=":
        return (a != b) | ~real
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op] & real


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def negated(a: Column) -> Column:
    return ~a


def almost_equal(a: Column, b: Column, precision: float = 1e-6) -> Column:
    """Equal within a relative error of finite values; NaN equals NaN, an infinity itself, null equals null."""
    top = F.lit(float("inf"))  # NaN is above it
    finite = (F.abs(a) < top) & (F.abs(b) < top)
    close = F.abs(a - b) <= precision * F.greatest(F.abs(a), F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(finite & close, F.lit(False))
