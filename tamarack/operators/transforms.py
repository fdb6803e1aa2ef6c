"""Fit-then-apply transforms over columns and vectors.

Each has ``fit(df)``, which returns it with its parameters, and ``transform(df)``, which only adds or
replaces columns (or rows, for the duplicators). Fitted parameters are a few numbers in ``params``; random
choices are hashes of a key, so they do not depend on how rows are partitioned.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import key_to_label, kind_of
from . import frame
from .aggregate import histogram, moments


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return frame.draw(seed, *keys)


def _pair(col: str) -> tuple[str, str]:
    """``New:Old`` as (new, old); a single name is both."""
    new, _, old = col.partition(":")
    return new, old or new


def _is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


@dataclass
class Transform:
    """What all transforms share: nothing to fit unless a subclass says so."""

    def fit(self, df: DataFrame) -> Transform:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Scaler(Transform):
    """Affine scaling ``(x - a) * s`` of a column or vector: meanVar (population deviation) or minMax.

    NaN and infinite cells do not count for the fit; without spread the value is only centred.
    """

    col: str = ""
    scale: str = "meanVar"
    params: list[tuple[float, float]] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Scaler:
        _, old = _pair(self.col)
        x = F.col(f"`{old}`")
        if _is_vector(df, old):
            df, key = df.select(F.posexplode(x).alias("i", "x")), ["i"]
            x = F.col("x")
        else:
            df, key = df.select(x.alias("x")), []
        x = F.col("x").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        rows = df.groupBy(*key).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        rows = (rows.orderBy(*key) if key else rows).collect()
        self.params = []
        for r in rows:  # one row a slot
            a, spread = (r["m"], r["s"]) if self.scale == "meanVar" else (r["lo"], None if r["hi"] is None else r["hi"] - r["lo"])
            self.params.append((a or 0.0, 1.0 / spread if spread else 1.0))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        if not _is_vector(df, old):
            a, s = self.params[0]
            return df.withColumn(new, ((F.col(f"`{old}`").cast("double") - a) * s).cast(df.schema[old].dataType if kind_of(df.schema[old]) in ("R4", "R8") else "double"))
        pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")) for a, s in self.params))
        item = df.schema[old].dataType.elementType
        return df.withColumn(new, F.zip_with(F.col(f"`{old}`"), pairs, lambda x, p: ((x - p["a"]) * p["s"]).cast(item)))


@dataclass
class Polynomial(Transform):
    """Monomials of degree 1 to ``d`` (at most 3) with repetition, in lexicographic order within a degree."""

    col: str = ""
    d: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        v = F.col(f"`{old}`")
        parts = [v]
        if not 1 <= self.d <= 3:
            raise ValueError("degree 1, 2 or 3")
        if self.d >= 2:
            parts.append(F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda y: x * y))))
        if self.d == 3:
            # places are carried along, so that the third factor starts at the second one's
            parts.append(
                F.flatten(
                    F.flatten(
                        F.transform(
                            v,
                            lambda x, i: F.transform(
                                F.slice(F.transform(v, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), i + 1, F.size(v)),
                                lambda p: F.transform(F.slice(v, p["j"] + 1, F.size(v)), lambda z: x * p["y"] * z),
                            ),
                        )
                    )
                )
            )
        return df.withColumn(new, F.concat(*parts).cast(df.schema[old].dataType))


@dataclass
class Detrend(Transform):
    """The least-squares line of a value over time, minus the value (in that sense)."""

    col: str = ""
    time: str = "time"
    params: tuple[float, float] = (0.0, 0.0)

    def fit(self, df: DataFrame) -> Detrend:
        _, old = _pair(self.col)
        x, t = F.col(f"`{old}`").cast("double"), F.col(f"`{self.time}`").cast("double")
        r = df.agg(F.regr_slope(x, t).alias("a"), F.regr_intercept(x, t).alias("b"), F.avg(x).alias("m")).first()
        self.params = (r["a"], r["b"]) if r["a"] is not None else (0.0, r["m"] or 0.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        a, b = self.params
        return df.withColumn(new, (F.col(f"`{self.time}`").cast("double") * a + b - F.col(f"`{old}`")).cast("float"))


@dataclass
class AddRandom(Transform):
    """Seeded noise: [0, 1) for reals, -1 or 1 for integers, a random bit for booleans, one more letter for text."""

    col: str = ""
    key: str = ""
    s: int = 42

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        x, u = F.col(f"`{old}`"), uniform(self.s, F.col(f"`{self.key}`"))
        kind = df.schema[old].dataType
        if _is_vector(df, old):
            return df.withColumn(new, F.transform(x, lambda v, i: (v + uniform(self.s, F.col(f"`{self.key}`"), i)).cast(kind.elementType)))
        name = kind_of(df.schema[old])
        if name in ("R4", "R8"):
            value = (x + u).cast(kind)
        elif name == "BL":
            value = u < 0.5
        elif name == "TX":
            value = F.concat(x, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (u * 26).cast("int") + 1, F.lit(1)))
        elif name == "U4":
            value = (x + (u * 2).cast("int")).cast(kind)
        else:
            value = (x + F.when(u < 0.5, -1).otherwise(1)).cast(kind)
        return df.withColumn(new, value)


@dataclass
class Resample(Transform):
    """Each row a Poisson(``l``) number of times; with ``col`` and ``cl`` only rows of that class, others once."""

    key: str = ""
    l: float = 1.0
    s: int = 42
    col: str | None = None
    cl: object = None

    def transform(self, df: DataFrame) -> DataFrame:
        u = uniform(self.s, F.col(f"`{self.key}`"))
        steps, p, total, k = F.lit(0), math.exp(-self.l), 0.0, 0
        while k < 20 + 10 * self.l and total < 1 - 1e-12:  # the inverse of the distribution function
            total += p
            steps = steps + F.when(u >= total, 1).otherwise(0)
            k += 1
            p *= self.l / k
        times = steps if self.col is None else F.when(F.col(f"`{self.col}`") == F.lit(self.cl), steps).otherwise(1)
        return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")


@dataclass
class SplitTrainTest(Transform):
    """A part number by a stable seeded draw against ratios that sum to one."""

    key: str = ""
    col: str = "splitTrain0Test1"
    a: str = "2/3,1/3"
    seed: int = 42

    def ratios(self) -> list[float]:
        found = [float(x.split("/")[0]) / float(x.split("/")[1]) if "/" in x else float(x) for x in self.a.split(",")]
        if len(found) < 2 or abs(sum(found) - 1) > 1e-5:
            raise ValueError("two ratios or more that sum to one")
        return found

    def transform(self, df: DataFrame) -> DataFrame:
        u, part, total = uniform(self.seed, F.col(f"`{self.key}`")), F.lit(0), 0.0
        for ratio in self.ratios()[:-1]:
            total += ratio
            part = part + F.when(u >= total, 1).otherwise(0)
        return df.withColumn(self.col, part.cast("int"))

    def parts(self, df: DataFrame, paths: list[str] | None = None) -> list[DataFrame]:
        """The parts without the part column, each also written to its path if given."""
        marked = self.transform(df)
        out = [marked.where(F.col(self.col) == i).drop(self.col) for i in range(len(self.ratios()))]
        for part, path in zip(out, paths or [], strict=False):
            part.write.mode("overwrite").parquet(path)
        return out


@dataclass
class MultiToBinary(Transform):
    """Class expansion: rows (candidate class, is it the row's). Default: one for each class up to ``m``
    classes, else ``m`` seeded candidates; Reweight: copies of a row in inverse proportion to its
    class's frequency; Ranking: relevance 4 or 0 for true or false."""

    lab: str = "Label"
    name: str = "binaryLabel"
    al: str = "Default"
    m: int = 5
    s: int = 42
    key: str = ""
    w: str | None = None
    params: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> MultiToBinary:
        weight = F.sum(f"`{self.w}`") if self.w else F.count(F.lit(1)).cast("double")
        rows = df.where(F.col(f"`{self.lab}`").isNotNull()).groupBy(self.lab).agg(weight.alias("n")).orderBy(self.lab).collect()
        self.params = [(r[0], float(r[1])) for r in rows]  # one row a class
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self.lab].dataType
        classes = F.array(*(F.lit(c).cast(kind) for c, _ in self.params))
        label, key = F.col(f"`{self.lab}`"), F.col(f"`{self.key}`") if self.key else F.lit(0)
        if self.al == "Reweight":
            least = min((n for _, n in self.params), default=1.0)
            copies = F.lit(0.0)
            for c, n in self.params:
                copies = F.when(label == F.lit(c).cast(kind), F.lit(self.m * least / n)).otherwise(copies)
            whole = F.floor(copies).cast("int") + F.when(uniform(self.s, key) < copies - F.floor(copies), 1).otherwise(0)
            return df.withColumn(self.name, F.explode(F.array_repeat(F.lit(True), whole)))
        if len(self.params) > self.m:
            drawn = F.transform(F.sequence(F.lit(1), F.lit(self.m)), lambda i: F.element_at(classes, F.floor(uniform(self.s, key, i) * len(self.params)).cast("int") + 1))
            classes = drawn
        spread = df.withColumn(f"{self.name}_class", F.explode(classes))
        true = F.col(f"{self.name}_class") == label
        return spread.withColumn(self.name, F.when(true, 4).otherwise(0) if self.al == "Ranking" else true)


@dataclass
class SortRows(Transform):
    """Rows sorted by one column; ``r`` reverses."""

    col: str = ""
    r: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        column = F.col(f"`{self.col}`")
        return df.orderBy(column.desc() if self.r else column.asc())


@dataclass
class Cache(Transform):
    """Kept in memory and on disk, or as a Parquet file that is used again (``r``) if its schema fits."""

    f: str | None = None
    r: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        if self.f is None:
            return df.persist()
        if self.r:
            try:
                known = df.sparkSession.read.parquet(self.f)
                if known.dtypes == df.dtypes:
                    return known
            except Exception as error:  # no such file: it is written below
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        df.write.mode("overwrite").parquet(self.f)
        return df.sparkSession.read.schema(df.schema).parquet(self.f)


@dataclass
class PassThrough(Transform):
    """The rows as they are, written to ``f`` on the way if it is given."""

    f: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.f:
            df.write.mode("overwrite").parquet(self.f)
        return df


@dataclass
class Lambda(Transform):
    """``col`` (``New:a,b``) of Spark type ``kind``: a function over pandas Series of the old columns."""

    col: str = ""
    function: Callable | None = None
    kind: str = "double"

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        return frame.apply(df, new, self.function, old.split(","), self.kind)


@dataclass
class LambdaFilter(Transform):
    """Rows for which a function over pandas Series of the columns ``col`` (``a,b``) is true."""

    col: str = ""
    function: Callable | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return frame.filter_by(df, self.function, self.col.split(","))


@dataclass
class ValueMapper(Transform):
    """The rows that a function makes of each row, both as dictionaries, in the columns of ``schema``."""

    function: Callable | None = None
    schema: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        return frame.map_rows(df, self.function, self.schema)


@dataclass
class MissingFilter(Transform):
    """Rows without a missing cell (null or NaN, also inside vectors) in the columns ``col`` (``a,b``; none: all)."""

    col: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        whole = F.lit(True)
        for field in df.schema:
            if self.col and field.name not in self.col.split(","):
                continue
            x = F.col(f"`{field.name}`")
            whole = whole & x.isNotNull()
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                whole = whole & ~F.isnan(x)
            elif isinstance(field.dataType, T.ArrayType):
                real = isinstance(field.dataType.elementType, (T.FloatType, T.DoubleType))
                whole = whole & ~F.exists(x, lambda v: (v.isNull() | F.isnan(v)) if real else v.isNull())  # noqa: B023
        return df.where(F.coalesce(whole, F.lit(False)))


@dataclass
class DropColumns(Transform):
    """All columns but ``col`` (``a,b``)."""

    col: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.col.split(","))


@dataclass
class Concat(Transform):
    """Columns as one vector: ``F:a,b``."""

    col: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        new, _, old = self.col.partition(":")
        parts = [F.col(f"`{c}`") if _is_vector(df, c) else F.array(F.col(f"`{c}`").cast("float")) for c in old.split(",")]
        return df.withColumn(new, F.concat(*parts))


@dataclass
class KeyToLabel(Transform):
    """Kind conversion of columns ``new:kind:old`` (several by commas; ``new:old``: no kind of its own), ``type`` and ``key`` for those without.

    A kind may be a key, ``U4[0-9]`` or ``[0-9]``: the numbers of the range as codes from 1, others and missing ones 0;
    ``[0-*]`` has no end. What a column says goes before ``type``, its range before ``type``, that before ``key``; with none the kind is R4. A range without a kind
    keeps the kind of a column that is a key already, else is U4. The range stays in the column's metadata (``key``: min and count); a key
    becomes another one only of as many values.
    """

    col: str = ""
    type: str = ""
    key: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for text in self.col.split(","):
            new, *rest = text.split(":")
            own, old = (rest[0], rest[1]) if len(rest) > 1 else ("", (rest or [new])[0])
            own_kind, _, own_range = own.rstrip("]").partition("[")
            kind, span = (own_kind, own_range) if own_kind or own_range else (self.type, self.key)
            out = self._convert(out, df, new, old, kind, span)
        return out

    def _convert(self, out: DataFrame, df: DataFrame, new: str, old: str, kind: str, span: str) -> DataFrame:
        from ..functions.kinds import SPARK_TYPES

        source = df.schema[old]
        known = source.metadata.get("key") if source.metadata else None
        if not span:
            value = F.col(f"`{old}`").cast(SPARK_TYPES[kind or "R4"])
            return out.withColumn(new, value).withMetadata(new, {"kind": "U4"} if kind == "U4" else {})
        kind = kind or (kind_of(source) if known else "U4")
        low, _, high = span.partition("-")
        low, count = int(low), 0 if high == "*" else int(high) - int(low) + 1
        if count < 0 or kind not in ("I4", "U4", "I8"):
            raise ValueError(f"{kind}[{span}] is no key")
        number = F.col(f"`{old}`")
        if known:
            if known["count"] != count:
                raise ValueError(f"{old} is a key of {known['count']} values, not {count}")
            code = number
        else:
            whole = number.cast("double")
            inside = (whole >= low) & (whole == F.floor(whole)) & ((whole < low + count) if count else ~F.isnan(whole) & (whole < 2.0**31))
            code = F.when(inside, whole - (low - 1)).otherwise(0)
        return out.withColumn(new, F.coalesce(code, F.lit(0)).cast(SPARK_TYPES[kind])).withMetadata(new, {"kind": kind, "key": {"min": known["min"] if known else low, "count": count}})


@dataclass
class CodeToLabel(Transform):
    """A 1-based category code as a float label: 0 is NaN, x is x - 1."""

    col: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        new, old = _pair(self.col)
        return df.withColumn(new, key_to_label(F.col(f"`{old}`"), df.schema[old].dataType))


@dataclass
class Describe(Transform):
    """Rows pass as they are; the fit keeps (column, min, max, sum, sum2, nb) of ``col`` (a,b) in ``found`` and
    the counts of the values of ``hist`` (a,b) in ``counts``, each a frame. ``name`` marks the JSON report."""

    col: str = ""
    hist: str = ""
    name: str = "desc"
    found: DataFrame | None = field(default=None, repr=False)
    counts: dict = field(default_factory=dict, repr=False)

    def fit(self, df: DataFrame) -> Describe:
        self.found = moments(df, self.col.split(",")) if self.col else None
        self.counts = {c: histogram(df, c) for c in self.hist.split(",") if c}
        return self

    def as_json(self) -> DataFrame:
        """(json) of a fit: a text for each described column, and one for each value of a counted one.

        Both hold name and column; the first also min, max, sum, sum2 and nb, the second value and n. What is
        null (the value null, the minimum of no rows) is left out of its text. ValueError if nothing is described.
        """
        parts = [counts.select(F.lit(c).alias("column"), "value", "n") for c, counts in self.counts.items()]
        if self.found is not None:
            parts.insert(0, self.found)
        if not parts:
            raise ValueError("nothing is described")
        texts = [df.select(F.to_json(F.struct(F.lit(self.name).alias("name"), "*")).alias("json")) for df in parts]
        return functools.reduce(DataFrame.union, texts)

    def transform(self, df: DataFrame) -> DataFrame:
        return df


@dataclass
class ShakeInput(Transform):
    """For each listed slot and value a variant of the vector with that slot replaced, as a list of vectors.

    With ``score`` (a function of a vector column) the list of the variants' scores takes their place, or
    their sum (``how="add"``).
    """

    col: str = ""
    slots: tuple[int, ...] = ()
    values: tuple[tuple[float, ...], ...] = ()
    out: str = "variants"
    score: Callable[[Column], Column] | None = None
    how: str = "concat"

    def transform(self, df: DataFrame) -> DataFrame:
        v, item = F.col(f"`{self.col}`"), df.schema[self.col].dataType.elementType
        made = [F.transform(v, _replace(slot, value, item)) for slot, values in zip(self.slots, self.values, strict=True) for value in values]
        if self.score is None:
            return df.withColumn(self.out, F.array(*made))
        scores = [self.score(m) for m in made]
        return df.withColumn(self.out, F.array(*scores) if self.how == "concat" else sum(scores[1:], scores[0]))


def _replace(slot: int, value: float, item: T.DataType):
    return lambda x, i: F.when(i == slot, F.lit(value).cast(item)).otherwise(x)
