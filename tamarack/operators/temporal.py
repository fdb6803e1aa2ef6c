"""Joins by order: as-of, point in interval, overlap and band. No key and no range of values is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .frame import _keys

#: An interval meets at most this many bins and one more; longer ones go to bins wider by this factor.
FACTOR = 8
#: Wider bins than base * FACTOR ** LEVELS are one: what is longer (or endless) meets all points of its keys.
LEVELS = 24


def _free(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """``names``, each with ``_y`` while it is taken."""
    out: list[str] = []
    for name in names:
        while name in taken or name in out:
            name += "_y"
        out.append(name)
    return out


def as_of_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, left_by: str | Sequence[str] = (), right_by: str | Sequence[str] | None = None,
    direction: str = "backward", exact: bool = True, tolerance=None, how: str = "left",
) -> DataFrame:
    """Each left row with the right row of equal keys whose time is nearest before it (``forward``: after it).

    ``exact``: a right row of the same time counts. ``tolerance``: a number, or an interval for timestamps, beyond which
    a right row doesn't count. Of right rows with equal keys and times the greatest row counts, by its columns in order, so
    these must be orderable. ``how``: left, or inner, which drops left rows without a match. Null keys and times match nothing, on
    either side; repeated left rows each get their match; empty sides give none. Right names get ``_y`` while the left has them.

    Both sides are sorted together by (keys, time) over range partitions, which a hot key shares out by time;
    the last right row is carried through each partition by a window, and across borders by one row a
    partition: only a partition's first key can go on from an earlier one.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError(f"{direction}, {how}")
    lby = _keys(left_by)
    rby = lby if right_by is None else _keys(right_by)
    if len(lby) != len(rby):
        raise ValueError("both sides need as many keys")
    for x, y in zip([*lby, left_time], [*rby, right_time], strict=True):
        if left.schema[x].dataType != right.schema[y].dataType:
            raise TypeError(f"{x} and {y} can't be joined: {left.schema[x].dataType.simpleString()}, {right.schema[y].dataType.simpleString()}")
    k = [f"_k{i}" for i in range(len(lby))]
    shapes = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(left.schema)]), T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(right.schema)])

    def side(df: DataFrame, by: list[str], time: str, mine: int) -> DataFrame:
        row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
        rows = [row if j == mine else F.lit(None).cast(shape) for j, shape in enumerate(shapes)]
        return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(by, k, strict=True)), F.col(f"`{time}`").alias("_t"), F.lit(mine).alias("_side"), rows[0].alias("_l"), rows[1].alias("_r"))

    usable = F.col(f"`{right_time}`").isNotNull()
    for c in rby:
        usable = usable & F.col(f"`{c}`").isNotNull()
    both = side(left, lby, left_time, 0).unionByName(side(right.where(usable), rby, right_time, 1))
    ahead = direction == "backward"
    time = F.col("_t").asc_nulls_first() if ahead else F.col("_t").desc_nulls_last()
    first_side = F.col("_side").desc() if exact else F.col("_side").asc()  # at equal times right rows first, or last
    order = [time, first_side, F.col("_r").asc_nulls_first()]
    ordered = durable(both.repartitionByRange(*k, time, first_side, F.col("_r")).withColumn("_part", F.spark_partition_id()))
    # the last right row of each partition's first key ...
    keyed = F.struct(*k) if k else F.lit(0)
    firsts = ordered.groupBy("_part").agg(F.min(keyed).alias("_first"))  # one row a partition
    near = F.max if ahead else F.min
    latest = ordered.where("_side = 1").groupBy(keyed.alias("_key"), "_part", "_t").agg(F.max("_r").alias("_r")).groupBy("_key", "_part").agg(near(F.struct("_t", "_r")).alias("_last"))
    spans = latest.join(F.broadcast(firsts.select(F.col("_first").alias("_key")).distinct()), "_key", "leftsemi")
    # ... goes on into those behind it
    opened = firsts.select("_part", F.col("_first").alias("_key"), F.lit(1).alias("_open"), F.lit(None).cast(latest.schema["_last"].dataType).alias("_last"))
    closed = spans.select("_part", "_key", F.lit(2).alias("_open"), "_last")
    running = Window.partitionBy("_key").orderBy("_part", "_open").rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.unionByName(closed).withColumn("_carry", F.last("_last", ignorenulls=True).over(running)).where("_open = 1 and _carry is not null").select("_part", F.col("_key"), F.col("_carry")["_r"].alias("_carry"))
    inside = Window.partitionBy("_part", *k).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ordered.withColumn("_r", F.last("_r", ignorenulls=True).over(inside)).where("_side = 0").withColumn("_key", keyed)
    met = filled.join(F.broadcast(carried), ["_part", "_key"], "left").withColumn("_r", F.coalesce("_r", "_carry"))
    good = F.col("_t").isNotNull()
    if tolerance is not None:
        then = F.col("_r")[f"c{right.columns.index(right_time)}"]
        low, high = (then, F.col("_t")) if ahead else (F.col("_t"), then)
        good = good & (high <= low + (F.lit(tolerance) if not isinstance(tolerance, (str, Column)) else F.expr(f"interval {tolerance}") if isinstance(tolerance, str) else tolerance))
    met = met.withColumn("_r", F.when(good, F.col("_r")))
    if how == "inner":
        met = met.where("_r is not null")
    names = _free(right.columns, left.columns)
    return met.select(*(F.col("_l")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)), *(F.col("_r")[f"c{i}"].alias(c) for i, c in enumerate(names)))


# --- intervals -------------------------------------------------------------------------------


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order: only bins are made of it."""
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        value = value.cast("timestamp")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value).cast("double")
    return F.unix_date(value).cast("double") if isinstance(kind, T.DateType) else value.cast("double")


def range_join(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, points_by: str | Sequence[str] = (), intervals_by: str | Sequence[str] | None = None,
    closed: str = "both", base: float | None = None,
) -> DataFrame:
    """All pairs of a point and an interval of equal keys that holds it: low <= point <= high.

    ``closed``: both, low (point < high), high (low < point) or neither. Ends and points have one type: a number, date or timestamp.
    Nulls and NaN match nothing, an interval whose low end is above its high one holds nothing, infinite ends are allowed;
    repeated rows each count; an empty side gives no rows. Interval names get ``_y`` while the points have them.

    An interval lies in a few bins of a width near its length; widths grow by FACTOR from ``base`` (none: a tenth of the intervals are
    shorter, by an approximate quantile). A point lies in one bin of each width that is in use. Both meet by an equi-join on
    (keys, width, bin), so Spark's skew split applies, and are then compared themselves. Work follows points
    times widths plus the pairs that share a bin.
    """
    if closed not in ("both", "low", "high", "neither"):
        raise ValueError(closed)
    pby = _keys(points_by)
    iby = pby if intervals_by is None else _keys(intervals_by)
    if len(pby) != len(iby):
        raise ValueError("both sides need as many keys")
    if not points.schema[point].dataType == intervals.schema[low].dataType == intervals.schema[high].dataType:
        raise TypeError("points and ends have different types")
    k = [f"_k{i}" for i in range(len(pby))]
    a, b = _number(intervals, low), _number(intervals, high)
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(intervals.columns)))
    spans = intervals.where(F.col(f"`{low}`") <= F.col(f"`{high}`")).select(*(F.col(f"`{c}`").alias(n) for c, n in zip(iby, k, strict=True)), a.alias("_a"), b.alias("_b"), F.col(f"`{low}`").alias("_low"), F.col(f"`{high}`").alias("_high"), row.alias("_i"))
    spans = spans.where(~F.isnan("_a") & ~F.isnan("_b"))
    length = F.col("_b") - F.col("_a")
    if base is None:
        some = spans.where((length > 0) & (length < F.lit(float("inf")))).agg(F.percentile_approx(length, 0.1, 1000)).first()[0]
        base = some or 1.0
    level = F.when(length <= base, F.lit(0)).otherwise(F.least(F.ceil(F.log(float(FACTOR), length / base)), F.lit(LEVELS))).cast("int")
    spans = spans.withColumn("_level", F.when(length < F.lit(float("inf")), level).otherwise(F.lit(LEVELS)))

    def bin_of(value: Column, level: Column) -> Column:
        # the widest bin is the only one of its width; farther places than a long can count share its last bins
        place = F.floor(value / (F.lit(float(base)) * F.pow(F.lit(float(FACTOR)), level)))
        return F.when(level == LEVELS, F.lit(0).cast("long")).otherwise(place.cast("long"))

    # beside values that are huge against ``base`` a level's bins can't be told apart: they go one wider until they can
    far = F.greatest(F.abs("_a"), F.abs("_b")) / F.lit(float(base) * float(1 << 52))
    lifted = F.when(far > 1, F.ceil(F.log(float(FACTOR), far))).otherwise(F.lit(0))
    spans = spans.withColumn("_level", F.least(F.greatest("_level", lifted), F.lit(LEVELS)).cast("int"))
    used = [r[0] for r in spans.select("_level").distinct().orderBy("_level").collect()]  # at most LEVELS + 1
    binned = spans.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_a"), F.col("_level")), bin_of(F.col("_b"), F.col("_level")))))
    x = _number(points, point)
    held = points.where(F.col(f"`{point}`").isNotNull() & ~F.isnan(x)).withColumns({n: F.col(f"`{c}`") for c, n in zip(pby, k, strict=True)}).withColumns({"_x": x, "_level": F.explode(F.array(*(F.lit(v) for v in used)) if used else F.array().cast("array<int>"))})
    held = held.where((F.col("_level") == LEVELS) | (F.abs("_x") < F.lit(float(base) * float(1 << 55)) * F.pow(F.lit(float(FACTOR)), F.col("_level"))))
    held = held.withColumn("_bin", bin_of(F.col("_x"), F.col("_level")))
    met = held.join(binned, [*k, "_level", "_bin"])
    p = F.col(f"`{point}`")
    after = F.col("_low") <= p if closed in ("both", "low") else F.col("_low") < p
    before = p <= F.col("_high") if closed in ("both", "high") else p < F.col("_high")
    names = _free(intervals.columns, points.columns)
    return met.where(after & before).select(*(F.col(f"`{c}`") for c in points.columns), *(F.col("_i")[f"c{i}"].alias(c) for i, c in enumerate(names)))


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, by: str | Sequence[str] = (), right_low: str | None = None, right_high: str | None = None, right_by: str | Sequence[str] | None = None) -> DataFrame:
    """All pairs of closed intervals of equal keys that share a value: one's low end lies in the other.

    Two range joins that no pair passes both of; nulls and empty or repeated rows as there; an interval whose low end is above its high one shares nothing.
    """
    rl, rh = right_low or low, right_high or high
    rby = by if right_by is None else right_by
    names = _free(right.columns, left.columns)
    sound = left.where(F.col(f"`{low}`") <= F.col(f"`{high}`"))
    mine = right.where(F.col(f"`{rl}`") <= F.col(f"`{rh}`"))
    first = range_join(sound, mine, low, rl, rh, by, rby)
    other = _free(left.columns, right.columns)
    second = range_join(mine, sound, rl, low, high, rby, by, closed="high")
    n = len(right.columns)
    back = second.toDF(*(f"r{i}" for i in range(n)), *(f"l{i}" for i in range(len(other))))
    turned = back.select(*(F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"r{i}").alias(c) for i, c in enumerate(names)))
    return first.union(turned)


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, by: str | Sequence[str] = (), right_by: str | Sequence[str] | None = None) -> DataFrame:
    """All pairs of equal keys whose numbers differ by at most ``width``: low <= left <= high around the right number, in doubles."""
    number = F.col(f"`{right_value}`").cast("double")
    around = right.withColumns({"_from": number - width, "_to": number + width})
    points = left.withColumn("_at", F.col(f"`{left_value}`").cast("double"))
    return range_join(points, around, "_at", "_from", "_to", by, right_by, base=max(2 * width, 1e-300)).drop("_at", "_from", "_to")
