"""Density clustering by cells: links are between cells, and no pairs of points are stored."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .frame import with_index
from .neighbors import components

#: Points of a cell that meet others under one join key, about; a fuller cell is split by its points' hashes.
PART = 1024
#: Cells a slot that still tell points apart exactly.
WIDEST = float(1 << 40)


def _square(a: list[Column], b: list[Column]) -> Column:
    return reduce(add, ((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def _beyond(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """How far two intervals are apart; 0 where they meet."""
    return F.greatest(other_low - high, low - other_high, F.lit(0.0))


def _parts(n: Column) -> Column:
    return F.ceil(n / PART)


def _near_cells(cells: DataFrame, eps: float, slots: int, width: int) -> DataFrame:
    """(cell, n, other, other_n): cells whose boxes come within ``eps`` of each other, each with itself.

    They meet by a join on coarse cells over the first three slots at most, ``width`` cells each way, and those around.
    """
    coarse = [f"c{i}" for i in range(min(3, slots))]
    placed = cells.withColumns({c: F.floor(F.col("cell")[i] / width) for i, c in enumerate(coarse)})
    around = placed
    for c in coarse:
        around = around.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    others = placed.select(*coarse, F.col("cell").alias("other"), F.col("n").alias("other_n"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    gaps = [_beyond(F.col("low")[i], F.col("high")[i], F.col("other_low")[i], F.col("other_high")[i]) for i in range(slots)]
    met = around.join(others, coarse).where(reduce(add, (g * g for g in gaps)) <= eps * eps * (1 + 1e-9))
    return met.select("cell", "n", "other", "other_n")


def _pairs(left: DataFrame, near: DataFrame, right: DataFrame, eps: float, xs: list[str]) -> DataFrame:
    """Rows of ``left`` (cell, coordinates) with those of ``right`` within ``eps`` in the cells that ``near`` (cell, other, parts) names.

    ``right`` has ``part`` besides: a full cell's points stand under several join keys.
    """
    ys = [f"y{x}" for x in xs]
    probes = left.join(near, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    other = right.withColumnsRenamed({"cell": "other"} | dict(zip(xs, ys, strict=True)))
    return probes.join(other, ["other", "part"]).where(_square([F.col(x) for x in xs], [F.col(y) for y in ys]) <= eps * eps)


def _linked(core: DataFrame, near: DataFrame, eps: float, xs: list[str]) -> DataFrame:
    """(cell, root, n): the cells of core points, the least core id of their cluster, and how many core points they hold.

    Core points of one cell are within ``eps`` of each other, so cells link, not points. Points at the ends of the slots decide most
    links; what they leave apart is compared whole, but for cells that other links already put together.
    """
    at = F.array(*xs)
    ends = [f(at, F.col(x)) for x in xs[:3] for f in (F.min_by, F.max_by)]
    boxes = [F.array(*(f(x) for x in xs)).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    cells = durable(core.groupBy("cell").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends"), *boxes))
    others = cells.select(F.col("cell").alias("other"), F.col("a").alias("b"), F.col("n").alias("other_n"), F.col("ends").alias("other_ends"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    slots = range(len(xs))
    touch = F.exists("ends", lambda p: F.exists("other_ends", lambda q: _square([p[i] for i in slots], [q[i] for i in slots]) <= eps * eps))
    met = near.select("cell", "other").join(cells, "cell").join(others, "other")
    met = durable(met.select("cell", "other", "a", "b", "other_n", "other_low", "other_high", ((F.col("a") == F.col("b")) | touch).alias("touch")))
    roots = components(met.where("touch").select("a", "b"))
    other_roots = roots.select(F.col("a").alias("b"), F.col("root").alias("other_root"))
    apart = durable(met.where("not touch and a < b").join(roots, "a").join(other_roots, "b").where("root <> other_root"))
    if not apart.isEmpty():
        gaps = [_beyond(F.col(x), F.col(x), F.col("other_low")[i], F.col("other_high")[i]) for i, x in enumerate(xs)]
        facing = reduce(add, (g * g for g in gaps)) <= eps * eps * (1 + 1e-9)  # no other point can be within eps of the other cell's
        wanted = apart.select("cell", "other", "root", "other_root", "other_low", "other_high", _parts(F.col("other_n")).alias("parts"))
        parted = core.join(cells.select("cell", "n"), "cell").select("cell", *xs, F.pmod(F.xxhash64("id"), _parts(F.col("n"))).alias("part"))
        facing_points = core.join(wanted, "cell").where(facing).withColumn("cell", F.struct("cell", "other")).select("cell", *xs)
        keys = wanted.select(F.struct("cell", "other").alias("cell"), "other", "root", "other_root", "parts")
        more = _pairs(facing_points, keys, parted, eps, xs).select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct()
        more = durable(more)
        own = roots.select("root").distinct().select(F.col("root").alias("a"), F.col("root").alias("b"))
        higher = components(more.unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own))
        roots = roots.join(higher.select(F.col("a").alias("root"), F.col("root").alias("far")), "root").select("a", F.col("far").alias("root"))
    return cells.join(roots, "a").select("cell", "root", "n")


def dbscan(df: DataFrame, eps: float, mps: int, id_col: str, columns: list[str]) -> DataFrame:
    """(id, cluster, score): density clusters, named by the order of their least core point, from 1; noise is -1.

    A core point has ``mps`` points or more within ``eps``, itself included; a border point joins the
    cluster of least number that reaches it; a cluster of fewer than ``mps`` points is noise. score: 1 in
    a cluster, 0 for noise. Ids are distinct; a point with a missing or non-finite coordinate is noise; an empty table gives no
    rows. Points are placed in cells that ``eps`` spans: a cell of ``mps`` points holds core points only, so just the points of emptier
    cells are counted one by one, and all core points of a cell are of one cluster. Coordinates of over 2^40 cells are an error.
    """
    if not eps > 0:
        raise ValueError(f"eps={eps}")
    xs, slots = [f"x{i}" for i in range(len(columns))], len(columns)
    side = eps / math.sqrt(slots) * (1 - 1e-3)  # less than eps from corner to corner, rounding included
    every = df.select(F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, xs, strict=True)))
    finite = reduce(lambda a, b: a & b, (F.abs(x) < float("inf") for x in xs))
    slot = lambda x: F.when(F.abs(F.col(x) / side) < WIDEST, F.floor(F.col(x) / side)).otherwise(F.raise_error(F.lit(f"a coordinate of over 2^40 cells of {side}")).cast("long"))
    points = every.where(finite).withColumn("cell", F.array(*(slot(x) for x in xs)))
    boxes = [F.array(*(f(x) for x in xs)).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    cells = durable(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *boxes))
    near = durable(_near_cells(cells, eps, slots, math.floor(math.sqrt(slots) / (1 - 1e-3)) + 1))
    placed = durable(points.join(cells.select("cell", "n"), "cell"))
    parted = placed.select("cell", *xs, F.pmod(F.xxhash64("id"), _parts(F.col("n"))).alias("part"))
    few = placed.where(F.col("n") < mps).select("id", "cell", *xs)
    around = near.where(F.col("n") < mps).select("cell", "other", _parts(F.col("other_n")).alias("parts"))
    full = _pairs(few, around, parted, eps, xs).groupBy("id").count().where(F.col("count") >= mps)
    core = durable(placed.where(F.col("n") >= mps).select("id", "cell", *xs).unionByName(few.join(full, "id", "left_semi")))
    linked = durable(_linked(core, near, eps, xs))
    known = core.join(linked, "cell")
    inner = known.select("id", "root")
    cored = linked.select(F.col("cell").alias("other"), _parts(F.col("n")).alias("parts"))
    ends = known.select("cell", "root", *xs, F.pmod(F.xxhash64("id"), _parts(F.col("n"))).alias("part"))
    edge = few.join(core.select("id"), "id", "left_anti")
    border = _pairs(edge, around.drop("parts").join(cored, "other"), ends, eps, xs).groupBy("id").agg(F.min("root").alias("root"))
    reached = durable(inner.unionByName(border))
    sizes = reached.groupBy("root").count().where(F.col("count") >= mps)
    ranks = with_index(sizes.select("root"), "root", "place").select("root", (F.col("place") + 1).alias("cluster"))
    named = reached.join(ranks, "root").select("id", "cluster")
    found = every.select("id").join(named, "id", "left")
    return found.select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"), F.when(F.col("cluster").isNotNull(), 1.0).otherwise(0.0).alias("score"))
