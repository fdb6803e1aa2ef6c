"""Nearest neighbours and density clustering as fit-then-apply transforms over a vector column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clusters, neighbors
from .frame import running_sums
from .transforms import Transform

#: Pairs drawn to estimate a radius, and the quantile of their distances that is taken.
PAIRS, QUANTILE = 10_000, 0.05


@dataclass
class NearestNeighbors(Transform):
    """Distances (``dist``, ascending) and ids (``idn``) of each row's ``k`` nearest rows of the fit."""

    k: int = 5
    d: str = "L2"
    col: str = "Features"
    id: str = "id"
    dist: str = "Distances"
    idn: str = "idNeighbors"
    items: DataFrame | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> NearestNeighbors:
        self.items = df.select(self.id, self.col)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return neighbors.append_neighbors(df, self.k, self.d, self.id, self.col, self.items, self.dist, self.idn)


def estimate_radius(df: DataFrame, id_col: str, vector: str, seed: int = 42) -> float:
    """The 5 % quantile of the distances of at most PAIRS seeded pairs of rows."""
    sides = []
    for side in ("a", "b"):  # bounded: PAIRS rows a side
        drawn = df.select(F.xxhash64(F.lit(f"{seed}{side}"), id_col).alias("h"), F.col(vector).alias(side)).orderBy("h").limit(PAIRS)
        sides.append(drawn.select(F.row_number().over(Window.orderBy("h")).alias("n"), side))
    found = sides[0].join(sides[1], "n").select(neighbors.distance(F.col("a"), F.col("b")).alias("d")).where("d > 0")
    return found.agg(F.percentile("d", F.lit(QUANTILE))).first()[0] or 1.0


def _slots(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, list[str]]:
    n = df.agg(F.max(F.size(vector))).first()[0] or 0
    names = [f"x{i}" for i in range(n)]
    return df.select(id_col, *(F.col(vector)[i].cast("double").alias(c) for i, c in enumerate(names))), names


@dataclass
class DBScan(Transform):
    """Cluster numbers (from 1; noise -1) and scores; a radius of 0 is estimated from drawn pairs."""

    col: str = "Features"
    eps: float = 0.0
    mps: int = 5
    id: str = "id"
    outc: str = "ClusterId"
    outs: str = "Score"
    s: int = 42

    def transform(self, df: DataFrame) -> DataFrame:
        points, names = _slots(df, self.id, self.col)
        eps = self.eps if self.eps > 0 else estimate_radius(df, self.id, self.col, self.s)
        found = clusters.dbscan(points, eps, self.mps, self.id, names)
        return df.join(found.select(F.col("id").alias(self.id), F.col("cluster").alias(self.outc), F.col("score").alias(self.outs)), self.id)


@dataclass
class OpticsOrder(Transform):
    """Place in the density order, reachability and core distance; undefined distances are infinite."""

    col: str = "Features"
    eps: float = 1.0
    mps: int = 5
    id: str = "id"

    def transform(self, df: DataFrame) -> DataFrame:
        points, names = _slots(df, self.id, self.col)
        found = neighbors.optics(points, self.eps, self.mps, self.id, names)
        return df.join(found.select(F.col("id").alias(self.id), F.col("place").alias("Order"), F.col("reachability").alias("Reachability"), F.col("core").alias("CoreDistance")), self.id)


@dataclass
class Optics(Transform):
    """A cluster and a score column for each radius of ``eps`` (``0.2,0.5``), cut from one order at the largest.

    A row that is not reached within the radius starts a cluster if it is a core point there, else it is
    noise (-1, score 0); the rows after it belong to its cluster until the next such row.
    """

    col: str = "Features"
    eps: str = "1.0"
    mps: int = 5
    id: str = "id"
    outc: str = "ClusterId"
    outs: str = "Score"

    def transform(self, df: DataFrame) -> DataFrame:
        radii = [float(e) for e in self.eps.split(",")]
        points, names = _slots(df, self.id, self.col)
        found = neighbors.optics(points, max(radii), self.mps, self.id, names)
        out = {e: "" if len(radii) == 1 else f"_{i}" for i, e in enumerate(radii)}
        starts = {self.outc + n: F.when((F.col("reachability") > e) & (F.col("core") <= e), 1).otherwise(0) for e, n in out.items()}
        found = running_sums(found, "place", starts)
        for e, n in out.items():
            noise = (F.col("reachability") > e) & (F.col("core") > e)
            found = found.withColumns({self.outc + n: F.when(noise, -1).otherwise(F.col(self.outc + n).cast("int")), self.outs + n: F.when(noise, 0.0).otherwise(1.0)})
        made = [c for c in found.columns if c not in ("group", "id", "place", "reachability", "core")]
        return df.join(found.select(F.col("id").alias(self.id), *made), self.id)
