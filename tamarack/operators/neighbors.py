"""Nearest neighbours in blocks, and density orders.

Vectors are packed into blocks of bounded size around pivots and stored once. Blocks that can hold something near meet by a cartesian
product of few large parts, which moves no vector through a shuffle; a task compares a block of queries with all blocks of its part as
matrices and hands on only each query's best few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .frame import with_index
from .ordering import density_order

#: Vectors of a block at most (about), and at least where fewer blocks would leave cores idle.
BLOCK, LEAST_BLOCK = 2048, 128
#: Pivots at most, and rows that they are chosen from.
PIVOTS, SAMPLE = 256, 2048
#: Bytes of items' blocks that a task holds at most (about), rows that are compared at once, and pairs that are measured at once.
PART_BYTES, STRIP, EXACT = 64 << 20, 256, 1 << 16
#: Levels of a coordinate where L1 distances are first estimated in bytes: four differences are summed in one.
LEVELS = 63


def distance(a: Column, b: Column, metric: str = "L2") -> Column:
    """The distance of two vector columns: L2, L1 or cosine (1 - cos; 1 - dot where a norm is zero)."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    if metric == "L1":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))
    if metric == "L2":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when(norms > 0, 1 - dot / norms).otherwise(1 - dot)


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "L1":
        return np.stack([np.abs(y - row).sum(1) for row in x])
    if metric == "L2":
        return np.stack([np.sqrt(((y - row) ** 2).sum(1)) for row in x])
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    dot = x @ y.T
    return np.where(norms > 0, 1 - dot / np.where(norms > 0, norms, 1), 1 - dot)


def _pairwise(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of ``x`` to the same row of ``y``, with ``_distances``' arithmetic."""
    if metric == "L1":
        return np.abs(y - x).sum(1)
    if metric == "L2":
        return np.sqrt(((y - x) ** 2).sum(1))
    norms, dot = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), np.einsum("ij,ij->i", x, y)
    return np.where(norms > 0, 1 - dot / np.where(norms > 0, norms, 1), 1 - dot)


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a flattened mask is true; eight cells are looked at at once."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    return (eights[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[eights]]


class _Near:
    """Which pairs of rows of two blocks may be within a bound: distances estimated with a bounded error, so that none is lost.

    L2 (its square) and cosine are estimated by products of matrices of 32-bit reals around the mean of ``x``; L1 by sums of differences of
    rounded coordinates in bytes. Every pair that passes is then measured in doubles. What isn't finite always passes.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str):
        self.x, self.y, self.metric = x, y, metric
        slots, norm = x.shape[1], lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
        with np.errstate(all="ignore"):
            if metric == "L1":
                low = np.minimum(x.min(0), y.min(0))
                self.scale = float((np.maximum(x.max(0), y.max(0)) - low).max(initial=0.0)) / LEVELS or 1.0
                if not np.isfinite(self.scale) or not np.isfinite(low).all():
                    self.scale = np.nan
                    return
                levels = [np.rint((v - low) / self.scale).clip(0, LEVELS) for v in (x, y)]
                ex, ey = (np.abs(v - low - n * self.scale).sum(1) for v, n in zip((x, y), levels))
                self.error = (ex + ey.max()) * (1 + 1e-9) + 1e-12 * slots * (np.abs(x).max() + np.abs(y).max())
                self.a, self.b = (np.ascontiguousarray(n.T.astype(np.int8)) for n in levels)
                return
            self.scale = 1.0
            if metric == "L2":
                mean = x.mean(0)
                u, w = x - mean, y - mean
                nu, nw = norm(u), norm(w)
                reach = nu.max() + nw.max()
                far = norm(x).max() + norm(y).max()
                self.error = np.full(len(x), (slots + 16) * 2.0**-23 * reach**2 + 1e-14 * far * reach + (1e-14 * far) ** 2 + 1e-36)
                self.a = np.column_stack([-2 * u, nu**2, np.ones(len(x))]).astype(np.float32)
                self.b = np.column_stack([w, np.ones(len(y)), nw**2]).astype(np.float32).T
            else:
                u, w = _points(x, metric), _points(y, metric)
                self.error = np.full(len(x), (slots + 16) * 2.0**-22)
                self.a = np.column_stack([-u, np.ones(len(x))]).astype(np.float32)
                self.b = np.column_stack([w, np.ones(len(y))]).astype(np.float32).T
            if not (self.error.max() < 1e30 and np.isfinite(self.a).all() and np.isfinite(self.b).all()):
                self.scale = np.nan

    def _estimate(self, first: int, last: int) -> np.ndarray:
        if self.metric != "L1":
            return self.a[first:last] @ self.b
        shape, slots = (last - first, len(self.y)), len(self.a)
        total = np.zeros(shape, np.uint16 if slots * LEVELS < 1 << 16 else np.uint32)
        gap, four = np.empty(shape, np.int8), np.empty(shape, np.uint8)
        for slot in range(0, slots, 4):
            four[:] = 0
            for j in range(slot, min(slot + 4, slots)):
                np.subtract(self.a[j, first:last, None], self.b[j, None], out=gap)
                np.abs(gap, out=gap)
                np.add(four, gap.view(np.uint8), out=four)
            total += four
        return total

    def within(self, bound: np.ndarray, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of x, rows of y, distances) by strips of x: all pairs within each row's ``bound``, or among its ``k`` nearest of y, and others."""
        for first in range(0, len(self.x), STRIP):
            last = min(first + STRIP, len(self.x))
            if np.isnan(self.scale):
                a, b = (v.ravel() for v in np.indices((last - first, len(self.y))))
            else:
                m, error = self._estimate(first, last), self.error[first:last]
                most = bound[first:last] ** 2 * (1 + 1e-12) if self.metric == "L2" else bound[first:last] * (1 + 1e-12) + 1e-12
                if 0 < k <= len(self.y):
                    most = np.minimum(most, np.partition(m, k - 1, axis=1)[:, k - 1] * self.scale + error)
                limit = (most + error) / self.scale
                if self.metric == "L1":
                    limit = np.minimum(limit, np.iinfo(m.dtype).max).astype(m.dtype)  # whole numbers: the part after the point decides nothing
                else:
                    limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
                a, b = np.divmod(_places(m <= limit[:, None]), len(self.y))
            a = a + first
            d = [_pairwise(self.x[a[i : i + EXACT]], self.y[b[i : i + EXACT]], self.metric) for i in range(0, len(a), EXACT)]
            yield a, b, np.concatenate(d) if d else np.zeros(0)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key of queries' block, its ids, its vectors, items' ids, their vectors) of each pair of blocks."""
    numbers = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
    for batch in batches:
        q_ids, q, i_ids, y = (batch.column(c) for c in ("q_ids", "q_vectors", "i_ids", "i_vectors"))
        for n, key in enumerate(zip(batch.column("q_pivot").to_pylist(), batch.column("q_block").to_pylist())):
            a, b = numbers(q_ids, n), numbers(i_ids, n)
            yield key, a, numbers(q, n).astype(float).reshape(len(a), -1), b, numbers(y, n).astype(float).reshape(len(b), -1)


def _packed_lists(side: str) -> list[Column]:
    """The ids of a block, and all its vectors in one list."""
    both = F.collect_list(F.struct("id", "v"))
    return [F.transform(both, lambda r: r["id"]).alias(f"{side}_ids"), F.flatten(F.transform(both, lambda r: r["v"])).alias(f"{side}_vectors")]


def _blocks(df: DataFrame, id_col: str, vector: str, side: str, count: int) -> DataFrame:
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(count)).alias(f"{side}_block"))
    return slim.groupBy(f"{side}_block").agg(*_packed_lists(side))


def knn(queries: DataFrame, items: DataFrame, k: int = 5, metric: str = "L2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, rank, neighbor, distance): the ``k`` nearest items of each query, exact, ties by the smaller id.

    What fills more than one block is grouped by pivots: a block first meets the blocks nearest to it, and then only those that the
    triangle inequality doesn't rule out at the distance found. Less is compared at once. Null vectors are left out.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    same = queries is items
    queries = queries.where(F.col(vector).isNotNull())
    items = queries if same else items.where(F.col(vector).isNotNull())
    n_items, n_queries = items.count(), queries.count()
    if n_items > BLOCK:
        return _pruned_knn(queries, items, n_items, k, metric, id_col, vector)
    nq = max(1, -(-n_queries // BLOCK))
    ni = max(1, min(-(-cores // nq), n_items // LEAST_BLOCK))  # queries are copied only while cores would be idle
    left = _blocks(queries, id_col, vector, "q", nq).withColumn("i_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ni - 1).cast("long"))))
    # a stated number of partitions: small blocks are much work, and must not be put together by their size
    pairs = left.withColumn("q_pivot", F.lit(0)).repartition(min(4 * cores, nq * ni), "i_block", "q_block").join(_blocks(items, id_col, vector, "i", ni), "i_block")
    return _best(pairs.mapInArrow(_nearest(k, metric), "q_pivot int, q_block long, id long, neighbor long, distance double"), k)


# --- pruned search: only blocks that can hold something near meet -----------------------------


def _points(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose L2 (for L1: L1) distances bound those of the metric from below: for cosine those of length 1."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _radius(distance: np.ndarray, metric: str) -> np.ndarray:
    """The distance of ``_points`` within which all that is so near by the metric lies: 1 - cos is half its square, at least."""
    return np.sqrt(2 * np.maximum(distance, 0)) if metric == "cosine" else distance


def _pivots(items: DataFrame, id_col: str, vector: str, metric: str, n: int) -> np.ndarray:
    """At most PIVOTS vectors far from each other, by farthest-first choice among at most SAMPLE rows of least hash.

    They only decide which vectors share a block, never a result.
    """
    rows = items.orderBy(F.xxhash64(id_col), id_col).select(F.col(vector).cast("array<double>")).limit(SAMPLE).collect()
    x = _points(np.array([r[0] for r in rows], float), metric)
    plain = "L1" if metric == "L1" else "L2"
    chosen, far = [0], _distances(x[:1], x, plain)[0]
    while len(chosen) < min(PIVOTS, max(1, 2 * n // BLOCK)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x[chosen[-1:]], x, plain)[0])
    return x[chosen]


@dataclass
class _Placed:
    """Blocks by pivot: ``packed`` (pivot, block, ids, vectors, r), ``counts`` and ``blocks`` by pivot, ``reach`` the largest r by pivot, ``parts`` of bounded bytes."""

    packed: DataFrame
    counts: np.ndarray
    blocks: np.ndarray
    reach: np.ndarray
    parts: int


def _placed(df: DataFrame, id_col: str, vector: str, metric: str, pivots: np.ndarray) -> _Placed:
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    plain = "L1" if metric == "L1" else "L2"
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), BLOCK):
                part = frame.iloc[first : first + BLOCK]
                d = _distances(_points(np.stack(part["v"].to_numpy()).astype(float), metric), shared.value, plain)
                at = d.argmin(axis=1)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "pivot": at, "r": d[np.arange(len(at)), at]})

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("id is not null")
    rows = slim.mapInPandas(assign, f"id long, v array<{kind}>, pivot int, r double")
    sizes = np.zeros(len(pivots), int)  # they only decide in how many blocks a pivot's rows are packed
    for p, n in rows.groupBy("pivot").agg(F.count(F.lit(1))).collect():  # one row a pivot
        sizes[p] = n
    blocks = -(-sizes // BLOCK)
    per = F.element_at(F.array(*(F.lit(int(max(1, b))) for b in blocks)), F.col("pivot") + 1)
    # a stated number of partitions: small blocks are much work, and must not be put together by their size
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = rows.withColumn("block", F.pmod(F.xxhash64("id"), per).cast("int")).repartition(max(1, min(8 * cores, int(blocks.sum()))), "pivot", "block")
    packed = durable(spread.groupBy("pivot", "block").agg(*_packed_lists("all"), F.max("r").alias("r")).toDF("pivot", "block", "ids", "vectors", "r"))
    counts, reach = np.zeros(len(pivots), int), np.zeros(len(pivots))
    for p, n, r in packed.groupBy("pivot").agg(F.sum(F.size("ids")), F.max("r")).collect():  # one row a pivot
        counts[p], reach[p] = n, r
    width = 8 + pivots.shape[1] * (4 if kind == "float" else 8)
    return _Placed(packed, counts, blocks, reach, max(1, -(-int(counts.sum()) * width // PART_BYTES)))


def _packed(placed: _Placed, side: str) -> DataFrame:
    named = placed.packed.toDF(*(f"{side}_{c}" for c in placed.packed.columns))
    return named.coalesce(placed.parts) if side == "i" else named


def _met(queries: DataFrame, items: DataFrame, wanted: DataFrame, results: Callable, schema: str) -> DataFrame:
    """``results`` of each pair of blocks in ``wanted`` (q_pivot, q_block, i_pivot, i_block), which has all blocks of an items' pivot or none.

    Each partition of queries reads each of the items: neither is shuffled, whatever the number of pairs. The lists of pivots that are
    broadcast hold at most PIVOTS numbers for each block of queries.
    """
    lists = wanted.groupBy("q_pivot", "q_block").agg(F.collect_set("i_pivot").alias("_wanted"))
    left = queries.join(F.broadcast(lists), ["q_pivot", "q_block"])
    pairs = left.join(items.hint("shuffle_replicate_nl"), F.array_contains("_wanted", F.col("i_pivot")))
    return pairs.select("q_pivot", "q_block", "q_ids", "q_vectors", "i_ids", "i_vectors").mapInArrow(results, schema)


def _near_blocks(stats: DataFrame, pivots: np.ndarray, items: _Placed, metric: str, skip: list[set[int]] | None = None) -> DataFrame:
    """The pairs of blocks (q_pivot, q_block, r, bound) and items' blocks whose distance may be within the bound.

    By the triangle inequality no pair of their vectors is nearer than the pivots' distance less both radii.
    """
    plain = "L1" if metric == "L1" else "L2"
    between = _distances(pivots, pivots, plain)
    counts, blocks, reach = items.counts, items.blocks, items.reach

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                least = between[row.q_pivot] - row.r - reach
                near = (counts > 0) & (least * (1 - 1e-9) - 1e-9 <= _radius(np.float64(row.bound), metric))
                for p in np.flatnonzero(near).tolist():
                    if skip is None or p not in skip[row.q_pivot]:
                        out += [(row.q_pivot, row.q_block, p, b) for b in range(blocks[p])]
            yield pd.DataFrame(out, columns=["q_pivot", "q_block", "i_pivot", "i_block"])

    return durable(stats.mapInPandas(pairs, "q_pivot int, q_block int, i_pivot int, i_block int"))


def _nearest(k: int, metric: str) -> Callable:
    """Each query's ``k`` nearest items, ties by the smaller id, among the items' blocks that follow one another with the query's block."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, d, near = None, None, np.zeros((0, 0)), np.zeros((0, 0), int)

        def found() -> pa.RecordBatch:
            pivot, block = key
            whose = {"q_pivot": np.full(near.size, pivot, np.int32), "q_block": np.full(near.size, block, np.int64), "id": np.repeat(ids, near.shape[1])}
            return pa.RecordBatch.from_pydict(whose | {"neighbor": near.ravel(), "distance": d.ravel()})

        for at, q_ids, x, i_ids, y in _block_pairs(batches):
            if at != key:
                if key is not None:
                    yield found()
                key, ids, d, near = at, q_ids, np.zeros((len(x), 0)), np.zeros((len(x), 0), int)
            had, full = d.shape[1], min(k, d.shape[1] + len(y))
            old, old_ids = d, near
            d, near = (old, old_ids) if full == had else (np.zeros((len(x), full)), np.zeros((len(x), full), int))
            bound = old[:, -1] if had == k else np.full(len(x), np.inf)
            for a, b, dist in _Near(x, y, metric).within(bound, k if had < k else 0):
                some = np.unique(a)
                row = np.concatenate([np.repeat(some, had), a])
                value, name = np.concatenate([old[some].ravel(), dist]), np.concatenate([old_ids[some].ravel(), i_ids[b]])
                order = np.lexsort((name, value, row))
                row = row[order]
                best = order[np.arange(len(row)) - np.searchsorted(row, row) < full]
                d[some], near[some] = value[best].reshape(-1, full), name[best].reshape(-1, full)
        if key is not None:
            yield found()

    return nearest


def _best(near: DataFrame, k: int) -> DataFrame:
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("rank", "b")).select("id", (F.col("rank") + 1).alias("rank"), "b.neighbor", "b.distance")


def _pruned_knn(queries: DataFrame, items: DataFrame, n_items: int, k: int, metric: str, id_col: str, vector: str) -> DataFrame:
    pivots = _pivots(items, id_col, vector, metric, n_items)
    placed = _placed(items, id_col, vector, metric, pivots)
    asked = placed if queries is items else _placed(queries, id_col, vector, metric, pivots)
    between = _distances(pivots, pivots, "L1" if metric == "L1" else "L2")
    first: list[set[int]] = []  # for each pivot those nearest to it that hold k items
    for p in range(len(pivots)):
        order = np.argsort(between[p], kind="stable")
        enough = np.searchsorted(np.cumsum(placed.counts[order]), k) + 1
        first.append({int(i) for i in order[:enough] if placed.counts[i]})
    start = [(p, b, i, j) for p in range(len(pivots)) for b in range(asked.blocks[p]) for i in sorted(first[p]) for j in range(placed.blocks[i])] if asked.blocks.sum() * placed.blocks.max() < 1 << 16 else None
    spark = queries.sparkSession
    if start is None:  # many blocks: the pairs are made by the tasks
        heads = spark.range(len(pivots)).select(F.col("id").cast("int").alias("q_pivot"))
        lists = lambda v: F.element_at(F.array(*(F.array(*(F.lit(int(x)) for x in row)).cast("array<int>") for row in v)), F.col("q_pivot") + 1)
        wide = heads.withColumn("q_block", F.explode(lists([range(b) for b in asked.blocks]))).withColumn("i_pivot", F.explode(lists([sorted(f) for f in first])))
        per = F.element_at(F.array(*(F.lit(int(b)) for b in placed.blocks)), F.col("i_pivot") + 1)
        wanted = wide.withColumn("i_block", F.explode(F.sequence(F.lit(0), per - 1)))
    else:
        wanted = spark.createDataFrame(start, "q_pivot int, q_block int, i_pivot int, i_block int")
    q, i = _packed(asked, "q"), _packed(placed, "i")
    schema = "q_pivot int, q_block long, id long, neighbor long, distance double"
    begun = durable(_met(q, i, wanted, _nearest(k, metric), schema))
    # the k-th distance so far bounds how far a block needs to look; fewer than k items bound nothing
    kth = begun.groupBy("q_pivot", "q_block", "id").agg(F.slice(F.array_sort(F.collect_list("distance")), 1, k).alias("d"))
    far = F.when(F.size("d") < k, F.lit(float("inf"))).otherwise(F.element_at("d", -1))
    bounds = kth.groupBy("q_pivot", "q_block").agg(F.max(far).alias("bound"))
    radii = q.select("q_pivot", "q_block", F.col("q_r").alias("r"))
    more = _near_blocks(radii.join(bounds, ["q_pivot", "q_block"]), pivots, placed, metric, first)
    rest = _met(q, i, more, _nearest(k, metric), schema)
    return _best(begun.unionByName(rest), k)


def range_search(queries: DataFrame, items: DataFrame, radius: float, metric: str = "L2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, neighbor, distance): all items within ``radius`` of each query, exact, for vectors of any length.

    Vectors are grouped by their nearest pivot into blocks of bounded size; only blocks that the triangle inequality lets be near
    meet, and a task computes one pair of blocks. Null ids and vectors are left out; equal ids and vectors each count; an empty side gives no rows.
    """
    same = queries is items
    queries, items = (df.where(F.col(vector).isNotNull()) for df in (queries, items))
    n = items.count()
    if not n or radius < 0:
        return queries.sparkSession.createDataFrame([], "id long, neighbor long, distance double")
    pivots = _pivots(items, id_col, vector, metric, n)
    placed = _placed(items, id_col, vector, metric, pivots)
    asked = placed if same else _placed(queries, id_col, vector, metric, pivots)
    q, i = _packed(asked, "q"), _packed(placed, "i")
    wanted = _near_blocks(q.select("q_pivot", "q_block", F.col("q_r").alias("r"), F.lit(float(radius)).alias("bound")), pivots, placed, metric)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q_ids, x, i_ids, y in _block_pairs(batches):
            for a, b, d in _Near(x, y, metric).within(np.full(len(x), float(radius))):
                hit = d <= radius
                yield pa.RecordBatch.from_pydict({"id": q_ids[a[hit]], "neighbor": i_ids[b[hit]], "distance": d[hit]})

    return _met(q, i, wanted, within, "id long, neighbor long, distance double")


def append_neighbors(
    df: DataFrame, k: int = 5, metric: str = "L2", id_col: str = "vec_id", vector: str = "embedding",
    items: DataFrame | None = None, dist: str = "Distances", idn: str = "idNeighbors",
) -> DataFrame:
    """``df`` with the distances and ids of each row's nearest rows among ``items`` (none: its own, itself first)."""
    found = knn(df, df if items is None else items, k, metric, id_col, vector)
    found = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "neighbor"))).alias("n"))
    slim = found.select(F.col("id").alias("_id"), F.col("n.distance").alias(dist), F.col("n.neighbor").alias(idn))
    return df.join(slim, df[id_col] == F.col("_id")).drop("_id")


def knn_classify(queries: DataFrame, items: DataFrame, label: str, k: int = 5, metric: str = "L2", weighting: str = "uniform", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, label, score): each label's share among the ``k`` nearest items, by number or inverse distance."""
    near = knn(queries, items, k, metric, id_col, vector)
    labels = items.select(F.col(id_col).alias("neighbor"), F.col(label).alias("label"))
    weight = F.lit(1.0) if weighting == "uniform" else 1.0 / (F.col("distance") + 1e-12)
    votes = near.join(labels, "neighbor").withColumn("w", weight).groupBy("id", "label").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("id"))  # of at most k rows; a join would search twice
    return votes.select("id", "label", (F.col("w") / total).alias("score"))


def components(links: DataFrame) -> DataFrame:
    """(a, root): the least node that each node reaches; ``links`` holds both directions and each node with itself."""
    label = durable(links.select("a").distinct().select("a", F.col("a").alias("root")))
    while True:
        near = links.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root"))
        jump = near.join(label.select(F.col("a").alias("root"), F.col("root").alias("far")), "root").select("a", F.least("root", "far").alias("root"))
        moved = durable(jump)
        if moved.join(label, ["a", "root"], "left_anti").isEmpty():
            return label
        label = moved


def _regions(points: DataFrame, eps: float, names: list[str]) -> DataFrame:
    """``points`` (group, id, coordinates) with ``region``: points within ``eps`` of each other always share theirs.

    Cells of side ``eps`` over the first three coordinates that touch are linked; a region is a component
    of cells, so no pairs of points are made. A point with a missing coordinate is a region of its own.
    """
    cells = [f"c{i}" for i in range(min(3, len(names)))]
    placed = points.withColumns({c: F.floor(F.col(x) / (eps or 1.0)).cast("long") for c, x in zip(cells, names)})
    filled = durable(placed.groupBy("group", *cells).agg(F.min("id").alias("b")))
    around = filled.withColumnRenamed("b", "a")
    for c in cells:
        around = around.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    links = durable(around.join(filled, ["group", *cells]).select("a", "b"))
    roots = filled.join(components(links), F.col("a") == F.col("b")).select("group", *cells, F.col("root").alias("region"))
    whole = placed.join(roots, ["group", *cells], "left")
    return whole.withColumn("region", F.coalesce("region", "id")).select("group", "region", "id", *names)


def optics(df: DataFrame, eps: float, mps: int, id_col: str, columns: list[str], group: str | None = None) -> DataFrame:
    """(group, id, place, reachability, core): the density order of each group's points.

    The order starts at the least id that is left and follows the points it reaches; what no core point
    reaches starts anew, with an infinite reachability. Such runs never leave a region of near cells, so
    regions are ordered apart, each one task's work, sequential by nature, and runs are put in the order
    of their first ids. Undefined distances are infinite; ties go to the smaller id.
    """
    names = [f"x{i}" for i in range(len(columns))]
    points = df.select((F.col(group) if group else F.lit(0)).cast("long").alias("group"), F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(x) for c, x in zip(columns, names)))

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        out, runs, reach, core = density_order(ids, rows[names].to_numpy(float), eps, mps)
        return pd.DataFrame({"group": rows["group"].iloc[0], "run": runs, "step": range(len(out)), "id": ids[out], "reachability": reach[out], "core": core[out]})

    ordered = _regions(points, eps, names).groupBy("group", "region").applyInPandas(order, "group long, run long, step int, id long, reachability double, core double")
    placed = with_index(ordered, ["group", "run", "step"], "place")
    first = placed.groupBy("group").agg(F.min("place").alias("first"))
    return placed.join(first, "group").select("group", "id", (F.col("place") - F.col("first")).cast("int").alias("place"), "reachability", "core")
