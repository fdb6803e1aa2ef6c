"""Centroid clustering: Lloyd's rounds in exact integers, centroids broadcast, sums merged by groupBy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles_cleared, unused

#: Vectors compared at a time inside a task.
SLICE = 4096
#: Quantised components must be smaller than this: squares of differences over 2^12 components then fit a long.
LARGEST = 1 << 24


def quantised(vectors: pd.Series, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are kept, their components as floor(scale * x)); a null is read as NaN, so it is not finite."""
    sized = np.fromiter((v is not None and len(v) == dim for v in vectors), bool, len(vectors))
    if not sized.any():
        return sized, np.zeros((0, dim), np.int64)
    values = np.stack([np.asarray(v, np.float64) for v in vectors[sized]])
    finite = np.isfinite(values).all(axis=1)
    sized[np.flatnonzero(sized)[~finite]] = False
    scaled = np.floor(scale * values[finite])
    if (np.abs(scaled) >= LARGEST).any():
        raise ValueError(f"a component times {scale} reaches {LARGEST}")
    return sized, scaled.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equally near ones; squared distance to it)."""
    far = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        off = vectors - c
        far[:, j] = np.einsum("ij,ij->i", off, off)
    at = far.argmin(axis=1)  # the first of equals
    return at, far[np.arange(len(vectors)), at]


def first_centroids(table: DataFrame, key: str, vector: str, k: int, dim: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` kept vectors (fewer where there are no more) whose SHA-256 of ``seed:key`` is least, in that order."""
    item = F.col("_v")
    kept = table.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").cast("array<double>").alias("_v")).where(
        (F.size("_v") == dim) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    rows = kept.orderBy(name.asc_nulls_last(), item).select("_v").limit(k).collect()  # k rows
    return quantised(pd.Series([r[0] for r in rows], dtype=object), dim, scale)[1]


def cluster_sums(table: DataFrame, vector: str, centroids: np.ndarray, scale: int, sums: bool = True) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: (vectors, squared distances summed, components summed), exact, merged from one row a slot and partition."""
    dim = centroids.shape[1]
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(shared.value), dim + 2), object)  # Python integers: no overflow
        for frame in frames:
            for first in range(0, len(frame), SLICE):
                _, values = quantised(frame["v"].iloc[first : first + SLICE], dim, scale)
                at, far = nearest(values, shared.value)
                for j in np.unique(at):
                    mine = at == j
                    total[j, 0] += int(mine.sum())
                    total[j, 1] += int(far[mine].sum())
                    if sums:
                        total[j, 2:] += values[mine].sum(axis=0)
        j, slot = np.nonzero(total)
        yield pd.DataFrame({"cluster": j, "slot": slot, "total": pd.Series([str(x) for x in total[j, slot]], dtype=object)})

    slots = table.select(F.col(f"`{vector}`").alias("v")).mapInPandas(partial, "cluster int, slot int, total string")
    with shuffles_cleared(table.sparkSession):
        merged = slots.groupBy("cluster", "slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # at most k * (dim + 2) rows
    found: dict[int, list[int]] = {}
    for row in merged:
        found.setdefault(row["cluster"], [0] * (dim + 2))[row["slot"]] = int(row["total"])
    return {j: (v[0], v[1], v[2:]) for j, v in found.items()}


def centroid_clusters(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, seed: str = "1") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of each kept row: plain Lloyd in integers.

    A vector is kept if it has exactly ``dim`` components, none null or not finite; its components become
    floor(scale * x). The ``k`` kept vectors of least SHA-256 of ``seed:key`` (null keys last, equal keys by
    their vectors) start as centroids. Each round assigns all vectors to the nearest centroid (ties: the
    smaller number) and moves each centroid to its vectors' floor(sum / count); one without vectors stays.
    The rows are assigned once more at the end. distance: squared; inertia: distances summed.

    Each pass reads the table, sends k * dim numbers to tasks and (dim + 2) sums a cluster and partition
    back; rows are never shuffled, so repeated vectors, equal keys and hot clusters cost nothing. Fewer
    kept vectors than ``k`` make as many clusters, none an empty table. A component that reaches
    2^24 is an error, not a wrong distance. Other columns of the table are not read, so their names do not
    matter; a new column gets a ``_`` where the key has its name.
    """
    if dim > 4096:
        raise ValueError("more than 4,096 components could overflow a distance")
    centroids = first_centroids(table, key, vector, k, dim, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        for j, (n, _, total) in cluster_sums(table, vector, centroids, scale).items():
            centroids[j] = [t // n for t in total]
    found = cluster_sums(table, vector, centroids, scale, sums=False) if len(centroids) else {}
    inertia = sum(far for _, far, _ in found.values())
    shared = table.sparkSession.sparkContext.broadcast(centroids)
    each = {j: far for j, (_, far, _) in found.items()}

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value.tolist()
        for frame in frames if rows else ():
            for first in range(0, len(frame), SLICE):
                part = frame.iloc[first : first + SLICE]
                kept, values = quantised(part["v"], dim, scale)
                if not len(values):
                    continue
                at, far = nearest(values, shared.value)
                yield pd.DataFrame({"k": pd.Series(part["k"][kept].tolist(), dtype=object), "c": at, "d": far, "ci": [each[j] for j in at], "i": inertia, "at": [rows[j] for j in at]})

    # the key goes as text: pandas would make a float of a long beside nulls
    text = table.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{vector}`").alias("v"))
    out = text.mapInPandas(assign, "k string, c int, d long, ci long, i long, at array<long>")
    names = [key]
    for name in ("cluster", "distance", "cluster_inertia", "inertia", "centroid"):
        names.append(unused(name, names))
    return out.withColumn("k", F.col("k").cast(table.schema[key].dataType)).toDF(*names)


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = centroid_clusters(table)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql(k: int = 16, dim: int = 64, rounds: int = 3) -> str:
    """The same rounds as common table expressions: components in long form, integer sums as HUGEINT."""
    parts = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {dim} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0)""",
        f"v AS (SELECT r, vec_id, s.s AS s, floor(64 * (embedding[s.s]::DOUBLE))::BIGINT AS x FROM kept, range(1, {dim + 1}) AS s(s))",
        f"""start AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM kept
            QUALIFY c < {k})""",
        "c0 AS (SELECT c, s, x FROM start JOIN v USING (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, c, sum((v.x - c{i}.x) * (v.x - c{i}.x))::BIGINT AS d FROM v JOIN c{i} USING (s) GROUP BY r, c)")
        parts.append(f"a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, s, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{i} JOIN v USING (r) GROUP BY c, s)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.c, c{i}.s, coalesce((t - ((t % n) + n) % n) // n, x)::BIGINT AS x FROM c{i} LEFT JOIN m{i} USING (c, s))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY s)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
            (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN h USING (c) JOIN kept USING (r)"""


OP12_SQL = _sql()
