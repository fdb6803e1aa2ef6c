"""Linear ranking by pairs inside groups: squared pairwise loss, from sums alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector.cast("array<double>"), F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def _totals(df: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of c v v', sum of r v) over rows (v, c, r): a task hands on one row of its sums, these are added by slot."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, line = np.zeros((dim, dim)), np.zeros(dim)
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"].to_numpy()).astype(float)
                square += (v * frame["c"].to_numpy(float)[:, None]).T @ v
                line += frame["r"].to_numpy(float) @ v
        flat = np.concatenate([square.ravel(), line])
        yield pd.DataFrame({"slot": np.arange(len(flat)), "x": flat})

    rows = df.mapInPandas(partial, "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect()  # dim * (dim + 1) rows
    flat = np.zeros(dim * dim + dim)
    for slot, x in rows:
        flat[slot] = x
    return flat[: dim * dim].reshape(dim, dim), flat[dim * dim :]


def fit_ranker(df: DataFrame, features: str, relevance: str, group: str | list[str], l2: float = 1.0) -> list[float]:
    """Weights w with least sum of (1 - w (x_i - x_j))^2 + l2 |w|^2 over pairs of one group whose first row is more relevant.

    No pair is made. A row takes part in as many pairs as its group has rows of other relevance, and what pairs share is
    the product of sums by (group, relevance): counts and sums are aggregated with partial sums in the tasks, so a hot group is a few rows,
    and rows get their counts by a join that Spark splits where it is skewed. A group's grades (not its rows) are put in
    order in one task. Rows with null features, null relevance or a null slot are left out; a null group is a group. Groups of one grade and empty
    tables add nothing: all weights are then 0. Features must have one length, up to a few thousand slots.
    """
    keys = [group] if isinstance(group, str) else list(group)
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, k, strict=True)), F.col(f"`{relevance}`").cast("double").alias("_y"), F.col(f"`{features}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y") & F.forall("v", lambda x: x.isNotNull()))
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    dim = sizes[1]
    if not dim:
        return []
    if sizes[0] != dim:
        raise ValueError(f"features have {sizes[0]} to {dim} slots")
    counts = rows.groupBy(*k, "_y").agg(F.count(F.lit(1)).alias("n"))
    grades = Window.partitionBy(*k)
    below = F.coalesce(F.sum("n").over(grades.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(grades)
    placed = counts.select(*k, "_y", (whole - F.col("n")).alias("c"), (below - (whole - below - F.col("n"))).alias("r")).where("c > 0")
    joined = rows.alias("a").join(placed.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*k, "_y"]])
    square, line = _totals(joined.select("v", "c", "r"), dim)
    by_grade = rows.groupBy(*k, "_y").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v"))
    by_group = by_grade.groupBy(*k).agg(F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v"))
    shared = by_grade.select("v", F.lit(-1).alias("c"), F.lit(0).alias("r")).unionByName(by_group.select("v", F.lit(1).alias("c"), F.lit(0).alias("r")))
    square -= _totals(shared, dim)[0]
    return np.linalg.solve(square + l2 * np.eye(dim), line).tolist()


def fit_class_ranker(df: DataFrame, features: str, label: str, classes: list, l2: float = 1.0) -> list[list[float]]:
    """One weight vector a class (the last weight is the constant) by the same loss: a row's group are its candidate classes.

    A row's own class is to score 1 more than each other one. The sums that the pairs need are those of x x' and x by class.
    """
    rows = df.select(F.col(f"`{label}`").alias("y"), F.col(f"`{features}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("y").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return [[0.0] for _ in classes]
    size, k = dim + 1, len(classes)
    number = {c: i for i, c in enumerate(classes)}

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, size, size))  # the last row of each holds the sums of x and the count
        for frame in frames:
            if len(frame):
                v = np.column_stack([np.stack(frame["v"].to_numpy()).astype(float), np.ones(len(frame))])
                at = frame["y"].map(number).to_numpy()
                for i in np.unique(at):
                    total[i] += v[at == i].T @ v[at == i]
        yield pd.DataFrame({"slot": np.arange(total.size), "x": total.ravel()})

    found = rows.mapInPandas(partial, "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect()  # classes * (dim + 1)^2 rows
    total = np.zeros(k * size * size)
    for slot, x in found:
        total[slot] = x
    total = total.reshape(k, size, size)
    square, line = np.zeros((k * size, k * size)), np.zeros(k * size)
    block = lambda i: slice(i * size, (i + 1) * size)
    for i in range(k):
        for j in range(k):
            if i != j:
                square[block(i), block(i)] += total[i]
                square[block(j), block(j)] += total[i]
                square[block(i), block(j)] -= total[i]
                square[block(j), block(i)] -= total[i]
                line[block(i)] += total[i][-1]
                line[block(j)] -= total[i][-1]
    return np.linalg.solve(square + l2 * np.eye(k * size), line).reshape(k, size).tolist()
