"""Scores to probabilities: isotonic steps by pooled adjacent violators, and Platt's logistic curve."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are pooled to at most this many steps before violators are.
STEPS = 1000


def step_column(score: Column, starts: list[float], values: list[float]) -> Column:
    """The value of the last start at or below the score (the first value below all), as a balanced tree of comparisons."""
    if len(values) == 1:
        return F.lit(float(values[0]))
    mid = len(values) // 2
    return F.when(score < F.lit(starts[mid]), step_column(score, starts[:mid], values[:mid])).otherwise(step_column(score, starts[mid:], values[mid:]))


def pool(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(start, mean) of non-decreasing steps from (start, weight, sum) in order of start: violators share their mean."""
    out: list[list[float]] = []
    for start, weight, total in blocks:
        out.append([start, weight, total])
        while len(out) > 1 and out[-2][2] * out[-1][1] >= out[-1][2] * out[-2][1]:
            _, w, t = out.pop()
            out[-1][1] += w
            out[-1][2] += t
    return [(s, t / w) for s, w, t in out]


@dataclass
class Isotonic:
    """The non-decreasing step function of a score that is nearest to the targets in squared error.

    Rows meet by score in one aggregation; scores are put in at most STEPS pools between quantiles of the distinct
    scores (with fewer distinct scores each is its own), and the pools' sums are all that the driver gets. Rows
    without a finite score or a target are left out; ties of a score share a step. Without any row the value is 0.5. A score that is
    null or NaN has no probability.
    """

    starts: list[float]
    values: list[float]

    @classmethod
    def fit(cls, df: DataFrame, score: Column, target: Column) -> Isotonic:
        rows = df.select((score.cast("double") + 0.0).alias("s"), target.cast("double").alias("y")).where("s is not null and y is not null and not isnan(s) and abs(s) < double('infinity')")
        pooled = rows.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("t"))
        cuts = pooled.agg(F.percentile_approx("s", [i / STEPS for i in range(STEPS + 1)], 20 * STEPS)).first()[0]
        if not cuts:
            return cls([0.0], [0.5])
        cuts = sorted(set(cuts))
        found = pooled.groupBy(step_column(F.col("s"), cuts, cuts).alias("s")).agg(F.sum("w"), F.sum("t")).orderBy("s").collect()  # at most STEPS + 1 rows
        steps = pool([tuple(r) for r in found])
        return cls([s for s, _ in steps], [v for _, v in steps])

    def column(self, score: Column) -> Column:
        return F.when(score.isNotNull() & ~F.isnan(score.cast("double")), step_column(score.cast("double"), self.starts, self.values))

    def value(self, score: float | None) -> float | None:
        if score is None or score != score:
            return None
        return self.values[max(0, bisect_right(self.starts, score) - 1)]


@dataclass
class Platt:
    """1 / (1 + exp(a * score + b)), fitted by Newton's method; targets are drawn in by one row, as Platt proposed."""

    a: float
    b: float

    @classmethod
    def fit_all(cls, df: DataFrame, scores: list[Column], targets: list[Column], rounds: int = 30) -> list[Platt]:
        """One curve a score column: each round is one aggregation of a few sums a curve for all of them.

        Rows without a finite score or a target are left out; a curve without rows of one kind is nearly constant.
        """
        count = len(scores)
        s = [F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")) & t.isNotNull(), x.cast("double")) for x, t in zip(scores, targets, strict=True)]
        y = [t.cast("double") for t in targets]
        sums = [F.array(F.count(x), F.coalesce(F.sum(F.when(x.isNotNull(), t)), F.lit(0.0)), F.coalesce(F.stddev_pop(x), F.lit(0.0)), F.coalesce(F.avg(x), F.lit(0.0))) for x, t in zip(s, y, strict=True)]
        first = df.agg(F.array(*sums)).first()[0]
        kinds = [(n - p, p) for n, p, _, _ in first]
        # curves over the standardised score, so that steps are of a like size
        z = [(x - F.lit(m)) / F.lit(d or 1.0) for x, (_, _, d, m) in zip(s, first, strict=True)]
        aim = [F.when(t > 0, F.lit((p + 1) / (p + 2))).otherwise(F.lit(1 / (n + 2))) for t, (n, p) in zip(y, kinds, strict=True)]
        at = [[0.0, math.log((n + 1) / (p + 1))] for n, p in kinds]
        live = set(range(count))

        def loss(i: int, a: float, b: float) -> Column:
            f = F.lit(a) * z[i] + F.lit(b)
            return F.coalesce(F.sum(aim[i] * f + F.greatest(-f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f)))), F.lit(0.0))

        for _ in range(rounds):
            if not live:
                break
            order = sorted(live)
            parts = []
            for i in order:
                p = 1 / (1 + F.exp(F.lit(at[i][0]) * z[i] + F.lit(at[i][1])))
                d, h = aim[i] - p, p * (1 - p)
                parts.append(F.array(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in (z[i] * d, d, z[i] * z[i] * h, h, z[i] * h)), loss(i, *at[i])))
            moves = {}
            for i, (ga, gb, haa, hbb, hab, now) in zip(order, df.agg(F.array(*parts)).first()[0], strict=True):
                if max(abs(ga), abs(gb)) < 1e-9 * (1 + sum(kinds[i])):
                    live.discard(i)
                    continue
                haa, hbb = haa + 1e-12, hbb + 1e-12
                det = haa * hbb - hab * hab
                moves[i] = (-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det, now)
            if not moves:
                break
            tried = [0.5**k for k in range(8)]
            losses = df.agg(F.array(*(F.array(*(loss(i, at[i][0] + w * da, at[i][1] + w * db) for w in tried)) for i, (da, db, _) in moves.items()))).first()[0]
            for (i, (da, db, now)), found in zip(moves.items(), losses, strict=True):
                better = [w for w, x in zip(tried, found, strict=True) if x < now]
                if not better:
                    live.discard(i)
                    continue
                at[i] = [at[i][0] + better[0] * da, at[i][1] + better[0] * db]
        return [cls(a / (d or 1.0), b - a * m / (d or 1.0)) for (a, b), (_, _, d, m) in zip(at, first, strict=True)]

    @classmethod
    def fit(cls, df: DataFrame, score: Column, target: Column) -> Platt:
        return cls.fit_all(df, [score], [target])[0]

    def column(self, score: Column) -> Column:
        return F.when(~F.isnan(score.cast("double")), 1 / (1 + F.exp(F.lit(self.a) * score.cast("double") + F.lit(self.b))))

    def value(self, score: float | None) -> float | None:
        if score is None or score != score:
            return None
        x = self.a * score + self.b
        return 1 / (1 + math.exp(x)) if x < 700 else 0.0
