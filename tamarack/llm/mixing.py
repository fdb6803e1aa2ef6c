"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source token shares p are raised to an exponent a and normalised: w = p^a / sum(p^a). From 1 (as they
are) down to 0 (uniform) entropy and the repetition of small sources rise; bisection finds the
smallest exponent that stays within the wanted entropy and the repetition limit. Each source is then
read in whole epochs and one partial one: its documents fall into blocks of bounded size, blocks and
the documents inside are permuted by hashes, and the partial epoch stops at its token budget.
All of it is SQL functions; only per-exponent sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, stored

#: Bits of the exponent, and how many of them one job settles.
BITS, BITS_A_JOB = 24, 4
BLOCK_TOKENS, MOST_BLOCKS = 1 << 14, 1 << 20


def word_tokens(text: Column) -> Column:
    """Words between white space; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sums(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """For each exponent: sum of p^a, entropy of w, largest p^(1-a), largest p^(a-1)."""
    a, p = F.col("a"), F.col("p")
    spread = sources.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("q", F.pow(p, a))
    rows = spread.groupBy("a").agg(
        F.sum("q").alias("z"), F.sum(F.col("q") * F.log(p)).alias("e"), F.max(F.pow(p, 1 - a)).alias("up"), F.max(F.pow(p, a - 1)).alias("down")
    )
    import math

    return {r["a"]: (r["z"], math.log(r["z"]) - r["a"] * r["e"] / r["z"], r["up"], r["down"]) for r in rows.collect()}


def fit_exponent(sources: DataFrame, entropy_share: float, max_repeats: float, budget_share: float | None) -> tuple[float, float, float]:
    """(exponent, sum of p^a, budget as a share of all tokens) for ``sources`` (p: share > 0 each).

    The wanted entropy lies ``entropy_share`` of the way from that of p to that of equal weights.
    Without a budget it is the least that reads every document at least once. Both measures fall as the
    exponent grows, so at 1 all sources repeat alike and least: if even this is over ``max_repeats``, no
    exponent fits, and a ValueError says so.
    """
    ends = _sums(sources, [0.0, 1.0])
    wanted = ends[1.0][1] + entropy_share * (ends[0.0][1] - ends[1.0][1])

    def budget(s) -> float:
        return budget_share if budget_share is not None else s[2] * s[0]

    def fits(s) -> bool:
        return s[1] <= wanted + 1e-12 and budget(s) / s[0] * s[3] <= max_repeats + 1e-12

    if not fits(ends[1.0]):
        raise ValueError(f"no weights fit: the budget reads all sources {budget(ends[1.0]):.6g} times, the limit is {max_repeats}")
    low, high, best = 0, 1 << BITS, ends[1.0]
    if fits(ends[0.0]):
        return 0.0, ends[0.0][0], budget(ends[0.0])
    while high - low > 1:  # ``low`` does not fit, ``high`` does; several halvings a job
        step = max(1, (high - low) >> BITS_A_JOB)
        found = _sums(sources, [x / (1 << BITS) for x in range(low + step, high, step)])
        for x in range(low + step, high, step):
            if fits(found[x / (1 << BITS)]):  # so do all above
                high, best = x, found[x / (1 << BITS)]
                break
            low = x
    return high / (1 << BITS), best[0], budget(best)


def mix_sources(
    docs: DataFrame, entropy_share: float = 0.5, max_repeats: float = 4.0, budget: int | None = None, seed: int = 17, tokens: Column | None = None
) -> DataFrame:
    """The mix as rows (doc_id, source, n_tokens, weight, epoch, block, place): one for each reading.

    ``weight`` is the source's target share; ``epoch`` counts its passes; documents are read by epoch,
    then ``block`` (a permuted number), then ``place`` in it. With ``budget`` tokens each source gets
    weight * budget, the last document of a partial epoch going over it at most by its own
    length; without, the budget is the least that reads every document once. No source is read more
    than ``max_repeats`` times on average (a part of an epoch reads part of its documents once more);
    a budget that must break this raises ValueError. ``entropy_share`` is from 0 (weights as the shares
    are) to 1 (as even as the limit allows). A null source counts as
    the empty one; null ids and texts are fine (no tokens); documents without tokens are read with
    each epoch that reaches them, sources without tokens in one epoch. Repeated rows are read each;
    an empty table gives no rows; texts count whole, whatever their length; ties in the permutation go
    by id and length; other columns do not matter.
    """
    if not 0 <= entropy_share <= 1 or max_repeats < 1:
        raise ValueError("entropy_share must lie from 0 to 1, max_repeats at 1 or above")
    sized = stored(
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (word_tokens(F.col("text")) if tokens is None else tokens.cast("long")).alias("n_tokens"), F.xxhash64("text", F.monotonically_increasing_id()).alias("row")),
        "sized",
    )
    counts = sized.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    total = counts.agg(F.sum("t")).first()[0] or 0
    shares = stored(counts.withColumn("p", F.col("t") / F.lit(float(max(total, 1)))), "shares")
    some = shares.where("t > 0")
    if total:
        a, z, share = fit_exponent(some, entropy_share, max_repeats, None if budget is None else budget / total)
    else:
        a, z, share = 1.0, 1.0, 1.0
    blocks = max(BLOCK_TOKENS, total // MOST_BLOCKS)
    passes = F.when(F.col("t") > 0, F.pow("p", F.lit(a) - 1) * F.lit(share / z)).otherwise(F.lit(1.0))
    plan = shares.withColumns({"weight": F.when(F.col("t") > 0, F.pow("p", F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0)), "passes": passes})
    plan = plan.withColumn("whole", F.floor(F.col("passes") + 1e-9).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), (F.col("passes") - F.col("whole")) * F.col("t")))
    plan = plan.withColumn("rest", F.when(F.col("rest") < 1e-6 * F.col("t"), 0.0).otherwise(F.col("rest")))
    plan = plan.withColumn("blocks", F.ceil((F.col("t") + 1) / F.lit(float(blocks)))).select("source", "weight", "whole", "rest", "blocks")

    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1))
    epochs = F.when((F.col("whole") > 0) | (F.col("rest") > 0), epochs).otherwise(F.expr("cast(array() as array<int>)"))
    read = sized.join(broadcast_if(plan), "source").withColumn("epoch", F.explode(epochs))
    # the row's own number is stored with it: rows without ids, or with equal ones, spread over the blocks too
    lot = F.xxhash64(F.lit(seed), "epoch", "doc_id", "n_tokens", F.when(F.col("doc_id").isNull(), F.col("row")))
    read = read.withColumn("lot", lot).withColumn("b", F.pmod("lot", "blocks"))
    # where each block of the permutation begins: blocks are few and of bounded size
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "b"), "b")
    placed = read.groupBy("source", "epoch", "b").agg(F.sum("n_tokens").alias("s"))
    placed = placed.select(
        "source", "epoch", "b", F.row_number().over(order).alias("block"), F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("source", "epoch", "b").orderBy(F.xxhash64("lot"), "doc_id", "n_tokens")
    mixed = read.withColumns(
        {"place": F.row_number().over(inside), "ahead": F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    ).join(placed, ["source", "epoch", "b"])
    mixed = mixed.where((F.col("epoch") < F.col("whole")) | (F.col("before") + F.col("ahead") < F.col("rest")))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("weight", F.round("weight", 6))
