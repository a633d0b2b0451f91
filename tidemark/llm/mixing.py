"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised.  The exponent is
bisected: the least one that keeps the most repeated source within ``repeat_limit``
times the least repeated one, or the greatest one whose weights reach a target
entropy.  The budget is realised per source as whole epochs plus a part of one more:
each epoch is a permutation of the source's blocks (documents dealt by hash), the
part takes blocks in that order, and documents in hash order within the block where
the budget ends.

Tokens are words here.  Cases: null sources count as the source with the empty name; null and empty texts
weigh no tokens but are placed; rows that repeat an id share its place; a source
without tokens is placed once; ties in hash order fall by id; an empty table gives no rows; texts of any length
are counted whole, in the JVM; further columns come along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features, scratch

#: Blocks of a source (more for larger tables, so that a block has about BLOCK_ROWS documents at most), and the most
#: sources (whose totals alone come to the driver).
BLOCKS = 256
BLOCK_ROWS = 8192
MOST_SOURCES = 100_000


def words(text_col: str = "text") -> Column:
    """Tokens of a text for mixing: its words."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    most = max(shares.values(), default=0)
    powers = {s: (p / most) ** exponent if p > 0 else 0.0 for s, p in shares.items()}  # relative to the largest: it never vanishes
    total = sum(powers.values())
    return {s: p / total if total else 0.0 for s, p in powers.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in w.values() if p > 0)


def exponent(shares: dict[str, float], repeat_limit: float | None = None, target_entropy: float | None = None) -> float:
    """Bisection: repeats fall and entropy falls as the exponent rises, and at 1 nothing is repeated more than anything else."""
    some = {s: p for s, p in shares.items() if p > 0}
    if not some:
        return 1.0

    def fits(a: float) -> bool:
        w = weights(some, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        repeats = [w[s] / p for s, p in some.items()]
        return max(repeats) <= (repeat_limit or 1.0) * min(repeats) * (1 + 1e-12)

    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    while not fits(high):  # an entropy below that of the shares themselves: they are sharpened, not smoothed
        low, high = high, 2 * high
        if high > 2**20:
            most = max(some.values())
            raise ValueError(f"no exponent has an entropy of {target_entropy} or less: {sum(p == most for p in some.values())} sources are the largest")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def _plan(totals: dict[str, int], budget: int | None, repeat_limit: float | None, target_entropy: float | None) -> list[tuple]:
    """(source, whole epochs, tokens of the part) for every source."""
    sum_ = sum(totals.values())
    shares = {s: n / sum_ if sum_ else 0.0 for s, n in totals.items()}
    w = weights(shares, exponent(shares, repeat_limit, target_entropy))
    if budget is None:  # the least budget that shows every document once
        budget = max((totals[s] / w[s] for s in totals if w[s] > 0), default=0)
    plan = []
    for s, n in totals.items():
        epochs = w[s] * budget / n if n else 1.0
        whole = math.floor(epochs + 1e-9)
        plan.append((s, whole, int((epochs - whole) * n) if epochs > whole else 0))
    return plan


def mix(docs: DataFrame, budget: int | None = None, repeat_limit: float | None = 1.5, target_entropy: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of ``docs``, whatever their names, and mix_epoch, mix_tokens, mix_order for each placed copy.

    Where ``docs`` has a column of one of the three names, the added one has underscores behind it.

    ``mix_order`` in [0, 1) is the copy's place in the mixture: sorting by it interleaves the sources evenly.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source_col), F.lit("")).alias("mix_source")
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    n_blocks = max(BLOCKS, 1 << (docs.count() // BLOCK_ROWS).bit_length())
    # the caller's columns travel as one struct, so that no name of theirs meets one of ours
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("mix_row")
    dealt = docs.select(row, F.col(id_col).alias("mix_id"), name, key.alias("mix_key"), F.pmod(key, F.lit(n_blocks)).cast("int").alias("mix_block"), words(text_col).alias("mix_tokens"))
    slim = scratch.written(dealt.select("mix_id", "mix_source", "mix_key", "mix_block", "mix_tokens"), "mix-keys")
    blocks = scratch.written(slim.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("tokens")), "mix-blocks")
    rows = blocks.groupBy("mix_source").agg(F.sum("tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = _plan({r.mix_source: r.n for r in sorted(rows)}, budget, repeat_limit, target_entropy)
    plan_df = F.broadcast(spark.createDataFrame(plan, "mix_source string, whole int, part long"))
    # the partial epoch: blocks in permuted order up to the budget
    permuted = F.xxhash64(F.lit(seed), F.lit("part"), "mix_source", "mix_block")
    order = W.partitionBy("mix_source").orderBy(permuted, "mix_block")
    ranked = blocks.join(plan_df, "mix_source").withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.select("mix_source", "mix_block", "whole", "tokens", (F.col("part") - F.col("before")).alias("room"))
    inside = slim.join(ranked.where("room > 0 and room < tokens").select("mix_source", "mix_block", "room"), ["mix_source", "mix_block"])
    by_key = inside.groupBy("mix_source", "mix_block", "mix_key").agg(F.sum("mix_tokens").alias("tokens"), F.first("room").alias("room"))
    upto = F.sum("tokens").over(W.partitionBy("mix_source", "mix_block").orderBy("mix_key"))
    last = by_key.withColumn("upto", upto).where("upto <= room").groupBy("mix_source", "mix_block").agg(F.max("mix_key").alias("last_key"))
    table = ranked.join(last, ["mix_source", "mix_block"], "left").select("mix_source", "mix_block", "whole", ((F.col("room") > 0) & (F.col("room") >= F.col("tokens"))).alias("all_in"), "last_key")
    table = scratch.written(table.where("whole > 0 or all_in or last_key is not null"), "mix-plan")
    small = table.count() <= MOST_SOURCES  # a block row is about 40 bytes; beyond this the join shuffles by source and block
    placed = dealt.join(F.broadcast(table) if small else table, ["mix_source", "mix_block"])
    more = F.coalesce(F.col("all_in"), F.lit(False)) & (F.col("mix_tokens") >= 0) | F.coalesce(F.col("mix_key") <= F.col("last_key"), F.lit(False))
    copies = F.col("whole") + more.cast("int")
    placed = placed.withColumn("mix_copies", copies).where("mix_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    # blocks change places from epoch to epoch, and documents within their block
    turn = F.pmod(F.xxhash64(F.lit(seed), "mix_epoch", "mix_source", "mix_block"), F.lit(2**20)) * 1.0
    within = F.pmod(F.xxhash64(F.lit(seed), "mix_epoch", "mix_key"), F.lit(2**20)) / float(2**20)
    place = (F.col("mix_epoch") + (turn + within) / float(2**20)) / F.col("mix_copies")
    own = [F.col(c).alias(free) for c, free in zip(("mix_epoch", "mix_tokens", "mix_order"), features.fresh(docs, "mix_epoch", "mix_tokens", "mix_order"))]
    return placed.withColumn("mix_order", place).select("mix_row.*", *own)
