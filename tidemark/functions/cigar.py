"""Alignment strings (CIGAR) and flags of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse(cigar: str | Column) -> Column:
    """array<struct(n, op)>."""
    pat = r"([0-9]+)([MIDNSHP=X])"
    ns, ops = F.regexp_extract_all(_c(cigar), F.lit(pat), F.lit(1)), F.regexp_extract_all(_c(cigar), F.lit(pat), F.lit(2))
    return F.zip_with(ns, ops, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def total(cigar: str | Column, ops: str) -> Column:
    """Summed lengths of the operations in ``ops``."""
    return F.aggregate(parse(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin(*ops), x["n"]).otherwise(0))


def coverage(cigar: str | Column) -> Column:
    return total(cigar, "M")


def reference_span(cigar: str | Column) -> Column:
    return total(cigar, "MDNX=")


def query_length(cigar: str | Column) -> Column:
    return total(cigar, "MIS=X")


def has_flag(flag: str | Column, bits: int) -> Column:
    return _c(flag).bitwiseAND(F.lit(bits)) != 0


def is_primary(flag: str | Column) -> Column:
    """Neither secondary nor supplementary."""
    return _c(flag).bitwiseAND(F.lit(2304)) == 0


def exons(pos: str | Column, cigar: str | Column, min_intron: int = 68) -> Column:
    """Half-open reference blocks array<struct(s, e)> of a 1-based position; only N of ``min_intron`` or more splits."""
    start = F.struct((_c(pos).cast("bigint") - 1).alias("at"), F.array(F.struct((_c(pos).cast("bigint") - 1).alias("s"), (_c(pos).cast("bigint") - 1).alias("e"))).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        moves = x["op"].isin("M", "D", "N", "=", "X")
        to = acc["at"] + F.when(moves, x["n"]).otherwise(0)
        last = F.element_at(acc["done"], -1)
        grown = F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.struct(last["s"].alias("s"), to.alias("e"))))
        split = F.concat(acc["done"], F.array(F.struct(to.alias("s"), to.alias("e"))))
        return F.struct(to.alias("at"), F.when(~moves, acc["done"]).when((x["op"] == "N") & (x["n"] >= min_intron), split).otherwise(grown).alias("done"))

    return F.aggregate(parse(cigar), start, step)["done"]


def build(blocks: str | Column, query_starts: str | Column, query_size: str | Column, min_intron: int = 68) -> Column:
    """CIGAR of half-open target blocks with the query start of each: soft clips, I, D, and N for gaps of an intron's length."""
    b, q = _c(blocks), _c(query_starts)
    idx = F.sequence(F.lit(1), F.size(b))

    def piece(i: Column) -> Column:
        cur = F.element_at(b, i)
        gap_t = F.when(i > 1, cur["s"] - F.try_element_at(b, F.greatest(i - 1, F.lit(1)))["e"]).otherwise(0)
        before = F.try_element_at(b, F.greatest(i - 1, F.lit(1)))
        gap_q = F.when(i > 1, F.element_at(q, i) - F.element_at(q, F.greatest(i - 1, F.lit(1))) - (before["e"] - before["s"])).otherwise(0)
        ins = F.when(gap_q > 0, F.concat(gap_q.cast("string"), F.lit("I"))).otherwise("")
        gap = F.when(gap_t >= min_intron, F.concat(gap_t.cast("string"), F.lit("N"))).when(gap_t > 0, F.concat(gap_t.cast("string"), F.lit("D"))).otherwise("")
        return F.concat(ins, gap, (cur["e"] - cur["s"]).cast("string"), F.lit("M"))

    head, lastb = F.element_at(q, 1), F.element_at(b, -1)
    tail = _c(query_size) - F.element_at(q, -1) - (lastb["e"] - lastb["s"])
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(head), F.concat_ws("", F.transform(idx, piece)), clip(tail))
