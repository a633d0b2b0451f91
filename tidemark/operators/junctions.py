"""Splice junctions of alignment records and transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar

#: Donor and acceptor letters of the plus strand, by priority (fixed values).
SITES = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))


def is_junction_row(cigar_col: str = "cigar", min_intron: int = 68, overhang: int = 0) -> Column:
    """An intron of ``min_intron`` with at least ``overhang`` aligned bases on both sides."""
    ex = cigar.exons(F.lit(1), cigar_col, min_intron)
    return (F.size(ex) > 1) & (ex[0]["e"] - ex[0]["s"] >= overhang) & (F.element_at(ex, -1)["e"] - F.element_at(ex, -1)["s"] >= overhang)


def of_alignments(sam: DataFrame, min_intron: int = 68) -> DataFrame:
    """(qname, chrom, l, r, left_size, right_size, unique): one row an intron, half-open [l, r)."""
    ex = cigar.exons("pos", "cigar", min_intron)
    rows = sam.where(~cigar.has_flag("flag", 4)).select("qname", F.col("rname").alias("chrom"), ex.alias("x"), (F.coalesce(F.col("tags")["NH"]["value"], F.lit("1")) == "1").alias("unique"))
    j = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.struct(F.element_at("x", i)["e"].alias("l"), F.element_at("x", i + 1)["s"].alias("r"), (F.element_at("x", i)["e"] - F.element_at("x", i)["s"]).alias("left_size"), (F.element_at("x", i + 1)["e"] - F.element_at("x", i + 1)["s"]).alias("right_size")))
    return rows.where(F.size("x") > 1).select("qname", "chrom", F.explode(j).alias("j"), "unique").select("qname", "chrom", "j.*", "unique")


def table(junctions: DataFrame) -> DataFrame:
    """(chrom, l, r, reads, positions, width, unique_reads, multi_reads) over the reads of each junction."""
    return junctions.groupBy("chrom", "l", "r").agg(
        F.count_distinct("qname").alias("reads"), F.count_distinct("left_size").alias("positions"), F.max("right_size").alias("width"),
        F.count_distinct(F.when(F.col("unique"), F.col("qname"))).alias("unique_reads"), F.count_distinct(F.when(~F.col("unique"), F.col("qname"))).alias("multi_reads"),
    )


def stranded(junctions: DataFrame, reference: DataFrame) -> DataFrame:
    """``junctions`` with ``strand`` from the intron's ends in (chrom, seq): + or - for known sites, else null."""
    d = junctions.join(reference, "chrom")
    a, b = F.upper(F.substr("seq", (F.col("l") + 1).cast("int"), F.lit(2))), F.upper(F.substr("seq", (F.col("r") - 1).cast("int"), F.lit(2)))
    turn = str.maketrans("ACGT", "TGCA")
    strand = F.lit(None).cast("string")
    for x, y in reversed(SITES):
        strand = F.when((a == x) & (b == y), "+").when((a == y.translate(turn)[::-1]) & (b == x.translate(turn)[::-1]), "-").otherwise(strand)
    return d.withColumn("strand", strand).drop("seq")


def supported_reads(sam: DataFrame, min_intron: int = 68, overhang: int = 10, support: int = 2) -> DataFrame:
    """Rows with a junction of enough overhang that at least ``support`` reads have."""
    from ..tables import kept

    # blocks lie alike wherever a record stands, so each alignment string is read once
    ex = cigar.exons(F.lit(1), "cigar", min_intron)
    gap = lambda x, i: F.struct(x["e"].alias("l"), F.get("x", i + 1)["s"].alias("r"), F.least(x["e"] - x["s"], F.get("x", i + 1)["e"] - F.get("x", i + 1)["s"]).alias("least"))
    shapes = sam.where(F.col("cigar").contains("N")).select("cigar").distinct().select("cigar", ex.alias("x")).where(F.size("x") > 1)
    gaps = F.filter(F.transform(F.slice("x", F.lit(1), F.size("x") - 1), gap), lambda g: g["least"] >= overhang)
    shapes = kept(shapes.select("cigar", F.explode(gaps).alias("g")).select("cigar", "g.l", "g.r"), "shapes")
    at = F.col("pos").cast("bigint") - 1
    j = sam.where(~cigar.has_flag("flag", 4)).select("qname", F.col("rname").alias("chrom"), at.alias("at"), "cigar").join(shapes, "cigar").select("qname", "chrom", (F.col("at") + F.col("l")).alias("l"), (F.col("at") + F.col("r")).alias("r"))
    good = j.groupBy("chrom", "l", "r").agg(F.count_distinct("qname").alias("reads")).where(F.col("reads") >= support).select("chrom", "l", "r")
    return sam.join(j.join(good, ["chrom", "l", "r"]).select("qname").distinct(), "qname", "left_semi")


def snapped(junctions: DataFrame, reference: DataFrame, within: int = 10) -> DataFrame:
    """(id, chrom, strand, l, r, nl, nr): each junction moved to the reference junction of its read's strand with the least shift.

    The strand of ``id`` is the one with the greater sum of 1 / (shift + 1) over its junctions, + on a tie.
    """
    width = 2 * within + 1
    a = junctions.select("id", "chrom", "l", "r").withColumn("_bin", F.floor(F.col("l") / width))
    b = reference.select("chrom", F.col("strand").alias("rs"), F.col("l").alias("nl"), F.col("r").alias("nr")).withColumn("_bin", F.explode(F.array(*[F.floor(F.col("nl") / width) + d for d in (-1, 0, 1)])))
    shift = F.abs(F.col("l") - F.col("nl")) + F.abs(F.col("r") - F.col("nr"))
    near = a.join(b, ["chrom", "_bin"]).where((F.abs(F.col("l") - F.col("nl")) <= within) & (F.abs(F.col("r") - F.col("nr")) <= within)).withColumn("shift", shift)
    best = near.groupBy("id", "chrom", "l", "r", "rs").agg(F.min(F.struct("shift", "nl", "nr")).alias("m"))
    votes = best.groupBy("id", "rs").agg(F.sum(1 / (F.col("m.shift") + 1)).alias("v"))
    side = votes.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("v"), "rs"))).where("k = 1").select("id", F.col("rs").alias("strand"))
    moved = best.join(side, "id").where("rs = strand").select("id", "chrom", "l", "r", F.col("m.nl").alias("nl"), F.col("m.nr").alias("nr"))
    return junctions.select("id", "chrom", "l", "r").join(side, "id", "left").join(moved, ["id", "chrom", "l", "r"], "left")


def _slides(seq: str, left: int, right: int, most: int | None) -> tuple[int, int]:
    """Letters by which the cuts at ``left`` and ``right`` of ``seq`` can move down and up together."""
    far = len(seq) if most is None else most
    down = up = 0
    while down < min(far, left, right) and left - down <= len(seq) and right - down <= len(seq) and seq[left - down - 1] == seq[right - down - 1]:
        down += 1
    while up < far and max(left, right) + up < len(seq) and seq[left + up] == seq[right + up]:
        up += 1
    return down, up


def equivalent(sites: DataFrame, reference: DataFrame, most: int | None = None) -> DataFrame:
    """(chrom, l, r, el, er): the junction and those it can slide to while the flanking letters agree, at most ``most`` a side if given."""

    @F.pandas_udf("down long, up long")
    def slides(seq: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_slides(s, int(x), int(y), most) for s, x, y in zip(seq, left, right)], columns=["down", "up"])

    d = sites.join(reference, "chrom").where("seq is not null and l is not null and r is not null")
    moves = F.explode(F.sequence(-F.col("m.down"), F.col("m.up"))).alias("k")
    moved = d.select("chrom", "l", "r", slides("seq", "l", "r").alias("m")).select("chrom", "l", "r", moves)
    return moved.select("chrom", "l", "r", (F.col("l") + F.col("k")).alias("el"), (F.col("r") + F.col("k")).alias("er"))
