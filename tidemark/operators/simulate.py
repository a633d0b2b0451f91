"""Seeded simulation: every draw is a hash of the seed and the record, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return h / float(2**53)


def emit(transcripts: DataFrame, weight: str, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """(draw, id): ``n`` draws of transcripts by weight, a join of draws with cumulative weights on coarse bins."""
    total = transcripts.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return transcripts.sparkSession.createDataFrame([], f"draw long, {id_col} {dict(transcripts.dtypes)[id_col]}")
    bins = 4096
    rows = transcripts.where(F.col(weight) > 0).select(id_col, F.col(weight).cast("double").alias("_w"), F.pmod(F.xxhash64(id_col), F.lit(64)).alias("_bin"))
    cum = running(rows.withColumn("_one", F.lit(1)), ["_one"], "_bin", [id_col], "_w", "sum", "hi").withColumn("lo", F.col("hi") - F.col("_w"))
    edge = lambda c: F.least(F.floor(c / total * bins), F.lit(bins - 1))
    cum = cum.withColumn("b", F.explode(F.sequence(edge(F.col("lo")), edge(F.col("hi"))))).select(id_col, "lo", "hi", "b")
    draws = transcripts.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(seed, F.col("id")) * total).alias("u")).withColumn("b", edge(F.col("u")))
    return draws.join(cum, "b").where("u >= lo AND u < hi").select("draw", id_col)


def tiled_reads(seqs: DataFrame, size: int, coverage: float, seed: int, id_col: str = "id") -> DataFrame:
    """(id, k, start, read): sub-reads of ``size`` at hash-drawn starts, about ``coverage`` times the sequence."""
    n = F.ceil(F.length("seq") * coverage / size).cast("int")
    rows = seqs.where(F.length("seq") >= size).withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    start = F.floor(uniform(seed, id_col, "k") * (F.length("seq") - size + 1)).cast("int")
    return rows.withColumn("start", start).select(id_col, "k", "start", F.substr(F.col("seq"), F.col("start") + 1, F.lit(size)).alias("read"))


def with_errors(reads: DataFrame, rate: float, seed: int, seq_col: str = "read", mix: tuple[int, int, int] = (3, 1, 1)) -> DataFrame:
    """``reads`` with ``observed``: each letter changed at ``rate``; mismatch : insertion : deletion as in ``mix``."""
    schema = reads.schema
    cut = np.cumsum(mix) / sum(mix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for s in pdf[seq_col]:
                if s is None:
                    out.append(None)
                    continue
                rnd = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{s}".encode()).digest()[:8], "little"))
                hit, kind, letter = rnd.random(len(s)) < rate, np.searchsorted(cut, rnd.random(len(s)), "right"), rnd.integers(0, 4, len(s))
                parts = []
                for c, h, k, x in zip(s, hit, kind, letter):
                    new = "ACGT"[x]
                    parts.append(c if not h else ("CGTA"["ACGT".find(c)] if new == c and c in "ACGT" else new) if k == 0 else c + new if k == 1 else "")
                out.append("".join(parts))
            yield pdf.assign(observed=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return reads.mapInPandas(run, f"{fields}, observed string")


def haplotypes(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """(chrom, left, right): the reference (chrom, seq) with phased single-letter variants (chrom, pos 1-based, ref, alt, gt ``a|b``)."""
    one = variants.where(F.col("gt").rlike(r"^[01]\|[01]$") & (F.length("ref") == 1) & (F.length("alt") == 1))
    by = one.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("pos", "alt", "gt"))).alias("v"))

    def side(n: int) -> Column:
        use = F.filter(F.coalesce("v", F.array().cast("array<struct<pos:bigint,alt:string,gt:string>>")), lambda x: F.substring(x["gt"], n, 1) == "1")
        return F.aggregate(use, F.col("seq"), lambda s, x: F.overlay(s, x["alt"], x["pos"].cast("int"), F.lit(1)))

    return reference.join(by, "chrom", "left").select("chrom", side(1).alias("left"), side(3).alias("right"))


def fusions(genes: DataFrame, n: int, seed: int) -> DataFrame:
    """(k, left_id, right_id): pairs of different genes drawn by hash order, each gene in one pair at most."""
    ranked = genes.select("id", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "id").limit(2 * n)
    from pyspark.sql import Window as W

    numbered = ranked.withColumn("r", F.row_number().over(W.orderBy("h", "id")) - 1).withColumn("k", F.floor(F.col("r") / 2))
    return numbered.groupBy("k").agg(F.min_by("id", "r").alias("left_id"), F.max_by("id", "r").alias("right_id"), F.count("*").alias("c")).where("c = 2").drop("c")


def allele_reads(transcripts: DataFrame, haplotypes_: DataFrame, weight: str, rho: str, n: int, seed: int) -> DataFrame:
    """(draw, id, allele, seq): transcripts (id, chrom, strand, exons, weight, rho) drawn by weight, each from the left
    haplotype with probability ``rho`` of its own, spliced from (chrom, left, right)."""
    from . import transcripts as tr

    drawn = emit(transcripts, weight, n, seed).join(transcripts.select("id", F.col(rho).alias("_rho")), "id")
    side = drawn.select("draw", "id", F.when(uniform(seed + 1, "draw") < F.col("_rho"), "left").otherwise("right").alias("allele"))
    both = None
    for name in ("left", "right"):
        one = tr.spliced(transcripts, haplotypes_.select("chrom", F.col(name).alias("seq"))).withColumn("allele", F.lit(name))
        both = one if both is None else both.unionByName(one)
    return side.join(both, ["id", "allele"]).select("draw", "id", "allele", "seq")


def fragments(seqs: DataFrame, mean: float, sd: float, least: int, seed: int, id_col: str = "draw") -> DataFrame:
    """``seqs`` (id, seq) with ``start`` and ``fragment``: a Gaussian length (at least ``least``) cut at a uniform place."""
    u1, u2 = uniform(seed, id_col), uniform(seed + 1, id_col)
    gauss = F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * F.lit(3.141592653589793) * u2)
    size = F.least(F.greatest(F.round(F.lit(mean) + gauss * sd), F.lit(least)).cast("int"), F.length("seq"))
    rows = seqs.withColumn("_n", size)
    start = F.floor(uniform(seed + 2, id_col) * (F.length("seq") - F.col("_n") + 1)).cast("int")
    return rows.withColumn("start", start).withColumn("fragment", F.substr(F.col("seq"), F.col("start") + 1, F.col("_n"))).drop("_n")


def mates(fragments_: DataFrame, size: int) -> DataFrame:
    """``fragments_`` with ``left`` and ``right``: mates of ``size`` from both ends, the right one turned, short ones padded with N."""
    from ..functions import seq

    right = F.expr(f"right(fragment, {size})")
    return fragments_.withColumn("left", seq.pad_to(F.substring("fragment", 1, size), size)).withColumn("right", seq.pad_to(seq.reverse_complement(right), size))


def quality_errors(reads: DataFrame, seq_col: str, qual_col: str, key: str, seed: int = 1, kind: str = "S") -> DataFrame:
    """``reads`` with substitutions in ``seq_col``: each base errs with the probability that its quality character states.

    Draws are md5 hashes of (seed, key, position), so a read errs alike in every run; another base takes the place.
    """
    from ..functions import quality

    letters, codes = F.split(F.col(seq_col), ""), quality.codes(qual_col)

    def erred(c, i):
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
        draw = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / float(2**32)
        others = F.replace(F.lit("ACGT"), c, F.lit(""))
        pick = F.substr(others, (F.conv(F.substring(h, 9, 4), 16, 10).cast("bigint") % F.length(others) + 1).cast("int"), F.lit(1))
        return F.when(draw < quality.error_probability(F.get(codes, i), kind), pick).otherwise(c)

    return reads.withColumn(seq_col, F.concat_ws("", F.transform(F.filter(letters, lambda c: c != ""), erred)))
