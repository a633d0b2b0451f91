"""Transcripts: rows with ordered exon arrays (array<struct(s, e)>, half-open), compared, smoothed, annotated and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals as iv

MIN_INTRON = 68
_EXONS = "array<struct<s:bigint,e:bigint>>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size(exons: str | Column) -> Column:
    return F.aggregate(_c(exons), F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"])


def smooth(exons: str | Column, gap: int = MIN_INTRON) -> Column:
    """Exons joined over gaps shorter than ``gap``."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] - last["e"] < gap, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(_c(exons).cast(_EXONS), F.array().cast(_EXONS), step)


def junctions(exons: str | Column) -> Column:
    """array<struct(l, r)>: end of each exon and start of the next."""
    x = _c(exons)
    return F.when(F.size(x) > 1, F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a["e"].alias("l"), b["s"].alias("r")))).otherwise(F.array().cast("array<struct<l:bigint,r:bigint>>"))


def junction_string(exons: str | Column, chrom: Column) -> Column:
    return F.concat_ws(",", F.transform(junctions(exons), lambda j: F.concat(chrom.cast("string"), F.lit(":"), j["l"].cast("string"), F.lit("-"), j["r"].cast("string"))))


def subset(exons: str | Column, start: int | Column, end: int | Column) -> Column:
    """Exons of the transcript coordinates [start, end)."""
    a, b = (F.lit(v) if isinstance(v, int) else v for v in (start, end))
    zero = F.struct(F.lit(0).cast("bigint").alias("off"), F.array().cast(_EXONS).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        n = x["e"] - x["s"]
        lo, hi = F.greatest(a - acc["off"], F.lit(0)), F.least(b - acc["off"], n)
        part = F.array(F.struct((x["s"] + lo).alias("s"), (x["s"] + hi).alias("e")))
        return F.struct((acc["off"] + n).alias("off"), F.when(lo < hi, F.concat(acc["done"], part)).otherwise(acc["done"]).alias("done"))

    return F.aggregate(_c(exons).cast(_EXONS), zero, step)["done"]


def clip(exons: str | Column, start: Column, end: Column) -> Column:
    """Exons cut to genomic [start, end)."""
    cut = F.transform(_c(exons), lambda x: F.struct(F.greatest(x["s"], start).alias("s"), F.least(x["e"], end).alias("e")))
    return F.filter(cut, lambda x: x["s"] < x["e"])


def contains(exons: str | Column, pos: Column) -> Column:
    return F.exists(_c(exons), lambda x: (x["s"] <= pos) & (pos < x["e"]))


def overlap_bp(a: str | Column, b: str | Column) -> Column:
    """Bases both transcripts have, over all exon pairs."""
    part = lambda x, y: F.greatest(F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]), F.lit(0))
    return F.aggregate(_c(a), F.lit(0).cast("bigint"), lambda n, x: n + F.aggregate(_c(b), F.lit(0).cast("bigint"), lambda m, y: m + part(x, y)))


def intersection(a: str | Column, b: str | Column) -> Column:
    """Exon parts both transcripts have."""
    cut = F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: F.struct(F.greatest(x["s"], y["s"]).alias("s"), F.least(x["e"], y["e"]).alias("e")))))
    return F.array_sort(F.filter(cut, lambda x: x["s"] < x["e"]))


def junctions_match(a: str | Column, b: str | Column, tolerance: int = 0) -> Column:
    """As many junctions in both, each within ``tolerance`` of its counterpart at both ends."""
    ja, jb = junctions(a), junctions(b)
    near = F.zip_with(ja, jb, lambda x, y: (F.abs(x["l"] - y["l"]) <= tolerance) & (F.abs(x["r"] - y["r"]) <= tolerance))
    return (F.size(ja) == F.size(jb)) & F.forall(near, lambda x: x)


def matching_exons(a: str | Column, b: str | Column, min_bp: int = 1) -> Column:
    """Exons of a that share at least ``min_bp`` with an exon of b, as a string of 0 and 1."""
    hit = F.transform(_c(a), lambda x: F.exists(_c(b), lambda y: F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]) >= min_bp))
    return F.concat_ws("", F.transform(hit, lambda h: F.when(h, F.lit("1")).otherwise(F.lit("0"))))


def longest_run(flags: Column) -> Column:
    """Longest run of 1 in a string of 0 and 1: consecutive exons."""
    return F.array_max(F.transform(F.split(flags, "0"), lambda r: F.length(r)))


def from_intervals(rows: DataFrame, keys: list[str], gap: int = 0, width: int = 0) -> DataFrame:
    """(keys, exons): intervals merged and gathered in order; ``width`` is for keys with very many intervals."""
    merged = iv.merge(rows, keys, gap=gap, width=width)
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))


def annotate(reads: DataFrame, refs: DataFrame, min_bp: int = 1, width: int = iv.BIN) -> DataFrame:
    """Best reference of each read: a_id, b_id, bp, consecutive, n_match, fraction, full.

    Candidates share an exon base (a binned range join on exons, summed per pair);
    ranked by full match, consecutive exons, matching exons, bases, then reference id.
    """
    ex = lambda d: d.select("id", "chrom", F.explode("exons").alias("x")).select("id", "chrom", "x.s", "x.e")
    met = iv.overlap_join(ex(reads), ex(refs), width=width).groupBy("a_id", "b_id").agg(F.sum("bp").alias("bp")).where(F.col("bp") >= min_bp)
    a, b = reads.select(F.col("id").alias("a_id"), F.col("exons").alias("ea")), refs.select(F.col("id").alias("b_id"), F.col("exons").alias("eb"))
    got = met.join(a, "a_id").join(b, "b_id")
    flags = matching_exons("ea", "eb")
    got = got.withColumn("consecutive", longest_run(flags)).withColumn("n_match", F.length(F.translate(flags, "0", ""))).withColumn("full", (F.size("ea") == F.size("eb")) & (F.col("n_match") == F.size("ea")))
    got = got.withColumn("fraction", F.round(F.col("bp") / F.greatest(size("ea"), size("eb")), 6))
    w = W.partitionBy("a_id").orderBy(F.desc("full"), F.desc("consecutive"), F.desc("n_match"), F.desc("bp"), "b_id")
    return got.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("a_id", "b_id", "bp", "consecutive", "n_match", "fraction", "full")


def compatible(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Pairs (a_id, b_id) with as many junctions, each within ``tolerance``: multi-exon transcripts on one chromosome.

    They meet on (chrom, number of junctions, bin of the first junction), the right side in the neighbouring bins too.
    """
    width = max(1, 2 * tolerance + 1)

    def keyed(d: DataFrame, p: str) -> DataFrame:
        j = junctions("exons")
        d = d.where(F.size("exons") > 1).select("chrom", F.col("id").alias(f"{p}_id"), F.col("exons").alias(f"{p}_exons"), F.size(j).alias("nj"), j[0]["l"].alias("first"))
        b = F.floor(F.col("first") / width)
        return d.withColumn("bin", F.explode(F.array(b - 1, b, b + 1) if p == "b" else F.array(b))).drop("first")

    return keyed(left, "a").join(keyed(right, "b"), ["chrom", "nj", "bin"]).where(junctions_match("a_exons", "b_exons", tolerance)).select("a_id", "b_id")


def merge_by_junctions(tx: DataFrame) -> DataFrame:
    """(chrom, junctions, s, e, n): transcripts with the same junctions and the bounds of the widest."""
    rows = tx.where(F.size("exons") > 1).select("chrom", junction_string("exons", F.col("chrom")).alias("junctions"), F.col("exons")[0]["s"].alias("s"), F.element_at("exons", -1)["e"].alias("e"))
    return rows.groupBy("chrom", "junctions").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def consensus(members: DataFrame) -> DataFrame:
    """(grp, j, l, r): most frequent left and right end of each junction of a group, ties to the least.

    ``members``: (grp, j, l, r), one row per member and junction; counts are folded before they are ranked.
    """

    def most(col: str) -> DataFrame:
        by = members.groupBy("grp", "j", col).agg(F.count("*").alias("n"))
        return by.groupBy("grp", "j").agg(F.max(F.struct("n", (-F.col(col)).alias("v"))).alias("m")).select("grp", "j", (-F.col("m.v")).alias(col))

    return most("l").join(most("r"), ["grp", "j"])


def correct_junctions(long: DataFrame, short: DataFrame, within: int, evidence: int = 1) -> DataFrame:
    """(id, l, r, nl, nr): long-read junctions moved to the best supported short junction within ``within`` at both ends, else null.

    ``short``: (chrom, l, r, n) with n supporting reads, at least ``evidence``; ties to the nearest, then the least.
    """
    width = max(1, 2 * within + 1)
    a = long.withColumn("_bin", F.floor(F.col("l") / width))
    b = short.where(F.col("n") >= evidence).select("chrom", F.col("l").alias("nl"), F.col("r").alias("nr"), "n")
    b = b.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("nl") / width) + d for d in (-1, 0, 1)])))
    near = (F.abs(F.col("l") - F.col("nl")) <= within) & (F.abs(F.col("r") - F.col("nr")) <= within)
    off = F.abs(F.col("l") - F.col("nl")) + F.abs(F.col("r") - F.col("nr"))
    best = a.join(b, ["chrom", "_bin"]).where(near).groupBy("id", "chrom", "l", "r").agg(F.min(F.struct((-F.col("n")).alias("k0"), off.alias("k1"), "nl", "nr")).alias("m"))
    return long.join(best, ["id", "chrom", "l", "r"], "left").select("id", "chrom", "l", "r", F.col("m.nl").alias("nl"), F.col("m.nr").alias("nr"))


def unsupported_pairs(tx: DataFrame, refs: DataFrame, within: int = 0) -> DataFrame:
    """(id, l1, r1, l2, r2): neighbouring junction pairs of transcripts that no reference transcript has within ``within``."""

    def pairs(d: DataFrame) -> DataFrame:
        j = junctions("exons")
        two = F.zip_with(F.slice(j, 1, F.size(j) - 1), F.slice(j, 2, F.size(j) - 1), lambda x, y: F.struct(x["l"].alias("l1"), x["r"].alias("r1"), y["l"].alias("l2"), y["r"].alias("r2")))
        return d.where(F.size("exons") > 2).select("id", "chrom", F.explode(two).alias("p")).select("id", "chrom", "p.*")

    width = max(1, 2 * within + 1)
    a, b = pairs(tx).distinct(), pairs(refs).drop("id").distinct()
    wide = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_bin", F.explode(F.array(*[F.floor(F.col("b_l1") / width) + d for d in (-1, 0, 1)])))
    near = [F.abs(F.col(c) - F.col(f"b_{c}")) <= within for c in ("l1", "r1", "l2", "r2")]
    cond = (F.col("chrom") == F.col("b_chrom")) & (F.floor(F.col("l1") / width) == F.col("_bin")) & near[0] & near[1] & near[2] & near[3]
    return a.join(wide, cond, "left_anti")


def spliced(tx: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, seq): exon sequences joined from (chrom, seq), reverse complemented on the minus strand."""
    from ..functions import seq

    pieces = F.transform("exons", lambda x: F.substr(F.col("seq"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")))
    whole = F.concat_ws("", pieces)
    return tx.join(reference, "chrom").select("id", F.when(F.col("strand") == "-", seq.reverse_complement(whole)).otherwise(whole).alias("seq"))


def frames(exons: str | Column) -> Column:
    """Bases to skip at the start of each coding exon until the next codon begins, 0 for the first."""
    start = F.struct(F.lit(0).cast("bigint").alias("f"), F.array().cast("array<bigint>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        n = x["e"] - x["s"]
        return F.struct(((acc["f"] + 3 - n % 3) % 3).alias("f"), F.concat(acc["done"], F.array(acc["f"])).alias("done"))

    return F.aggregate(_c(exons), start, step)["done"]


def to_genomic(exons: str | Column, pos: Column) -> Column:
    """Genomic position of a spliced (or artificial reference) position; null beyond the end."""
    zero = F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        n = x["e"] - x["s"]
        inside = (pos >= acc["off"]) & (pos < acc["off"] + n)
        return F.struct((acc["off"] + n).alias("off"), F.when(inside, x["s"] + pos - acc["off"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(_c(exons).cast(_EXONS), zero, step)["at"]


def from_genomic(exons: str | Column, pos: Column) -> Column:
    """Spliced position of a genomic one; null in introns and outside."""
    before = F.aggregate(_c(exons), F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(F.least(pos, x["e"]) - x["s"], F.lit(0)))
    return F.when(contains(exons, pos), before)


def lifted(rows: DataFrame, refs: DataFrame, max_intron: int = 400_000) -> DataFrame:
    """(id, chrom, exons): intervals (id, ref, s, e) on spliced references moved to the genome, split at their introns.

    ``refs``: (ref, chrom, exons).  Rows whose introns exceed ``max_intron`` are dropped.
    """
    d = rows.join(refs, "ref").withColumn("exons", subset("exons", F.col("s"), F.col("e"))).where(F.size("exons") > 0)
    gaps = F.transform(junctions("exons"), lambda j: j["r"] - j["l"])
    return d.where(F.forall(gaps, lambda g: g <= max_intron)).select("id", "chrom", "exons")


def base_scores(exons: DataFrame, counts: DataFrame, width: int = iv.BIN) -> DataFrame:
    """(tx, n, mean_score, median_score, n_zero, n_multi, n_single): 1 / count over a transcript's bases.

    ``counts``: (chrom, s, e, n).  Scores below 0.01 count as zero, up to 0.5 as multi, above as single; bases meet the
    count table by range, and each (transcript, count) is folded with its number of bases before anything is ranked.
    """
    met = iv.overlap_join(exons, counts, width=width)
    score = F.when(F.col("b_n") == 0, F.lit(1e-7)).otherwise(1 / F.col("b_n"))
    by = met.groupBy(F.col("a_tx").alias("tx"), score.alias("score")).agg(F.sum("bp").alias("bp"))
    w = W.partitionBy("tx")
    run = by.withColumn("hi", F.sum("bp").over(w.orderBy("score"))).withColumn("all", F.sum("bp").over(w))
    at = lambda k: F.min(F.when(F.col("hi") > k, F.col("score")))
    half = F.floor(F.col("all") / 2)
    out = run.groupBy("tx").agg(
        F.first("all").alias("n"), F.round(F.sum(F.col("score") * F.col("bp")) / F.first("all"), 4).alias("mean_score"), F.round((at(half) + at(F.floor((F.col("all") - 1) / 2))) / 2, 4).alias("median_score"),
        F.sum(F.when(F.col("score") < 0.01, F.col("bp")).otherwise(0)).alias("n_zero"), F.sum(F.when((F.col("score") >= 0.01) & (F.col("score") <= 0.5), F.col("bp")).otherwise(0)).alias("n_multi"), F.sum(F.when(F.col("score") > 0.5, F.col("bp")).otherwise(0)).alias("n_single"),
    )
    return out


def annotation_rates(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(n, annotated, tx_full, tx_partial, gene) counts of simulated reads (read, tx, gene) against annotations (read, tx, gene, full)."""
    d = truth.select("read", F.col("tx").alias("t0"), F.col("gene").alias("g0")).join(found, "read", "left")
    tx = F.col("t0") == F.col("tx")
    return d.agg(F.count("*").alias("n"), F.count("tx").alias("annotated"), F.count_if(tx & F.col("full")).alias("tx_full"), F.count_if(tx & ~F.col("full")).alias("tx_partial"), F.count_if(F.col("g0") == F.col("gene")).alias("gene"))
