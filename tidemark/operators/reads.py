"""Read sets, error profiles and consensus correction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar
from . import select


def tiered_set(tiers: list[DataFrame], key: str, size: str, one_of: list[bool]) -> DataFrame:
    """Reads of the tiers in order: each adds the keys not seen in earlier ones; where ``one_of``, only the longest read of a key."""
    out = None
    for df, one in zip(tiers, one_of):
        rows = select.best(df, [key], [F.desc(size), F.col("name")]) if one else df
        fresh = rows if out is None else rows.join(out.select(key).distinct(), key, "left_anti")
        out = fresh if out is None else out.unionByName(fresh)
    return out


def full_or_corrected(full: DataFrame, corrected: DataFrame, key: str, share: float) -> DataFrame:
    """(key, seq, used): the full read where it is longer than the corrected one but not by more than ``share`` allows."""
    both = corrected.select(key, F.col("seq").alias("c")).join(full.select(key, F.col("seq").alias("f")), key, "left")
    use = F.col("f").isNotNull() & (F.length("f") >= F.length("c")) & (F.length("f") * share <= F.length("c"))
    return both.select(key, F.when(use, F.col("f")).otherwise(F.col("c")).alias("seq"), F.when(use, "full").otherwise("corrected").alias("used"))


def with_primary(sam: DataFrame) -> DataFrame:
    """Exactly one primary alignment of each (qname, mate): the flagged one, else the longest; the others get bit 256."""
    mate = F.when(cigar.has_flag("flag", 64), 1).when(cigar.has_flag("flag", 128), 2).otherwise(0)
    rows = sam.withColumn("_mate", mate)
    w = W.partitionBy("qname", "_mate").orderBy(F.when(cigar.is_primary("flag"), 0).otherwise(1), F.desc(cigar.coverage("cigar")), "rname", "pos", "cigar")
    first = F.row_number().over(w) == 1
    flag = F.when(first, F.col("flag").bitwiseAND(~2304 & 0xFFFF)).when(cigar.is_primary("flag"), F.col("flag").bitwiseOR(256)).otherwise(F.col("flag"))
    return rows.withColumn("_flag", flag).withColumn("flag", F.col("_flag").cast("int")).drop("_flag", "_mate")


def joined_mates(sam: DataFrame, most: int = 100_000) -> DataFrame:
    """(qname, rname, s, e, blocks): proper mates on one chromosome joined into one alignment, blocks merged in order."""
    ex = cigar.exons("pos", "cigar")
    rows = sam.where(~cigar.has_flag("flag", 4) & cigar.is_primary("flag")).select("qname", "rname", cigar.has_flag("flag", 64).alias("first"), cigar.has_flag("flag", 16).alias("minus"), ex.alias("x"))
    a, b = rows.where("first"), rows.where("NOT first").select("qname", "rname", F.col("minus").alias("m2"), F.col("x").alias("x2"))
    met = a.join(b, ["qname", "rname"]).where("minus <> m2")
    s, e = F.least(F.col("x")[0]["s"], F.col("x2")[0]["s"]), F.greatest(F.element_at("x", -1)["e"], F.element_at("x2", -1)["e"])
    from . import transcripts as tr

    blocks = tr.smooth(F.array_sort(F.concat("x", "x2")), 1)
    return met.select("qname", "rname", s.alias("s"), e.alias("e"), blocks.alias("blocks")).where(F.col("e") - F.col("s") <= most)


def split_mates(fastq: DataFrame, size: int) -> DataFrame:
    """(mate 1 or 2, name, seq, qual): records that hold two mates of ``size`` letters one after the other, cut apart.

    A ``length=`` in the name is set to the mate's.  A record of any other size is an error, as its mates cannot be told.
    """
    fits = (F.length("seq") == 2 * size) & (F.length("qual") == 2 * size)
    name = F.when(fits, F.regexp_replace("name", r"(\slength\s*=\s*)\d+", "$1%d" % size)).otherwise(F.raise_error(F.concat(F.lit("not two mates of the given size: "), F.col("name"))))
    half = lambda c, k: F.substr(F.col(c), F.lit(1 + k * size), F.lit(size)).alias(c)
    both = F.array(*(F.struct(F.lit(k + 1).alias("mate"), half("seq", k), half("qual", k)) for k in (0, 1)))
    return fastq.select(name.alias("name"), F.explode(both).alias("x")).select("x.mate", "name", "x.seq", "x.qual")


def error_profile(columns: DataFrame) -> DataFrame:
    """(before, after, ref, base, n): counts of observed bases by reference base and its neighbours.

    ``columns``: (id, i, kind, base, ref) alignment columns in order; insertions have no reference base.
    """
    w = W.partitionBy("id").orderBy("i")
    rows = columns.where("ref <> ''").withColumn("before", F.lag("ref").over(w)).withColumn("after", F.lead("ref").over(w))
    return rows.where("before IS NOT NULL AND after IS NOT NULL").groupBy("before", "after", "ref", "base").agg(F.count("*").alias("n"))


def error_rates(columns: DataFrame, counted: bool = False) -> DataFrame:
    """(kind, n, rate) over all alignment columns, or over the counts ``n`` of them."""
    by = columns.groupBy("kind").agg((F.sum("n") if counted else F.count("*")).alias("n"))  # a handful of kinds
    return by.select("kind", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("rate"))


def voted(votes: DataFrame) -> DataFrame:
    """(id, pos, base, weight): the candidate with the greatest summed weight at each position, ties to the least base."""
    by = votes.groupBy("id", "pos", "base").agg(F.sum("weight").alias("weight"))
    top = by.groupBy("id", "pos").agg(F.min(F.struct((-F.col("weight")).alias("k"), "base", "weight")).alias("m"))
    return top.select("id", "pos", "m.base", "m.weight")


def corrected(reads: DataFrame, votes: DataFrame) -> DataFrame:
    """(id, seq): reads with each voted position replaced by the winning base (an empty one deletes it)."""
    win = voted(votes).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("v"))
    d = reads.join(win, "id", "left")
    letters = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c, i: F.coalesce(F.element_at("v", i), c))
    return d.select("id", F.when(F.col("v").isNull(), F.col("seq")).otherwise(F.concat_ws("", letters)).alias("seq"))


def quality_runs(reads: DataFrame, qual: str, bins: int = 100) -> DataFrame:
    """(bin, code, run, n): run lengths of equal quality letters by relative position."""
    runs = F.regexp_extract_all(F.col(qual), F.lit(r"((.)\2*)"), F.lit(1))
    rows = reads.select(F.length(qual).alias("len"), F.posexplode(runs).alias("k", "run"), runs.alias("_all"))
    before = F.aggregate(F.slice("_all", 1, F.col("k")), F.lit(0), lambda s, r: s + F.length(r))
    return rows.groupBy(F.floor(before * bins / F.col("len")).alias("bin"), F.ascii("run").alias("code"), F.length("run").alias("run")).agg(F.count("*").alias("n"))


def best_by_base(alignments: DataFrame, query: str, least: int = 1, share: float = 0.9) -> DataFrame:
    """(query, id, qs, qe): the query's bases given to the alignment of best quality, as segments of at least ``least`` bases.

    ``alignments``: (query, id, qs, qe, quality).  Alignments left with less than ``share`` of their length lose all of it
    and the bases are given anew.  One query's alignments are few and handled together.
    """
    import pandas as pd

    kinds = dict(alignments.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: (-r.quality, -(r.qe - r.qs), r.id))
        while True:
            cuts = sorted({p for r in rows for p in (r.qs, r.qe)})
            owner = [next((r for r in rows if r.qs <= a and b <= r.qe), None) for a, b in zip(cuts[:-1], cuts[1:])]
            got: dict = {}
            for a, b, r in zip(cuts[:-1], cuts[1:], owner):
                if r is not None:
                    got[r.id] = got.get(r.id, 0) + b - a
            weak = [r for r in rows if got.get(r.id, 0) < share * (r.qe - r.qs)]
            if not weak:
                break
            rows.remove(weak[-1])  # the worst goes first
        out: list = []
        for a, b, r in zip(cuts[:-1], cuts[1:], owner):
            if r is None:
                continue
            if out and out[-1][1] == r.id and out[-1][3] == a:
                out[-1][3] = b
            else:
                out.append([pdf[query].iloc[0], r.id, a, b])
        return pd.DataFrame([x for x in out if x[3] - x[2] >= least], columns=[query, "id", "qs", "qe"])

    return alignments.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, id {kinds['id']}, qs long, qe long")


def covered(reads: DataFrame, share: str, least: float) -> DataFrame:
    """Corrected reads of which at least ``least`` (``share``, 0 to 1) is covered by others."""
    return reads.where(F.col(share) >= least)
