"""Gap repair: partial alignments of a read joined at splice sites.

Segments of one read, chromosome and strand chain while the next one starts at most
``max_intron`` behind the end of the one before.  Neighbours in a chain whose query gap
(or overlap) is small are joined at the best pair of cuts near their ends: a known
junction or a splice signal, by priority of the signal, then by least shift, a known
junction first, then by position.  A cut inside an alignment gives up query letters, one
outside it takes letters on; what the query lacks or has twice adds to the shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq
from .junctions import SITES

_TURN = str.maketrans("ACGT", "TGCA")
READ = ["read", "chrom", "strand"]


def chained(segments: DataFrame, max_intron: int = 100_000) -> DataFrame:
    """``segments`` (read, chrom, strand, exons, q_s, q_e) with t_s, t_e, ``chain`` and ``k``, their number on the read.

    A read has few segments on one chromosome, so a read is one window.
    """
    rows = segments.withColumn("t_s", F.get("exons", F.lit(0))["s"]).withColumn("t_e", F.try_element_at("exons", F.lit(-1))["e"])
    order = W.partitionBy(*READ).orderBy("t_s", "t_e", "q_s", "q_e")
    new = F.coalesce((F.col("t_s") > F.lag("t_e").over(order) + max_intron).cast("long"), F.lit(0))
    rows = rows.withColumns({"new": new, "k": F.row_number().over(order)})
    return rows.withColumn("chain", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def joints(rows: DataFrame, max_gap: int = 10) -> DataFrame:
    """(read, chrom, strand, k, left_s, l, r, right_e, q_l, q_r): neighbours of one chain whose query ends are near enough; ``k`` is the left one."""
    order = W.partitionBy(*READ, "chain").orderBy("k")
    ahead = {c: F.lead(x).over(order) for c, x in (("r", "t_s"), ("right_e", "t_e"), ("q_r", "q_s"))}
    met = rows.withColumns(ahead).where(F.col("q_r").isNotNull() & (F.col("q_e") >= F.col("q_r") - max_gap))
    return met.select(*READ, "k", F.col("t_s").alias("left_s"), F.col("t_e").alias("l"), "r", "right_e", F.col("q_e").alias("q_l"), "q_r")


def shift(a: Column, b: Column, q_l: Column, q_r: Column) -> Column:
    """Shift of cuts ``a`` behind the left end and ``b`` behind the right start: letters lost or doubled and letters taken on."""
    zero = F.lit(0)
    return F.abs(q_r + F.greatest(b, zero) - q_l - F.least(a, zero)) + F.greatest(a, zero) + F.greatest(-b, zero)


def _letters(places: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(chrom, s, e, seq) of the distinct regions in ``places``."""
    regions = places.select(F.col("chrom").alias("name"), "s", "e").distinct().select(F.lit(0).alias("id"), "name", "s", "e")
    return seq.slices(chunks, regions, size).select(F.col("name").alias("chrom"), "s", "e", F.upper("seq").alias("seq"))


def _hits(window: str, start: str, pair: Column, reach: int) -> Column:
    """Offsets from ``start`` in the window at which the two letters stand."""
    places = F.sequence(F.lit(0), F.lit(2 * reach))
    return F.filter(places, lambda i: F.substr(F.col(window), (i + 1 - F.col(start)).cast("int"), F.lit(2)) == pair)


def cuts(found: DataFrame, chunks: DataFrame, size: int = 1 << 16, known: DataFrame | None = None, reach: int = 10, search: int = 10, min_intron: int = 68) -> DataFrame:
    """(read, chrom, strand, k, cut_l, cut_r, signal, known, shift): the best cuts of each joint that has any.

    ``chunks`` (name, chunk, seq) is the chunked reference, ``known`` (chrom, l, r) has junctions that are given.  Both ends move
    at most ``reach``, and the whole shift stays below ``search``.  Only the letters around the joints are read.
    """
    zero = F.lit(0).cast("long")
    spots = found.withColumns({"ls": F.greatest(F.col("l") - reach, zero), "le": F.col("l") + reach + 2, "rs": F.greatest(F.col("r") - reach - 2, zero), "re": F.col("r") + reach})
    letters = _letters(spots.select("chrom", F.col("ls").alias("s"), F.col("le").alias("e")).unionByName(spots.select("chrom", F.col("rs").alias("s"), F.col("re").alias("e"))), chunks, size)
    near = spots.join(letters.withColumnsRenamed({"s": "ls", "e": "le", "seq": "left_seq"}), ["chrom", "ls", "le"]).join(letters.withColumnsRenamed({"s": "rs", "e": "re", "seq": "right_seq"}), ["chrom", "rs", "re"])
    signals = []
    for n, (donor, acceptor) in enumerate(SITES):
        minus = F.col("strand") == "-"
        first, last = F.when(minus, acceptor.translate(_TURN)[::-1]).otherwise(donor), F.when(minus, donor.translate(_TURN)[::-1]).otherwise(acceptor)
        signals.append(F.struct(F.lit(n).alias("signal"), first.alias("first"), last.alias("last")))
    near = near.withColumns({"before": F.col("ls") - (F.col("l") - reach), "behind": F.col("rs") - (F.col("r") - reach - 2)}).withColumn("x", F.explode(F.array(*signals)))
    near = near.withColumn("a", F.explode(_hits("left_seq", "before", F.col("x.first"), reach))).withColumn("b", F.explode(_hits("right_seq", "behind", F.col("x.last"), reach)))
    base = [*READ, "k", "l", "r", "left_s", "right_e", "q_l", "q_r"]
    # the acceptor's two letters end where the right part starts
    every = near.select(*base, (F.col("a") - reach).alias("a"), (F.col("b") - reach).alias("b"), "x.signal", F.lit(1).alias("given"))
    if known is not None:
        width = 2 * reach + 1
        spot = known.select("chrom", F.col("l").alias("kl"), F.col("r").alias("kr"), F.explode(F.array(*[F.floor(F.col("l") / width) + d for d in (-1, 0, 1)])).alias("bin")).distinct()
        met = found.withColumn("bin", F.floor(F.col("l") / width)).join(spot, ["chrom", "bin"]).where((F.abs(F.col("kl") - F.col("l")) <= reach) & (F.abs(F.col("kr") - F.col("r")) <= reach))
        every = every.unionByName(met.select(*base, (F.col("kl") - F.col("l")).alias("a"), (F.col("kr") - F.col("r")).alias("b"), F.lit(0).alias("signal"), F.lit(0).alias("given")))
    every = every.withColumns({"shift": shift(F.col("a"), F.col("b"), F.col("q_l"), F.col("q_r")), "cut_l": F.col("l") + F.col("a"), "cut_r": F.col("r") + F.col("b")})
    every = every.where((F.col("shift") < search) & (F.col("cut_r") - F.col("cut_l") >= min_intron) & (F.col("cut_l") > F.col("left_s")) & (F.col("cut_r") < F.col("right_e")))
    best = every.groupBy(*READ, "k").agg(F.min(F.struct("signal", "shift", "given", "cut_l", "cut_r")).alias("m"))
    return best.select(*READ, "k", "m.cut_l", "m.cut_r", F.when(F.col("m.given") == 1, F.col("m.signal")).alias("signal"), (F.col("m.given") == 0).alias("known"), "m.shift")


def stitched(segments: DataFrame, chunks: DataFrame, size: int = 1 << 16, known: DataFrame | None = None, max_intron: int = 100_000, max_gap: int = 10, reach: int = 10, search: int = 10, min_intron: int = 68) -> DataFrame:
    """(read, chrom, strand, part, n, q_s, q_e, exons): the segments of each read, joined where their gaps have cuts; ``n`` segments make a part."""
    rows = chained(segments, max_intron)
    best = cuts(joints(rows, max_gap), chunks, size, known, reach, search, min_intron)
    right = best.select(*READ, "k", "cut_l")
    left = best.select(*READ, (F.col("k") + 1).alias("k"), "cut_r")
    rows = rows.join(right, [*READ, "k"], "left").join(left, [*READ, "k"], "left")
    cut = F.transform("exons", lambda x: F.struct(F.when(x["s"] == F.col("t_s"), F.coalesce("cut_r", x["s"])).otherwise(x["s"]).alias("s"), F.when(x["e"] == F.col("t_e"), F.coalesce("cut_l", x["e"])).otherwise(x["e"]).alias("e")))
    # exons that a cut leaves without bases go; the cut then bounds the next one
    cut = F.filter(cut, lambda x: x["s"] < x["e"])
    order = W.partitionBy(*READ).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"part": F.sum(F.col("cut_r").isNull().cast("long")).over(order), "exons": cut})
    made = rows.groupBy(*READ, "part").agg(F.count("*").alias("n"), F.min("q_s").alias("q_s"), F.max("q_e").alias("q_e"), F.array_sort(F.collect_list(F.struct("k", "exons"))).alias("x"))
    return made.select(*READ, "part", "n", "q_s", "q_e", F.flatten(F.transform("x", lambda x: x["exons"])).alias("exons"))
