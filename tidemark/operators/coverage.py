"""Coverage of transcripts and regions by depth tables (chrom, s, e, depth)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq
from ..tables import kept
from . import intervals as iv
from .running import HOT, dealt, running
from .stats import strata_by_cut


def transcript_depth(exons: DataFrame, depth: DataFrame, min_depth: int = 1, width: int = iv.BIN) -> DataFrame:
    """(tx, length, covered, mean_depth, fraction): exons are (tx, chrom, s, e); fraction has at least ``min_depth``."""
    size = exons.groupBy("tx").agg(F.sum(F.col("e") - F.col("s")).alias("length"))
    met = iv.overlap_join(exons, depth, width=width)
    got = met.groupBy(F.col("a_tx").alias("tx")).agg(F.sum("bp").alias("covered"), F.sum(F.col("bp") * F.col("b_depth")).alias("_sum"), F.sum(F.when(F.col("b_depth") >= min_depth, F.col("bp")).otherwise(0)).alias("_deep"))
    zero = F.lit(0)
    return size.join(got, "tx", "left").select("tx", "length", F.coalesce("covered", zero).alias("covered"), F.round(F.coalesce("_sum", zero) / F.col("length"), 6).alias("mean_depth"), F.round(F.coalesce("_deep", zero) / F.col("length"), 6).alias("fraction"))


def bias_bins(exons: DataFrame, depth: DataFrame, bins: int = 100, min_length: int = 1, min_depth: float = 0.0, width: int = iv.BIN) -> DataFrame:
    """(tx, bin, value): depth summed over equal bins along the transcript from its 5' end, as share of the tallest bin.

    Exons carry (tx, chrom, s, e, strand, off): ``off`` is the exon's start in transcript coordinates and all rows the
    transcript's ``length``; minus strands are turned around.
    """
    met = iv.overlap_join(exons.where(F.col("length") >= min_length), depth, width=width)
    start = F.col("a_off") + F.greatest("a_s", "b_s") - F.col("a_s")
    pos = F.explode(F.sequence(start, start + F.col("bp") - 1))
    base = met.select(F.col("a_tx").alias("tx"), F.col("a_strand").alias("strand"), F.col("a_length").alias("length"), F.col("b_depth").alias("depth"), pos.alias("p"))
    along = F.when(F.col("strand") == "-", F.col("length") - 1 - F.col("p")).otherwise(F.col("p"))
    by = base.groupBy("tx", "length", F.floor(along * bins / F.col("length")).alias("bin")).agg(F.sum("depth").alias("total"))
    per = by.groupBy("tx").agg(F.max("total").alias("tallest"), F.sum("total").alias("all"), F.first("length").alias("len")).where(F.col("all") / F.col("len") >= min_depth)
    return by.join(per, "tx").select("tx", "bin", F.round(F.col("total") / F.col("tallest"), 6).alias("value"))


def overlap_bias(a: DataFrame, b: DataFrame, thresholds: list[int], width: int = iv.BIN) -> DataFrame:
    """(ta, tb <= ta, size_a, overlap, bias): bases of a at depth >= ta, those shared with b at depth >= tb, 1 - share.

    One join of the depth tables; each pair of depths then counts for all thresholds below it.
    """
    ts = F.array(*[F.lit(t) for t in thresholds])
    size = a.withColumn("ta", F.explode(ts)).where("depth >= ta").groupBy("ta").agg(F.sum(F.col("e") - F.col("s")).alias("size_a"))
    cells = iv.overlap_join(a, b, width=width).groupBy("a_depth", "b_depth").agg(F.sum("bp").alias("bp"))
    met = cells.withColumn("ta", F.explode(ts)).withColumn("tb", F.explode(ts)).where("a_depth >= ta AND b_depth >= tb AND tb <= ta").groupBy("ta", "tb").agg(F.sum("bp").alias("overlap"))
    grid = a.sparkSession.createDataFrame([(x, y) for x in thresholds for y in thresholds if y <= x], "ta int, tb int")
    out = grid.join(F.broadcast(size), "ta").join(F.broadcast(met), ["ta", "tb"], "left")
    shared = F.coalesce("overlap", F.lit(0))
    return out.select("ta", "tb", "size_a", shared.alias("overlap"), F.round(1 - shared / F.col("size_a"), 6).alias("bias"))


def gc_bins(windows: DataFrame, gc: Column, bins: int, depth: Column, size: Column) -> DataFrame:
    """(bin, depth, bases): windows by GC bin and depth."""
    b = F.least(F.floor(gc * bins), F.lit(bins - 1)).alias("bin")
    return windows.where(gc.isNotNull()).groupBy(b, depth.alias("depth")).agg(F.sum(size).alias("bases"))


def gc_depth(
    tx: DataFrame, chunks: DataFrame, size: int, bins: int = 20, fragment: int | None = None, least_length: int = 1, min_known: int = 50, best: int | None = None, seed: int = 1, width: int = iv.BIN
) -> DataFrame:
    """(bin, depth, bases): bases by GC bin and the depth of the transcripts (or their fragments) of that bin.

    ``tx``: (id, chrom, exons), ``chunks``: the reference in rows of ``size`` letters (`functions.seq.chunked`).  With
    ``fragment`` transcripts are cut into pieces of so many bases and the shorter rest falls off at the end or at the start, by
    a hash of seed and id; otherwise whole transcripts of ``least_length`` count.  Pieces with fewer than ``min_known`` letters
    other than N do not.  ``best`` keeps the bases that all pieces together cover deepest: depths from the greatest down while
    they hold at most the last of 10, 50, 100, 500, ... bases that is not above ``best``.

    Letters are counted chunk by chunk, so neither a transcript's sequence nor a chromosome is ever put together.
    """
    exon = W.partitionBy("id").orderBy("s")  # exons of one transcript
    ex = tx.select("id", "chrom", F.explode("exons").alias("x")).select("id", "chrom", "x.s", "x.e").where("s < e")
    ex = ex.withColumn("end", F.sum(F.col("e") - F.col("s")).over(exon.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum(F.col("e") - F.col("s")).over(W.partitionBy("id")))
    ex = ex.withColumn("off", F.col("end") - (F.col("e") - F.col("s")))
    if fragment:
        early = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 1) < "8"
        ex = ex.withColumn("o", F.when(early, F.col("n") % fragment).otherwise(0)).withColumn("m", F.floor(F.col("n") / fragment))
        k = F.sequence(F.greatest(F.floor((F.col("off") - F.col("o")) / fragment), F.lit(0)), F.least(F.floor((F.col("end") - 1 - F.col("o")) / fragment), F.col("m") - 1))
        ex = ex.where("m > 0 AND end > o AND off < o + m * %d" % fragment).withColumn("k", F.explode(k))
        at = F.col("o") + F.col("k") * fragment
        lo, hi = F.greatest(at - F.col("off"), F.lit(0)), F.least(at + fragment - F.col("off"), F.col("e") - F.col("s"))
        parts = ex.select("id", "k", "chrom", (F.col("s") + lo).alias("s"), (F.col("s") + hi).alias("e"))
    else:
        parts = ex.where(F.col("n") >= least_length).select("id", F.lit(0).cast("long").alias("k"), "chrom", "s", "e")
    parts = kept(parts, "parts")
    met = parts.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size)))).join(chunks.withColumnRenamed("name", "chrom"), ["chrom", "chunk"])
    from_, to = F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0)), F.least(F.col("e") - F.col("chunk") * size, F.lit(size))
    letters = met.select("id", "k", F.upper(F.substr("seq", (from_ + 1).cast("int"), (to - from_).cast("int"))).alias("p"))
    by = letters.groupBy("id", "k").agg(F.sum(seq.count_of("p", "GC").cast("long")).alias("gc"), F.sum((F.length("p") - seq.n_count("p")).cast("long")).alias("known"))
    binned = by.where((F.col("known") >= min_known) & (F.col("known") > 0)).select("id", "k", F.least(F.floor(F.col("gc") * bins / F.col("known")), F.lit(bins - 1)).alias("bin"))
    rows = kept(parts.join(binned, ["id", "k"]).select("bin", "chrom", "s", "e"), "binned")
    deep = iv.coverage(rows, ["bin", "chrom"], width=width)
    if best is None:
        return deep.groupBy("bin", "depth").agg(F.sum(F.col("e") - F.col("s")).alias("bases"))
    every = kept(iv.coverage(rows, width=width), "depths")
    top = strata_by_cut(every.withColumn("w", F.col("e") - F.col("s")), "depth", "w", 10).where(F.col("cut") <= best).select("depth")
    top = every.join(top, "depth").select("chrom", "s", "e")
    return iv.overlap_join(deep, top, width=width).groupBy(F.col("a_bin").alias("bin"), F.col("a_depth").alias("depth")).agg(F.sum("bp").alias("bases"))


def background(regions: DataFrame, genes: DataFrame, depth: DataFrame, buffer: int, window: int, width: int = iv.BIN) -> DataFrame:
    """(chrom, s, e, mean_depth) of whole windows of ``regions`` at least ``buffer`` away from any gene."""
    free = iv.subtract(regions, iv.pad(genes, buffer), width=width)
    tiles = iv.tile(free, window).withColumn("id", F.concat_ws(":", "chrom", "s"))
    met = iv.overlap_join(tiles, depth, width=width).groupBy("a_id").agg(F.sum(F.col("bp") * F.col("b_depth")).alias("_sum"))
    return tiles.join(met, tiles.id == met.a_id, "left").select("chrom", "s", "e", F.round(F.coalesce("_sum", F.lit(0)) / window, 6).alias("mean_depth"))


def ladder(reads: DataFrame, join_gap: int = 68, chain_gap: int = 100_000, width: int = iv.BIN) -> DataFrame:
    """(chrom, level, locus, exons): the regions of depth 1, 2, 4, ... and more, as exons and chains of them.

    One sweep gives the depth; a segment then stands on every level up to its depth.  On each level segments up to
    ``join_gap`` apart join into exons, and exons up to ``chain_gap`` apart into chains.  Where no chromosome is hot its rows meet
    once and all of this is done where they are; otherwise they are spread over bins.
    """
    few = dealt(reads.where("s < e").select("chrom", "s", "e"), ["chrom"])
    if few is not None:
        reads, width = few, 0
    written = kept if few is None else lambda df, name: df
    depth = written(iv.coverage(reads, width=width), "depth")
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.log2("depth") + 1e-9).cast("int")), lambda k: F.pow(F.lit(2), k).cast("long"))).alias("level")
    deep = depth.select("chrom", levels, "s", "e")
    exons = written(iv.merge(deep, ["chrom", "level"], join_gap, True, width).drop("n"), "ladder")
    rows = iv.islands(exons, ["chrom", "level"], chain_gap, True, width).withColumnRenamed("island", "locus")
    return rows.groupBy("chrom", "level", "locus").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))


def novel(reads: DataFrame, annotation: DataFrame, join_gap: int = 68, chain_gap: int = 100_000, width: int = iv.BIN) -> DataFrame:
    """``ladder`` of the reads that share no base with the annotation."""
    columns = ["chrom", "s", "e"]
    known = annotation.where("s < e").select(*columns)
    both = dealt(reads.select(*columns, F.lit(None).cast("long").alias("_x")).unionByName(known.select("chrom", "s", F.col("e").alias("_x")), allowMissingColumns=True), ["chrom"])
    if both is None:
        far = iv.overlap_join(reads, iv.merge(known, width=width).drop("n"), how="left_anti", width=width)
    else:
        # the furthest end of the known regions that start before a read's end tells whether one of them meets it
        before = W.partitionBy("chrom").orderBy(F.coalesce(F.when(F.col("_x").isNull(), F.col("e")), "s"), F.col("_x").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
        far = both.withColumn("_reach", F.max("_x").over(before)).where("_x IS NULL AND (_reach IS NULL OR _reach <= s)").select(*columns)
    return ladder(kept(far, "novel"), join_gap, chain_gap, width)


def least_under(ranges: DataFrame, segments: DataFrame, value: str = "depth", width: int = iv.BIN) -> DataFrame:
    """``ranges`` (chrom, s, e, ...) with ``least``: the smallest ``value`` of the segments that share a base with the range.

    Segments (chrom, s, e, value) lie apart and are numbered along the chromosome; a range finds the numbers of its first and last
    one in a running pass, and a table of minima over 1, 2, 4, ... segments answers it with two look-ups, however many segments
    lie under it.  Ranges without one get null.
    """
    place = F.floor(F.col("pos") / width)
    one = segments.select("chrom", F.col("s").alias("pos"), F.col("e").alias("end"), F.col(value).alias("v")).withColumn("_bin", place).withColumn("_one", F.lit(1).cast("long"))
    base = kept(running(one, ["chrom"], "_bin", ["pos"], "_one", "sum", "i").select("chrom", "pos", "end", "i", "v"), "segments")
    spans = kept(ranges.where("s < e").select("chrom", "s", "e").distinct(), "spans")
    marks = spans.select("chrom", F.explode(F.array("s", F.col("e") - 1)).alias("pos")).distinct().select("chrom", "pos", F.lit(1).alias("kind"), F.lit(None).cast("struct<i:bigint,end:bigint>").alias("x"))
    seen = base.select("chrom", "pos", F.lit(0).alias("kind"), F.struct("i", "end").alias("x"))
    told = running(seen.unionByName(marks).withColumn("_bin", place), ["chrom"], "_bin", ["pos", "kind"], "x", "max", "last").where("kind = 1")
    told = kept(told.select("chrom", "pos", "last.i", "last.end"), "marks")
    first = F.when(F.col("end") > F.col("pos"), F.col("i")).otherwise(F.coalesce(F.col("i"), F.lit(0)) + 1)
    spans = spans.join(told.select("chrom", F.col("pos").alias("s"), first.alias("i")), ["chrom", "s"]).join(told.select("chrom", (F.col("pos") + 1).alias("e"), F.col("i").alias("j")), ["chrom", "e"])
    found = least_between(spans, base, ["chrom"]).groupBy("chrom", "s", "e").agg(F.min("least").alias("least"))
    return ranges.join(found, ["chrom", "s", "e"], "left")


def least_between(spans: DataFrame, numbered: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (keys, i, j, ...) where j >= i, with ``least``: the smallest v of the rows (keys, i, v) with the numbers i to j.

    A table of minima over 1, 2, 4, ... rows answers each span with two look-ups; numbers have no gaps within the keys.
    """
    spans = kept(spans.where("j >= i").withColumn("_k", F.floor(F.log2(F.col("j") - F.col("i") + 1) + 1e-9).cast("int")), "spans")
    top = spans.agg(F.max("_k")).first()[0] or 0
    level = numbered.select(*keys, F.col("i").alias("_at"), "v")
    tables = level.withColumn("_k", F.lit(0))
    for k in range(1, top + 1):
        ahead = level.select(*keys, (F.col("_at") - (1 << (k - 1))).alias("_at"), F.col("v").alias("w"))
        level = kept(level.join(ahead, [*keys, "_at"]).select(*keys, "_at", F.least("v", "w").alias("v")), "minima")
        tables = tables.unionByName(level.withColumn("_k", F.lit(k)))
    columns = [c for c in spans.columns if c != "_k"]
    ends = spans.withColumn("_at", F.explode(F.array("i", F.col("j") - F.pow(F.lit(2), F.col("_k")).cast("long") + 1)))
    return ends.join(tables, [*keys, "_at", "_k"]).groupBy(*columns).agg(F.min("v").alias("least"))


def _least_depth(few: DataFrame, hits: DataFrame) -> DataFrame:
    """``few``, the ``hits`` dealt out by chromosome, with ``least``: the smallest depth above 0 under each, weighted by n.

    The ends of all hits are the points between which the depth is one.  Minima over 1, 2, 4, ... points from a point on and up to
    one are windows over a chromosome; a hit takes one of each from its first and its last point, however many lie between.
    """
    longest = hits.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 1
    top = (min(max(longest, 1), 2 * HOT)).bit_length() - 1
    cols = hits.columns
    ends = F.array(F.struct(F.col("s").alias("pos"), F.col("n").cast("long").alias("d"), F.lit(True).alias("opens")), F.struct(F.col("e").alias("pos"), (-F.col("n").cast("long")).alias("d"), F.lit(False).alias("opens")))
    rest = [c for c in cols if c not in ("chrom", "s", "e")]
    spans = few.where("s < e AND chrom IS NOT NULL").groupBy("chrom", "s", "e").agg(F.sum(F.col("n").cast("long")).alias("n"), F.collect_list(F.struct(*rest)).alias("hits"))
    halves = spans.select("chrom", "s", "e", "hits", F.explode(ends).alias("x")).select("chrom", "s", "e", "x.*", F.when(F.col("x.opens"), F.col("hits")).alias("hits"))
    points = halves.groupBy("chrom", "pos").agg(F.sum("d").alias("d"), F.collect_list(F.struct("s", "e", "opens", "hits")).alias("x"))
    along = W.partitionBy("chrom").orderBy("pos")
    points = points.withColumns({"i": F.row_number().over(along), "v0": F.sum("d").over(along.rowsBetween(W.unboundedPreceding, 0))})
    points = points.withColumn("v0", F.when(F.col("v0") >= 1, F.col("v0"))).withColumn("w0", F.lag("v0").over(along))
    for k in range(1, top + 1):  # v from the point on, w up to the point before it
        half = 1 << (k - 1)
        points = points.withColumns({f"v{k}": F.least(f"v{k - 1}", F.lead(f"v{k - 1}", half).over(along)), f"w{k}": F.least(f"w{k - 1}", F.lag(f"w{k - 1}", half).over(along))})
    sides = F.when(F.col("x.opens"), F.array(*[f"v{k}" for k in range(top + 1)])).otherwise(F.array(*[f"w{k}" for k in range(top + 1)])).alias("m")
    told = points.withColumn("x", F.explode("x")).select("chrom", "x.s", "x.e", "x.opens", "x.hits", "i", sides)
    met = told.groupBy("chrom", "s", "e").agg(*[F.max(F.when(F.col("opens") == o, F.struct("i", "m"))).alias(c) for o, c in ((True, "a"), (False, "b"))], F.first("hits", ignorenulls=True).alias("hits"))
    k = F.floor(F.log2(F.col("b.i") - F.col("a.i")) + 1e-9).cast("int")
    found = met.select("chrom", "s", "e", F.least(F.get("a.m", k), F.get("b.m", k)).alias("least"), F.explode("hits").alias("x")).select("chrom", "s", "e", "x.*", "least")
    without = hits.where("NOT coalesce(s < e, false) OR chrom IS NULL").withColumn("least", F.lit(None).cast("long"))
    return found.unionByName(without).select(*cols, "least")


def thinned(hits: DataFrame, threshold: int, seed: int = 1, width: int = iv.BIN) -> DataFrame:
    """(id, chrom, s, e, n, least, kept): hits (id, chrom, s, e, n copies) and how many of their copies stay.

    Where the least depth under a hit is above ``threshold`` each copy stays with a chance of threshold / depth, by a hash of the
    seed, the id and the copy's number; hits without a base have no depth and stay.
    """
    few = dealt(hits, ["chrom"])
    if few is None:
        rows = least_under(hits, iv.coverage(hits, weight="n", width=width), width=width)
    else:
        rows = _least_depth(few, hits)
    copies = F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
    stay = F.size(F.filter(copies, lambda k: draw(k) * F.col("least") < F.lit(threshold * 2**32))).cast("long")
    return rows.withColumn("kept", F.when(F.coalesce("least", F.lit(0)) <= threshold, F.col("n").cast("long")).otherwise(stay))
