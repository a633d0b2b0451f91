"""Block alignments (PSL): coverage, quality, distances, coordinates, trimming and conversion, as Spark columns.

A row has matches, misMatches, qBaseInsert, tBaseInsert, strand, qName, qSize, qStart, qEnd, tName, tSize, tStart, tEnd
and the arrays blockSizes, qStarts, tStarts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cigar as cg
from . import seq

MIN_INTRON = 68


def coverage(sizes: str | Column = "blockSizes") -> Column:
    return F.aggregate(F.col(sizes) if isinstance(sizes, str) else sizes, F.lit(0).cast("bigint"), lambda s, x: s + x)


def quality() -> Column:
    """1 - (mismatches + inserted bases on both sides) / coverage."""
    return 1 - (F.col("misMatches") + F.col("qBaseInsert") + F.col("tBaseInsert")) / coverage()


def query_gap(e1: Column, s2: Column) -> Column:
    """Bases of the query strictly between two alignments in query order; 0 if they touch or overlap."""
    return F.greatest(s2 - e1, F.lit(0))


def region_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def base_overlap(starts1: Column, sizes1: Column, starts2: Column, sizes2: Column) -> Column:
    """Summed overlap of all block pairs."""
    a = F.zip_with(starts1, sizes1, lambda s, n: F.struct(s.alias("s"), (s + n).alias("e")))
    b = F.zip_with(starts2, sizes2, lambda s, n: F.struct(s.alias("s"), (s + n).alias("e")))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(a, zero, lambda t, x: t + F.aggregate(b, zero, lambda u, y: u + F.greatest(F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]), F.lit(0))))


def target_distance(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column) -> Column:
    """Bases strictly between on the target; -1 on different targets, 0 if they overlap."""
    return F.when(c1 != c2, F.lit(-1)).otherwise(F.greatest(s2 - e1, s1 - e2, F.lit(0)))


def target_to_query(pos: Column) -> Column:
    """Query position (alignment strand, from 0) of a target position; null in gaps."""
    blocks = F.arrays_zip("tStarts", "qStarts", "blockSizes")
    hit = F.filter(blocks, lambda b: (b["tStarts"] <= pos) & (pos < b["tStarts"] + b["blockSizes"]))
    return F.when(F.size(hit) > 0, hit[0]["qStarts"] + pos - hit[0]["tStarts"])


def query_to_target(pos: Column) -> Column:
    blocks = F.arrays_zip("tStarts", "qStarts", "blockSizes")
    hit = F.filter(blocks, lambda b: (b["qStarts"] <= pos) & (pos < b["qStarts"] + b["blockSizes"]))
    return F.when(F.size(hit) > 0, hit[0]["tStarts"] + pos - hit[0]["qStarts"])


def actual_query(pos: Column) -> Column:
    """Position on the query's own strand of one on the alignment strand."""
    return F.when(F.col("strand").startswith("-"), F.col("qSize") - 1 - pos).otherwise(pos)


def trimmed(df: DataFrame, start: Column, end: Column, side: str = "t") -> DataFrame:
    """Rows cut to target (``t``) or query (``q``) positions [start, end); rows with nothing left go."""
    key = "tStarts" if side == "t" else "qStarts"
    blocks = F.arrays_zip("tStarts", "qStarts", "blockSizes")

    def cut(b: Column) -> Column:
        lo = F.greatest(start - b[key], F.lit(0))
        hi = F.least(end - b[key], b["blockSizes"])
        return F.struct((b["tStarts"] + lo).alias("t"), (b["qStarts"] + lo).alias("q"), (hi - lo).alias("n"))

    left = df.withColumn("_b", F.filter(F.transform(blocks, cut), lambda b: b["n"] > 0)).where(F.size("_b") > 0)
    last = F.element_at("_b", -1)
    out = left.withColumn("tStarts", F.col("_b")["t"]).withColumn("qStarts", F.col("_b")["q"]).withColumn("blockSizes", F.col("_b")["n"])
    out = out.withColumn("blockCount", F.size("_b")).withColumn("tStart", F.col("_b")[0]["t"]).withColumn("tEnd", last["t"] + last["n"])
    q0, q1 = F.col("_b")[0]["q"], last["q"] + last["n"]
    minus = F.col("strand").startswith("-")
    return out.withColumn("qStart", F.when(minus, F.col("qSize") - q1).otherwise(q0)).withColumn("qEnd", F.when(minus, F.col("qSize") - q0).otherwise(q1)).drop("_b")


def valid() -> Column:
    """Whether counts, arrays and bounds of a row agree."""
    n = F.col("blockCount")
    same = (F.size("blockSizes") == n) & (F.size("qStarts") == n) & (F.size("tStarts") == n)
    inside = (F.col("tStarts")[0] == F.col("tStart")) & (F.element_at("tStarts", -1) + F.element_at("blockSizes", -1) == F.col("tEnd")) & (F.col("qEnd") <= F.col("qSize")) & (F.col("tEnd") <= F.col("tSize"))
    zipped = F.arrays_zip("tStarts", "qStarts", "blockSizes")
    ordered = F.forall(F.zip_with(F.slice(zipped, 1, n - 1), F.slice(zipped, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a["tStarts"] + a["blockSizes"] <= b["tStarts"]) & (a["qStarts"] + a["blockSizes"] <= b["qStarts"])), lambda x: x)
    return F.coalesce(same & inside & F.when(n > 1, ordered).otherwise(True), F.lit(False))


def with_stats(df: DataFrame, query: str, target: str) -> DataFrame:
    """Counters anew from the sequences: N of the query counts as nCount, target gaps only below an intron's length."""
    q = F.when(F.col("strand").startswith("-"), seq.reverse_complement(query)).otherwise(F.col(query))
    pairs = F.flatten(F.transform(F.arrays_zip("tStarts", "qStarts", "blockSizes"), lambda b: F.zip_with(F.split(F.substr(q, (b["qStarts"] + 1).cast("int"), b["blockSizes"].cast("int")), ""), F.split(F.substr(F.col(target), (b["tStarts"] + 1).cast("int"), b["blockSizes"].cast("int")), ""), lambda x, y: F.struct(F.upper(x).alias("q"), F.upper(y).alias("t")))))
    letters = F.filter(pairs, lambda p: p["q"] != "")
    count = lambda f: F.size(F.filter("_p", f))
    gaps = lambda starts: F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(F.zip_with(F.col(starts), "blockSizes", lambda s, n: s + n), 1, F.size(starts) - 1), lambda b, a: b - a)
    some = lambda g, most: F.filter(g, lambda x: (x > 0) & (x < most))
    tg, qg = some(gaps("tStarts"), MIN_INTRON), some(gaps("qStarts"), 1 << 40)
    total = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = df.withColumn("_p", letters).withColumn("nCount", count(lambda p: p["q"] == "N")).withColumn("matches", count(lambda p: (p["q"] != "N") & (p["q"] == p["t"]))).withColumn("misMatches", count(lambda p: (p["q"] != "N") & (p["q"] != p["t"])))
    return out.withColumn("tNumInsert", F.size(tg)).withColumn("tBaseInsert", total(tg)).withColumn("qNumInsert", F.size(qg)).withColumn("qBaseInsert", total(qg)).drop("_p")


def from_sam(sam: DataFrame, lengths: DataFrame) -> DataFrame:
    """Block alignments of mapped SAM rows; clips become query offsets, chromosome sizes come from (chrom, length)."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("q", "t")], F.array().cast("array<struct<t:bigint,q:bigint,n:bigint>>").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"].cast("bigint")
        m = x["op"].isin("M", "=", "X")
        return F.struct(
            (acc["q"] + F.when(m | x["op"].isin("I", "S", "H"), n).otherwise(0)).alias("q"), (acc["t"] + F.when(m | x["op"].isin("D", "N"), n).otherwise(0)).alias("t"),
            F.when(m, F.concat(acc["b"], F.array(F.struct(acc["t"].alias("t"), acc["q"].alias("q"), n.alias("n"))))).otherwise(acc["b"]).alias("b"),
        )

    r = sam.where(~cg.has_flag("flag", 4)).withColumn("_a", F.aggregate(cg.parse("cigar"), zero, step)).join(lengths.select(F.col("chrom").alias("rname"), "length"), "rname", "left")
    at, b = F.col("pos").cast("bigint") - 1, F.col("_a.b")
    minus, size, last = cg.has_flag("flag", 16), F.col("_a.q"), F.element_at(F.col("_a.b"), -1)
    q0, q1 = b[0]["q"], last["q"] + last["n"]
    ins = F.aggregate(F.filter(cg.parse("cigar"), lambda x: x["op"] == "I"), F.lit(0), lambda s, x: s + x["n"])
    dele = F.aggregate(F.filter(cg.parse("cigar"), lambda x: (x["op"] == "D") | ((x["op"] == "N") & (x["n"] < MIN_INTRON))), F.lit(0), lambda s, x: s + x["n"])
    return r.select(
        coverage(b["n"]).alias("matches"), F.lit(0).alias("misMatches"), ins.alias("qBaseInsert"), dele.alias("tBaseInsert"), F.when(minus, "-").otherwise("+").alias("strand"), F.col("qname").alias("qName"), size.alias("qSize"),
        F.when(minus, size - q1).otherwise(q0).alias("qStart"), F.when(minus, size - q0).otherwise(q1).alias("qEnd"), F.col("rname").alias("tName"), F.coalesce("length", at + F.col("_a.t")).alias("tSize"),
        at.alias("tStart"), (at + F.col("_a.t")).alias("tEnd"), F.size(b).alias("blockCount"), b["n"].alias("blockSizes"), b["q"].alias("qStarts"), F.transform(b["t"], lambda t: t + at).alias("tStarts"),
    )


def to_sam(psl: DataFrame, reads: DataFrame, min_intron: int = MIN_INTRON) -> DataFrame:
    """SAM columns of block alignments with their reads (name, seq); NH counts a read's alignments."""
    blocks = F.zip_with("tStarts", "blockSizes", lambda s, n: F.struct(s.alias("s"), (s + n).alias("e")))
    nh = psl.groupBy("qName").agg(F.count("*").alias("nh"))
    d = psl.join(nh, "qName").join(reads.select(F.col("name").alias("qName"), "seq"), "qName", "left")
    minus = F.col("strand").startswith("-")
    return d.select(
        F.col("qName").alias("qname"), F.when(minus, 16).otherwise(0).alias("flag"), F.col("tName").alias("rname"), (F.col("tStart") + 1).alias("pos"), F.lit(255).alias("mapq"),
        cg.build(blocks, "qStarts", "qSize", min_intron).alias("cigar"), F.when(minus, seq.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.col("nh"),
    )


def alignment_strings(query: Column, target: Column) -> Column:
    """struct(q, t): both sequences with gaps as dashes, block by block (introns are left out)."""
    blocks = F.arrays_zip("tStarts", "qStarts", "blockSizes")

    def part(b: Column, i: Column) -> Column:
        before = F.get(blocks, i - 1)
        qs, ts, n = b["qStarts"].cast("int"), b["tStarts"].cast("int"), b["blockSizes"].cast("int")
        gap = lambda side, at: F.coalesce(at - before[side].cast("int") - before["blockSizes"].cast("int"), F.lit(0))
        gq, gt = gap("qStarts", qs), gap("tStarts", ts)
        gt = F.when(gt < MIN_INTRON, gt).otherwise(0)
        q = F.concat(F.substr(query, qs - gq + 1, gq), F.lpad(F.lit(""), gt, F.lit("-")), F.substr(query, qs + 1, n))
        t = F.concat(F.lpad(F.lit(""), gq, F.lit("-")), F.substr(target, ts - gt + 1, gt), F.substr(target, ts + 1, n))
        return F.struct(q.alias("q"), t.alias("t"))

    parts = F.transform(blocks, part)
    return F.struct(F.concat_ws("", parts["q"]).alias("q"), F.concat_ws("", parts["t"]).alias("t"))


def printed(strings: Column, width: int = 50) -> Column:
    """array<struct(q, marks, t)>: ``alignment_strings`` in lines of ``width`` columns, with ``|`` between equal letters."""
    columns = lambda c: F.regexp_extract_all(strings[c], F.lit("(?s).{1,%d}" % width), F.lit(0))

    def line(q: Column, t: Column) -> Column:
        marks = F.zip_with(F.split(q, ""), F.split(t, ""), lambda x, y: F.when(x == "", "").when((F.upper(x) == F.upper(y)) & (x != "-"), "|").otherwise(" "))
        return F.struct(q.alias("q"), F.concat_ws("", marks).alias("marks"), t.alias("t"))

    return F.zip_with(columns("q"), columns("t"), line)


def stitched(psl: DataFrame) -> DataFrame:
    """(qName, tName, strand, entries, blockSizes, qStarts, tStarts): the alignments of a query on one strand of one target as one.

    They follow each other along the target (``tStart``, then ``tEnd`` and ``qStart``); each loses the target bases up to the
    furthest end before it, and one with nothing left goes.  Blocks that adjoin on both sides join.  ``entries`` counts the
    alignments that are left.  Queries are taken as they are: they should not overlap (``operators.reads.best_by_base``).
    """
    key = ["qName", "tName", "strand"]
    order = W.partitionBy(*key).orderBy("tStart", "tEnd", "qStart")
    rows = psl.select(*key, "qSize", "tStart", "tEnd", "qStart", "blockSizes", "qStarts", "tStarts")
    rows = rows.withColumn("_far", F.coalesce(F.max("tEnd").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = trimmed(rows, F.col("_far"), F.col("tEnd"))
    block = F.arrays_zip(F.col("tStarts").alias("t"), F.col("qStarts").alias("q"), F.col("blockSizes").alias("n"))
    by = left.groupBy(*key).agg(F.count("*").alias("entries"), F.array_sort(F.collect_list(F.struct("tStart", "tEnd", block.alias("b")))).alias("_x"))
    b = F.flatten(F.transform("_x", lambda x: x["b"]))
    by = by.select(*key, "entries", b.alias("_b"))
    joins = lambda x, y: (x["t"] + x["n"] == y["t"]) & (x["q"] + x["n"] == y["q"])
    first = F.filter("_b", lambda x, i: (i == 0) | ~joins(F.get("_b", i - 1), x))
    last = F.filter("_b", lambda x, i: (i == F.size("_b") - 1) | ~joins(x, F.get("_b", i + 1)))
    done = by.select(*key, "entries", F.zip_with(first, last, lambda x, y: F.struct(x["t"].alias("t"), x["q"].alias("q"), (y["t"] + y["n"] - x["t"]).alias("n"))).alias("_b"))
    return done.select(*key, "entries", F.col("_b.n").alias("blockSizes"), F.col("_b.q").alias("qStarts"), F.col("_b.t").alias("tStarts"))


def flipped(strand: Column) -> Column:
    """The other strand; blocks stay as they are."""
    return F.when(strand == "+", "-").otherwise("+")


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of alignments of one query and strand, the second beyond the first on both sides, as one alignment: qName, tName, strand and joined blocks."""
    left = a.select("qName", "tName", "strand", *[F.col(c).alias(f"a_{c}") for c in ("blockSizes", "qStarts", "tStarts")])
    right = b.select("qName", "tName", "strand", *[F.col(c).alias(f"b_{c}") for c in ("blockSizes", "qStarts", "tStarts")])
    met = left.join(right, ["qName", "tName", "strand"])
    beyond = lambda c: F.element_at(f"a_{c}", -1) + F.element_at("a_blockSizes", -1) <= F.col(f"b_{c}")[0]
    return met.where(beyond("qStarts") & beyond("tStarts")).select("qName", "tName", "strand", *[F.concat(f"a_{c}", f"b_{c}").alias(c) for c in ("blockSizes", "qStarts", "tStarts")])


def supplementary(sam: DataFrame, sa: Column | None = None, xa: Column | None = None) -> DataFrame:
    """The further alignments that a record's SA (split) and XA (alternative) tags name, as SAM rows: qname, flag, rname, pos, mapq, cigar.

    ``sa`` holds ``chrom,pos,strand,cigar,mapq,edits;`` or ``chrom,<strand>pos,cigar,mapq[,edits];`` entries, ``xa``
    ``chrom,<strand>pos,cigar,edits;`` entries.  Entries of any other form are an error, as a lost alignment would be silent.
    """
    name, number = r"([^,]+)", r"(\d+)"
    layouts = [(sa, rf"^{name},{number},([+-]),{name},{number},{number}$", (1, 2, 3, 4, 5)), (sa, rf"^{name},([+-]){number},{name},{number}(?:,{number})?$", (1, 3, 2, 4, 5)), (xa, rf"^{name},([+-]){number},{name},{number}$", (1, 3, 2, 4, None))]
    parts = []
    for tag in (sa, xa):
        if tag is None:
            continue
        entry = sam.select("qname", F.explode(F.split(tag, ";")).alias("entry")).where("entry <> ''")
        fields = F.raise_error(F.concat(F.lit("an alignment tag that cannot be read: "), F.col("entry"))).cast("struct<rname:string,pos:string,strand:string,cigar:string,mapq:string>")
        for of, pattern, (c, p, s, g, q) in reversed([x for x in layouts if x[0] is tag]):
            got = [F.regexp_extract("entry", pattern, k) if k else F.lit("0") for k in (c, p, s, g, q)]
            fields = F.when(F.col("entry").rlike(pattern), F.struct(*[v.alias(n) for v, n in zip(got, ("rname", "pos", "strand", "cigar", "mapq"))])).otherwise(fields)
        rows = entry.select("qname", fields.alias("x"))
        parts.append(rows.select("qname", F.when(F.col("x.strand") == "-", 16).otherwise(0).alias("flag"), "x.rname", F.col("x.pos").cast("int").alias("pos"), F.col("x.mapq").cast("int").alias("mapq"), "x.cigar"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def best_per_query(psl: DataFrame) -> DataFrame:
    """The alignment of each query with the most bases in blocks; ties by target and start."""
    from ..operators.select import best

    return best(psl, ["qName"], [F.desc(coverage("blockSizes")), F.col("tName"), F.col("tStart")])
