"""Writers: DataFrames of records to lines of the text formats, and partitioned output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import transcripts as tr


def _tsv(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _list(x: Column) -> Column:
    """Comma list with the formats' trailing comma."""
    return F.concat(F.concat_ws(",", F.transform(x, lambda v: v.cast("string"))), F.lit(","))


def fasta_lines(df: DataFrame, name: str = "name", seq_col: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq_col)).alias("value"))


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def fake_fastq(fasta: DataFrame, letter: str = "I") -> DataFrame:
    return fasta.withColumn("qual", F.expr(f"repeat('{letter}', length(seq))"))


def unmapped_sam_lines(fastq: DataFrame, with_qual: bool = True) -> DataFrame:
    q = F.col("qual") if with_qual else F.lit("*")
    return fastq.select(_tsv("name", F.lit(4), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.lit(0), F.lit(0), "seq", q).alias("value"))


def genepred_lines(tx: DataFrame) -> DataFrame:
    """Lines of (gene_name, name, chrom, strand, cdsStart, cdsEnd, exons)."""
    x = F.col("exons")
    return tx.select(_tsv("gene_name", "name", "chrom", "strand", x[0]["s"], F.element_at(x, -1)["e"], "cdsStart", "cdsEnd", F.size(x), _list(x["s"]), _list(x["e"])).alias("value"))


def bed12_lines(tx: DataFrame, name: str = "name", color: Column | None = None, gap: int = 0) -> DataFrame:
    """Twelve-column lines, gaps below ``gap`` closed."""
    d = tx.withColumn("_x", tr.smooth("exons", gap) if gap else F.col("exons"))
    x, s, e = F.col("_x"), F.col("_x")[0]["s"], F.element_at("_x", -1)["e"]
    rgb = color if color is not None else F.lit("0,0,0")
    return d.select(_tsv("chrom", s, e, name, F.lit(1000), "strand", s, e, rgb, F.size(x), _list(F.transform(x, lambda v: v["e"] - v["s"])), _list(F.transform(x, lambda v: v["s"] - s))).alias("value"))


def exon_bed(tx: DataFrame, name: str = "name") -> DataFrame:
    """(chrom, s, e, name), one row an exon."""
    return tx.select("chrom", F.explode("exons").alias("x"), name).select("chrom", "x.s", "x.e", name)


def gtf_exons(tx: DataFrame, source: str = "tidemark") -> DataFrame:
    """GTF rows of exons: 1-based, closed, with frames of the chain from the transcript's 5' end."""
    at = F.posexplode("exons").alias("i", "x")
    rows = tx.select("gene_name", "name", "chrom", "strand", tr.frames("exons").alias("f"), at)
    attr = F.concat(F.lit('gene_id "'), "gene_name", F.lit('"; transcript_id "'), "name", F.lit('"; exon_number "'), (F.col("i") + 1).cast("string"), F.lit('";'))
    return rows.select("chrom", F.lit(source).alias("source"), F.lit("exon").alias("feature"), (F.col("x.s") + 1).alias("start"), F.col("x.e").alias("end"), F.lit(".").alias("score"), "strand", F.col("f")[F.col("i")].alias("frame"), attr.alias("attributes"))


def gtf_to_transcripts(rows: DataFrame) -> DataFrame:
    """Transcripts of GTF exon rows; those on more than one strand, gene or chromosome are dropped."""
    a = F.col("attributes")
    by = rows.groupBy(a["transcript_id"].alias("name")).agg(
        F.count_distinct("strand").alias("_a"), F.count_distinct(a["gene_id"]).alias("_b"), F.count_distinct("chrom").alias("_c"), F.first("strand").alias("strand"), F.first(a["gene_id"]).alias("gene_name"), F.first("chrom").alias("chrom"), F.sort_array(F.collect_set(F.struct("s", "e"))).alias("exons")
    )
    return by.where("_a = 1 AND _b = 1 AND _c = 1").drop("_a", "_b", "_c")


def gff3_to_transcripts(rows: DataFrame, mrna_only: bool = False) -> DataFrame:
    """Transcripts of GFF3 rows: exons under their parent, genes above by a self join."""
    a = F.col("attributes")
    mrna = rows.where("feature IN ('mRNA', 'transcript')").select(a["ID"].alias("name"), a["Parent"].alias("gene_name"))
    exon = rows.where("feature = 'exon'").withColumn("name", F.explode(F.split(a["Parent"], ",")))
    by = exon.groupBy("name").agg(F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.sort_array(F.collect_set(F.struct("s", "e"))).alias("exons"))
    out = by.join(mrna, "name", "inner" if mrna_only else "left")
    return out.withColumn("gene_name", F.coalesce("gene_name", "name"))


def perfect_psl(tx: DataFrame, lengths: DataFrame) -> DataFrame:
    """PSL columns of transcripts that match their own sequence; chromosomes' sizes from (chrom, length)."""
    x, n = F.col("exons"), tr.size("exons")
    sizes = F.transform(x, lambda v: v["e"] - v["s"])
    q = F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0).cast("bigint"), lambda s, v: s + v))
    zero = F.lit(0)
    d = tx.join(lengths, "chrom", "left")
    return d.select(
        n.alias("matches"), zero.alias("misMatches"), zero.alias("repMatches"), zero.alias("nCount"), zero.alias("qNumInsert"), zero.alias("qBaseInsert"), (F.size(x) - 1).alias("tNumInsert"),
        (F.element_at(x, -1)["e"] - x[0]["s"] - n).alias("tBaseInsert"), "strand", F.col("name").alias("qName"), n.alias("qSize"), zero.alias("qStart"), n.alias("qEnd"), F.col("chrom").alias("tName"),
        F.coalesce("length", F.element_at(x, -1)["e"]).alias("tSize"), x[0]["s"].alias("tStart"), F.element_at(x, -1)["e"].alias("tEnd"), F.size(x).alias("blockCount"), sizes.alias("blockSizes"), q.alias("qStarts"), x["s"].alias("tStarts"),
    )


def psl_to_transcripts(psl: DataFrame, gap: int = 0) -> DataFrame:
    """(name, chrom, strand, exons) on the target, gaps below ``gap`` filled."""
    exons = F.zip_with("tStarts", "blockSizes", lambda s, n: F.struct(s.cast("bigint").alias("s"), (s + n).cast("bigint").alias("e")))
    d = psl.select(F.col("qName").alias("name"), F.col("tName").alias("chrom"), "strand", exons.alias("exons"))
    return d.withColumn("exons", tr.smooth("exons", gap)) if gap else d


def sam_to_transcripts(sam: DataFrame, min_intron: int = tr.MIN_INTRON) -> DataFrame:
    """(name, chrom, strand, exons) of mapped alignment records."""
    from ..functions import cigar

    rows = sam.where(~cigar.has_flag("flag", 4))
    return rows.select(F.col("qname").alias("name"), F.col("rname").alias("chrom"), F.when(cigar.has_flag("flag", 16), "-").otherwise("+").alias("strand"), cigar.exons("pos", "cigar", min_intron).alias("exons"))


def flat_sam(sam: DataFrame) -> DataFrame:
    """Mapped records with the flag reduced to strand and mate fields zeroed."""
    from ..functions import cigar

    rows = sam.where(~cigar.has_flag("flag", 4))
    return rows.withColumn("flag", F.when(cigar.has_flag("flag", 16), 16).otherwise(0)).withColumn("mapq", F.lit(0)).withColumn("rnext", F.lit("*")).withColumn("pnext", F.lit(0)).withColumn("tlen", F.lit(0))


def score_color(score: Column, ramp: str = "B") -> Column:
    """itemRgb of a score in 0..1: from pale to full blue, green, red, yellow or purple."""
    hi, lo = F.lit(255), (255 - F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")
    part = {"B": (lo, lo, hi), "G": (lo, hi, lo), "R": (hi, lo, lo), "Y": (hi, hi, lo), "P": (hi, lo, hi)}[ramp]
    return F.concat_ws(",", *[p.cast("string") for p in part])


def write_lines(lines: DataFrame, path: str, compression: str | None = None, records_per_file: int | None = None, by: list[str] | None = None) -> None:
    """Write a ``value`` column as text, optionally compressed, in files of so many records, or one folder a key."""
    w = lines.write
    if compression:
        w = w.option("compression", compression)
    if records_per_file:
        w = w.option("maxRecordsPerFile", records_per_file)
    (w.partitionBy(*by) if by else w).text(path)


def spliced_fasta(tx: DataFrame, reference: DataFrame) -> DataFrame:
    return fasta_lines(tr.spliced(tx, reference), "id", "seq")


def revcomp_fastq(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", seq.reverse_complement("seq")).withColumn("qual", F.reverse("qual"))


def wrapped_fasta_lines(df: DataFrame, width: int = 60, name: str = "name", seq_col: str = "seq") -> DataFrame:
    """FASTA with the sequence in lines of ``width`` letters."""
    body = F.array_join(F.regexp_extract_all(F.col(seq_col), F.lit("(?s).{1,%d}" % width), F.lit(0)), "\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def psl_lines(psl: DataFrame) -> DataFrame:
    """Lines of the 21 PSL columns (block lists as arrays)."""
    from .. import schemas

    names = [c.split()[0] for c in schemas.PSL.split(", ")]
    lists = {"blockSizes", "qStarts", "tStarts"}
    return psl.select(_tsv(*[_list(F.col(c)) if c in lists else F.col(c) for c in names]).alias("value"))


def sam_lines(sam: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Lines of alignment records (missing fields take the format's placeholder), tags in order of their names; with (name, length) @SQ lines too."""
    empty = {"mapq": F.lit(0), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*")}
    cols = [F.col(c) if c in sam.columns else empty[c] for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat_ws(":", t["key"], t["value"]["type"], t["value"]["value"]))
    body = sam.select(F.concat_ws("\t", *[c.cast("string") for c in cols], F.coalesce(tags, F.array().cast("array<string>"))).alias("value"))
    if lengths is None:
        return body
    return lengths.select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value")).unionByName(body)


def vcf_lines(variants: DataFrame) -> DataFrame:
    """Lines of (chrom, pos, id, ref, alt, qual, filter, info, samples); nulls become dots."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return variants.select(F.concat_ws("\t", *[dot(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")], "samples").alias("value"))
