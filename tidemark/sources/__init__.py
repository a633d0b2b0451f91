"""Readers of sequence, alignment and annotation formats, on Spark's own text scan (compressed files included).

Records that span lines are cut by a line separator (FASTA) or gathered by line
number within the file (FASTQ), never by collecting a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas


def _ints(col: str) -> Column:
    return F.transform(F.split(F.rtrim(F.col(col), F.lit(",")), ","), lambda x: x.try_cast("bigint"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the whole header is the name; lines are joined, their ends trimmed."""
    raw = spark.read.text(path, lineSep="\n>")
    rec = raw.select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    name = F.regexp_extract("r", r"^([^\n\r]*)", 1)
    body = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"[ \t\r]*(\n|$)", "")).otherwise("")
    return rec.select(name.alias("name"), body.alias("seq"))


def fastq(spark: SparkSession, path: str, full_name: bool = False) -> DataFrame:
    """(name, seq, qual) of four-line records; the name ends at a tab unless ``full_name``."""
    # ids go up by one within a split, so a line's number needs the split's first id and the lines of the splits before it, and no sort
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("f", "b").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row a split
    starts = F.broadcast(splits.select("f", "b", (before - F.col("first")).alias("shift")))
    k = F.col("k")
    numbered = lines.join(starts, ["f", "b"]).select("f", "value", (F.col("at") + F.col("shift")).alias("k")).withColumn("rec", F.floor(k / 4))
    # records meet before they are sorted, so no task sorts a whole file
    rec = numbered.repartition("f", "rec").groupBy("f", "rec").agg(*[F.max(F.when(k % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(("h", "seq", "plus", "qual"))])
    name = F.substring("h", 2, 1 << 30)
    return rec.where("qual IS NOT NULL").select((name if full_name else F.regexp_extract(name, r"^([^\t]*)", 1)).alias("name"), "seq", "qual")


def genepred(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with exons array<struct(s, e)>; lines that start with # are skipped."""
    raw = spark.read.csv(path, sep="\t", schema=schemas.GENEPRED, comment="#", quote="")
    exons = F.zip_with(_ints("exonStarts"), _ints("exonEnds"), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return raw.withColumn("exons", exons).drop("exonStarts", "exonEnds")


def psl(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with integer arrays and ``qStarts_actual``: query starts on the query's own strand."""
    raw = spark.read.csv(path, sep="\t", schema=schemas.PSL, quote="").where("matches IS NOT NULL")
    for c in ("blockSizes", "qStarts", "tStarts"):
        raw = raw.withColumn(c, _ints(c))
    own = F.zip_with("qStarts", "blockSizes", lambda q, n: F.when(F.col("strand").startswith("-"), F.col("qSize") - q - n).otherwise(q))
    return raw.withColumn("qStarts_actual", own)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records with ``tags`` map<string, struct(type, value)>; header lines are skipped."""
    p = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(p) >= 11)).select(p.alias("p"))
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [(F.col("p")[i].cast("int") if c in ints else F.col("p")[i]).alias(c) for i, c in enumerate(schemas.SAM)]
    extra = F.transform(F.filter(F.slice("p", 12, F.greatest(F.size("p") - 11, F.lit(0))), lambda t: t.rlike("^[^:]+:[^:]:")), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.struct(F.regexp_extract(t, "^[^:]+:([^:]):", 1).alias("type"), F.regexp_extract(t, "^[^:]+:[^:]:(.*)$", 1).alias("value")).alias("v")))
    return raw.select(*cols, F.map_from_entries(extra).alias("tags"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the @SQ lines."""
    v = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return v.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e, payload array): further columns are the payload."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.size(p) >= 3)).select(p.alias("p"))
    return rows.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("s"), F.col("p")[2].cast("long").alias("e"), F.slice("p", 4, F.greatest(F.size("p") - 3, F.lit(0))).alias("payload"))


def bed12(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, name, strand, s, e, exons) of twelve-column lines."""
    b = bed(spark, path).where(F.size("payload") >= 9)
    sizes = F.transform(F.split(F.rtrim(F.col("payload")[7], F.lit(",")), ","), lambda x: x.try_cast("bigint"))
    offs = F.transform(F.split(F.rtrim(F.col("payload")[8], F.lit(",")), ","), lambda x: x.try_cast("bigint"))
    exons = F.zip_with(offs, sizes, lambda o, n: F.struct((F.col("s") + o).alias("s"), (F.col("s") + o + n).alias("e")))
    return b.select("chrom", F.col("payload")[0].alias("name"), F.col("payload")[2].alias("strand"), "s", "e", exons.alias("exons"))


def depth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, s long, e long, depth double")


def gtf(spark: SparkSession, path: str, feature: str | None = "exon") -> DataFrame:
    """Rows with ``attributes`` map and half-open s, e; only rows with gene_id and transcript_id."""
    raw = spark.read.csv(path, sep="\t", schema=schemas.GTF, comment="#", quote="", escape="")
    if feature:
        raw = raw.where(F.col("feature") == feature)
    keys, vals = F.regexp_extract_all("attributes", F.lit(r'(\S+) "([^"]*)"'), F.lit(1)), F.regexp_extract_all("attributes", F.lit(r'(\S+) "([^"]*)"'), F.lit(2))
    m = F.map_from_entries(F.array_distinct(F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("key"), v.alias("value")))))
    out = raw.withColumn("attributes", m).withColumn("s", F.col("start") - 1).withColumn("e", F.col("end")).drop("start", "end")
    return out.where(F.col("attributes")["gene_id"].isNotNull() & F.col("attributes")["transcript_id"].isNotNull())


def gff3(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema=schemas.GTF, comment="#", quote="")
    return raw.withColumn("attributes", F.str_to_map("attributes", F.lit(";"), F.lit("="))).withColumn("s", F.col("start") - 1).withColumn("e", F.col("end")).drop("start", "end")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with double qual and ``samples``; missing trailing columns are null."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 5)).select(p.alias("p"))
    kind = {"pos": "int", "qual": "double"}
    cols = [F.expr(f"try_cast(get(p, {i}) AS {kind.get(c, 'string')})").alias(c) for i, c in enumerate(schemas.VCF)]
    return rows.select(*cols, F.slice("p", 9, F.greatest(F.size("p") - 8, F.lit(0))).alias("samples"))


def expression(spark: SparkSession, path: str) -> DataFrame:
    """Long (probe, experiment, value) of a matrix with a header line."""
    raw = spark.read.csv(path, sep="\t", header=True)
    first, *rest = raw.columns
    return raw.withColumnRenamed(first, "probe").unpivot("probe", rest, "experiment", "value").withColumn("value", F.expr("try_cast(value AS double)"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """Ragged cells (row, col, value)."""
    rows = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", F.posexplode(F.split("value", "\t")).alias("col", "value"))


def bgzf_blocks(data: bytes) -> list[tuple[int, int]]:
    """(start, size) of each block of a blocked gzip file."""
    import struct

    out, at = [], 0
    while at + 18 <= len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked gzip file")
        (xlen,) = struct.unpack_from("<H", data, at + 10)
        field, size = at + 12, None
        while field < at + 12 + xlen:
            a, b, n = data[field], data[field + 1], struct.unpack_from("<H", data, field + 2)[0]
            if (a, b, n) == (66, 67, 2):
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + n
        if size is None:
            raise ValueError("a block without its size")
        out.append((at, size))
        at += size
    return out


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files as (qname, flag, rname, pos 1-based, mapq, cigar, rnext, pnext, tlen, seq, qual, tags string map)."""
    from .bam_records import SCHEMA, decode_files

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode_files, SCHEMA)


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"))
