import gzip
import struct

from pyspark.sql import functions as F
from tidemark import sinks, sources


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(p)


def test_fasta_and_fastq(spark, tmp_path):
    fa = put(tmp_path, "a.fa", ">one first\nACGT  \nAC\n>two\n\n>three\nGG\n")
    assert sorted((r.name, r.seq) for r in sources.fasta(spark, fa).collect()) == [("one first", "ACGTAC"), ("three", "GG"), ("two", "")]
    fq = put(tmp_path, "a.fq", "@r1\tx\nACGT\n+\n@@II\n@r2\nGG\n+r2\n+I\n")
    want = [("r1", "ACGT", "@@II"), ("r2", "GG", "+I")]
    assert sorted(tuple(r) for r in sources.fastq(spark, fq).collect()) == want
    gz = tmp_path / "b.fq.gz"
    gz.write_bytes(gzip.compress(b"@r1\nA\n+\nI\n"))
    assert sources.fastq(spark, str(gz)).count() == 1
    out = str(tmp_path / "out")
    sinks.write_lines(sinks.fastq_lines(sources.fastq(spark, fq)), out, "gzip")
    assert sorted(tuple(r) for r in sources.fastq(spark, out).collect()) == want
    assert sinks.unmapped_sam_lines(sources.fastq(spark, fq)).orderBy("value").first()[0].split("\t")[:4] == ["r1", "4", "*", "0"]


GPD = "g1\tt1\tchr1\t+\t10\t60\t10\t60\t2\t10,40,\t20,60,\ng1\tt2\tchr1\t-\t5\t9\t5\t9\t1\t5,\t9,\n"


def test_genepred_and_conversions(spark, tmp_path):
    tx = sources.genepred(spark, put(tmp_path, "a.gpd", "#head\n" + GPD))
    rows = {r.name: r for r in tx.collect()}
    assert [tuple(x) for x in rows["t1"].exons] == [(10, 20), (40, 60)]
    assert sorted(r[0] for r in sinks.genepred_lines(tx).collect()) == sorted(GPD.strip().split("\n"))
    bed = put(tmp_path, "a.bed", "\n".join(r[0] for r in sinks.bed12_lines(tx).collect()) + "\n")
    assert {r.name: [tuple(x) for x in r.exons] for r in sources.bed12(spark, bed).collect()} == {n: [tuple(x) for x in r.exons] for n, r in rows.items()}
    gtf = sinks.gtf_exons(tx).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")]).alias("value"))
    path = str(tmp_path / "gtf")
    sinks.write_lines(gtf, path)
    back = sinks.gtf_to_transcripts(sources.gtf(spark, path)).collect()
    assert {r.name: [tuple(x) for x in r.exons] for r in back} == {n: [tuple(x) for x in r.exons] for n, r in rows.items()}
    lengths = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    p = sinks.perfect_psl(tx, lengths)
    assert [tuple(x) for x in sinks.psl_to_transcripts(p).where("name = 't1'").first().exons] == [(10, 20), (40, 60)]
    ref = spark.createDataFrame([("chr1", "ACGTACGTACGTACGTACGT" * 5)], "chrom string, seq string")
    fa = {r[0].split("\n")[0]: r[0].split("\n")[1] for r in sinks.spliced_fasta(tx.withColumnRenamed("name", "id"), ref).collect()}
    assert len(fa[">t1"]) == 30 and len(fa[">t2"]) == 4


def test_gff3(spark, tmp_path):
    text = "##gff\nc\ts\tmRNA\t1\t50\t.\t+\t.\tID=t1;Parent=g1\nc\ts\texon\t1\t10\t.\t+\t.\tID=e1;Parent=t1\nc\ts\texon\t21\t50\t.\t+\t.\tID=e2;Parent=t1\n"
    got = sinks.gff3_to_transcripts(sources.gff3(spark, put(tmp_path, "a.gff3", text)), True).first()
    assert (got["name"], got.gene_name, [tuple(x) for x in got.exons]) == ("t1", "g1", [(0, 10), (20, 50)])


SAM = "@SQ\tSN:chr1\tLN:1000\nr1\t0\tchr1\t1\t60\t5M100N5M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tNH:i:1\tXS:A:+\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_sam_psl_vcf(spark, tmp_path):
    path = put(tmp_path, "a.sam", SAM)
    sam = sources.sam(spark, path)
    r = sam.where("qname = 'r1'").first()
    assert (r.pos, r.cigar, r.tags["NH"].value, r.tags["XS"].type) == (1, "5M100N5M", "1", "A")
    assert [tuple(x) for x in sinks.sam_to_transcripts(sam).first().exons] == [(0, 5), (105, 110)]
    assert sinks.flat_sam(sam).first().mapq == 0
    assert tuple(sources.sam_header(spark, path).first()) == ("chr1", 1000)
    psl = "90\t2\t0\t0\t1\t1\t1\t1\t-\tq\t120\t10\t110\tchr1\t1000\t50\t250\t2\t50,50,\t10,60,\t50,200,\n"
    p = sources.psl(spark, put(tmp_path, "a.psl", psl)).first()
    assert (list(p.tStarts), list(p.qStarts_actual)) == ([50, 200], [60, 10])
    v = sources.vcf(spark, put(tmp_path, "a.vcf", "#x\nchr1\t7\t.\tA\tG\t30.5\tPASS\tDP4=3,4,5,6\tGT\t0|1\nchr1\t9\t.\tA\tG\n")).orderBy("pos").collect()
    assert (v[0].qual, list(v[0].samples)) == (30.5, ["GT", "0|1"]) and v[1].qual is None


def test_bed_matrix_expression(spark, tmp_path):
    b = sources.bed(spark, put(tmp_path, "a.bed", "track x\nc\t0\t5\tn\t3\n")).first()
    assert (b.s, b.e, list(b.payload)) == (0, 5, ["n", "3"])
    m = sources.matrix(spark, put(tmp_path, "m.tsv", "a\tb\nc\n"))
    assert sorted(r.value for r in m.collect()) == ["a", "b", "c"]
    e = sources.expression(spark, put(tmp_path, "e.tsv", "p\tx\ty\nq\t1\t2.5\n"))
    assert sorted((r.experiment, r.value) for r in e.collect()) == [("x", 1.0), ("y", 2.5)]


def test_bam(spark, tmp_path):
    seq, qual = "ACGTN", bytes([30, 31, 32, 33, 34])
    packed = bytes([0x12, 0x48, 0xF0])
    body = struct.pack("<iiBBHHHiiii", 0, 9, 3, 60, 0, 1, 16, 5, -1, -1, 0) + b"r1\0" + struct.pack("<I", 5 << 4) + packed + qual + b"NHC\x02" + b"XZZhi\0"
    text = b"@SQ\tSN:c\tLN:9\n"
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9) + struct.pack("<i", len(body)) + body
    r = sources.bam(spark, put(tmp_path, "a.bam", gzip.compress(raw))).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, dict(r.tags)) == ("r1", 16, "c", 10, "5M", seq, "?@ABC", {"NH": "2", "XZ": "hi"})
