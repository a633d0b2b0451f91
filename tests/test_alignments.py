from pyspark.sql import functions as F
from tidemark.functions import psl, vcf
from tidemark.operators import junctions, nonredundant, reads, select

PSL = "matches int, misMatches int, qBaseInsert int, tBaseInsert int, strand string, qName string, qSize bigint, qStart bigint, qEnd bigint, tName string, tSize bigint, tStart bigint, tEnd bigint, blockCount int, blockSizes array<bigint>, qStarts array<bigint>, tStarts array<bigint>"


def aln(spark):
    return spark.createDataFrame([(98, 2, 1, 1, "+", "q", 120, 5, 106, "c", 1000, 50, 251, 2, [50, 50], [5, 56], [50, 201])], PSL)


def test_psl_functions(spark):
    d = aln(spark)
    r = d.select(psl.coverage().alias("c"), psl.quality().alias("q"), psl.valid().alias("v"), psl.target_to_query(F.lit(60)).alias("a"), psl.query_to_target(F.lit(57)).alias("b"), psl.target_to_query(F.lit(150)).alias("n")).first()
    assert tuple(r) == (100, 0.96, True, 15, 202, None)
    cut = psl.trimmed(d, F.lit(60), F.lit(211)).first()
    assert (cut.tStart, cut.tEnd, cut.qStart, cut.qEnd, list(cut.blockSizes)) == (60, 211, 15, 66, [40, 10])
    assert psl.trimmed(d, F.lit(110), F.lit(190)).count() == 0
    assert psl.trimmed(d, F.lit(10), F.lit(60), "q").first().tEnd == 205
    x = spark.range(1).select(psl.base_overlap(F.array(F.lit(0), F.lit(20)), F.array(F.lit(10), F.lit(10)), F.array(F.lit(5)), F.array(F.lit(18))).alias("o"), psl.target_distance(F.lit("c"), F.lit(0), F.lit(5), F.lit("c"), F.lit(9), F.lit(12)).alias("d")).first()
    assert tuple(x) == (8, 4)


def test_psl_stats_and_strings(spark):
    t = "ACGTACGTAC" + "G" * 5 + "TTTT"
    d = spark.createDataFrame([(0, 0, 0, 0, "+", "q", 9, 0, 9, "c", 19, 0, 14, 2, [5, 3], [0, 6], [0, 6], "ACGAAxGTA", t), (0, 0, 0, 0, "+", "q", 4, 0, 4, "c", 19, 0, 4, 1, [4], [0], [0], "NCGT", t)], PSL + ", q string, t string")
    rows = psl.with_stats(d, "q", "t").orderBy("qSize").collect()
    assert (rows[0].nCount, rows[0].matches, rows[0].misMatches) == (1, 3, 0)
    assert (rows[1].matches, rows[1].misMatches, rows[1].tBaseInsert, rows[1].qBaseInsert) == (7, 1, 1, 1)
    s = d.where("qSize = 9").select(psl.alignment_strings(F.col("q"), F.col("t")).alias("s")).first().s
    assert (s.q, s.t) == ("ACGAAx-GTA", "ACGTA-CGTA")


SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, tags map<string,struct<type:string,value:string>>"


def sam(spark):
    rows = [
        ("a", 0, "c", 11, 9, "10M80N10M", "A" * 20, {"NH": ("i", "1")}),
        ("b", 16, "c", 13, 9, "8M80N12M", "A" * 20, {"NH": ("i", "2")}),
        ("b", 0, "c", 500, 9, "20M", "A" * 20, {}),
        ("d", 0, "c", 200, 9, "5S10M2I3D10M", "A" * 27, {}),
        ("e", 4, "*", 0, 0, "*", "A", {}),
    ]
    return spark.createDataFrame(rows, SAM)


def test_sam_psl_and_back(spark):
    lengths = spark.createDataFrame([("c", 1000)], "chrom string, length bigint")
    p = psl.from_sam(sam(spark), lengths)
    r = {(x.qName, x.tStart): x for x in p.collect()}
    assert len(r) == 4
    d = r["d", 199]
    assert (list(d.blockSizes), list(d.qStarts), list(d.tStarts), d.qSize, d.qBaseInsert, d.tBaseInsert) == ([10, 10], [5, 17], [199, 212], 27, 2, 3)
    back = {(x.qname, x.pos): (x.cigar, x.flag, x.nh) for x in psl.to_sam(p, sam(spark).where("flag <> 4").selectExpr("qname AS name", "seq").distinct()).collect()}
    assert back["d", 200] == ("5S10M2I3D10M", 0, 1) and back["b", 13] == ("8M80N12M", 16, 2)


def test_junctions(spark):
    s = sam(spark)
    j = junctions.of_alignments(s)
    t = [tuple(r) for r in junctions.table(j).collect()]
    assert t == [("c", 20, 100, 2, 2, 12, 1, 1)]
    assert {r.qname for r in junctions.supported_reads(s, overhang=8).collect()} == {"a", "b"}
    assert junctions.supported_reads(s, overhang=8, support=3).count() == 0
    assert {r.qname for r in s.where(junctions.is_junction_row(overhang=10)).collect()} == {"a"}
    ref = spark.createDataFrame([("c", "N" * 20 + "GT" + "C" * 76 + "AG" + "N" * 9)], "chrom string, seq string")
    assert junctions.stranded(junctions.table(j), ref).first().strand == "+"
    got = junctions.snapped(spark.createDataFrame([(1, "c", 22, 99), (1, "c", 300, 400), (2, "c", 500, 600)], "id int, chrom string, l bigint, r bigint"), spark.createDataFrame([("c", "+", 20, 100), ("c", "-", 22, 96), ("c", "+", 301, 400)], "chrom string, strand string, l bigint, r bigint"))
    assert sorted(map(str, ((r.id, r.l, r.strand, r.nl, r.nr) for r in got.collect()))) == sorted(map(str, [(1, 22, "+", 20, 100), (1, 300, "+", 301, 400), (2, 500, None, None, None)]))
    e = junctions.equivalent(spark.createDataFrame([("c", 3, 8)], "chrom string, l bigint, r bigint"), spark.createDataFrame([("c", "AAGTTCAGTTC")], "chrom string, seq string"))
    text = "AAGTTCAGTTC"
    same = {(r.el, r.er) for r in e.collect()}
    assert (3, 8) in same and len({text[:a] + text[b:] for a, b in same}) == 1 and len(same) > 1


def test_variant_filters(spark):
    v = spark.createDataFrame([(30.0, "A", "G", "DP=20;DP4=3,4,5,6", ["GT", "0/1:9"]), (5.0, "A", "GT", "DP=2", ["GT", "1/1"])], "qual double, ref string, alt string, info string, samples array<string>")
    assert [vcf.filtered(v, **k).count() for k in ({"quality": 10}, {"total_depth": 20}, {"allele_depth": 7}, {"allele_depth": 8}, {"strand_depth": 3}, {"strand_depth": 4}, {"biallelic": True}, {})] == [1, 1, 1, 0, 1, 0, 1, 2]


def test_consensus_of_a_locus(spark):
    def ex(*p):
        return [{"s": a, "e": b} for a, b in p]

    tx = spark.createDataFrame(
        [(1, "c", ex((0, 10), (30, 40), (60, 80))), (2, "c", ex((5, 12), (30, 40), (60, 90))), (3, "c", ex((2, 10), (31, 40), (60, 70))), (4, "c", ex((33, 40), (60, 66))), (5, "c", ex((62, 70))), (6, "d", ex((0, 5)))],
        "id bigint, chrom string, exons array<struct<s:bigint,e:bigint>>",
    )
    got = {tuple(r.ids): [tuple(x) for x in r.exons] for r in nonredundant.consensus(tx, 3).collect()}
    assert got == {(1, 2, 3, 4): [(0, 10), (30, 40), (60, 90)], (5,): [(62, 70)], (6,): [(0, 5)]}
    assert nonredundant.consensus(tx, 3, support=2).count() == 1
    for rule, want in {"any": [1, 1, 1, 1, 1, 6], "compatible": [1, 1, 1, 4, 5, 6], "subset": [1, 1, 1, 1, 1, 6], "full": [1, 1, 1, 4, 5, 6]}.items():
        assert [r.component for r in nonredundant.clustered(tx, rule, 3).orderBy("id").collect()] == want, rule
    bed = spark.createDataFrame([("c", 0, 5), ("c", 7, 9), ("c", 40, 45), ("c", 900, 905)], "chrom string, s bigint, e bigint")
    assert [[tuple(x) for x in r.exons] for r in nonredundant.chained(bed, 3, 100).orderBy("locus").collect()] == [[(0, 9), (40, 45)], [(900, 905)]]


def test_read_sets(spark):
    a = spark.createDataFrame([("m/1/a", 5), ("m/2/a", 4)], "name string, n int")
    b = spark.createDataFrame([("m/2/b", 9), ("m/3/a", 2), ("m/3/b", 7)], "name string, n int")
    key = select.molecule(F.col("name"))
    got = reads.tiered_set([a.withColumn("m", key), b.withColumn("m", key)], "m", "n", [False, True])
    assert sorted(r["name"] for r in got.collect()) == ["m/1/a", "m/2/a", "m/3/b"]
    f = reads.full_or_corrected(spark.createDataFrame([("x", "AAAA"), ("y", "A" * 9)], "k string, seq string"), spark.createDataFrame([("x", "AAA"), ("y", "AAA"), ("z", "C")], "k string, seq string"), "k", 0.7)
    assert {r.k: r.used for r in f.collect()} == {"x": "full", "y": "corrected", "z": "corrected"}
    p = reads.with_primary(sam(spark)).where("qname = 'b'").orderBy("pos").collect()
    assert sum(r.flag & 2304 == 0 for r in p) == 1


def test_mates(spark):
    rows = [("p", 64 + 1 + 32, "c", 11, 9, "10M", "A", {}), ("p", 128 + 1 + 16, "c", 16, 9, "10M80N5M", "A", {}), ("q", 64 + 1, "c", 1, 9, "5M", "A", {})]
    got = reads.joined_mates(spark.createDataFrame(rows, SAM)).collect()
    assert [(r.qname, r.s, r.e, [tuple(x) for x in r.blocks]) for r in got] == [("p", 10, 110, [(10, 25), (105, 110)])]


def test_errors_and_votes(spark):
    cols = spark.createDataFrame([(1, 0, "match", "A", "A"), (1, 1, "mismatch", "T", "C"), (1, 2, "insertion", "G", ""), (1, 3, "match", "G", "G")], "id int, i int, kind string, base string, ref string")
    assert [tuple(r) for r in reads.error_profile(cols).collect()] == [("A", "G", "C", "T", 1)]
    assert {r.kind: r.rate for r in reads.error_rates(cols).collect()} == {"match": 0.5, "mismatch": 0.25, "insertion": 0.25}
    v = spark.createDataFrame([(1, 1, "T", 2), (1, 1, "G", 2), (1, 2, "", 5), (1, 2, "C", 4)], "id int, pos int, base string, weight int")
    r = spark.createDataFrame([(1, "ACGT"), (2, "TT")], "id int, seq string")
    assert sorted(tuple(x) for x in reads.corrected(r, v).collect()) == [(1, "AGT"), (2, "TT")]
    q = reads.quality_runs(spark.createDataFrame([("IIIH",)], "q string"), "q", 4).collect()
    assert sorted((x.bin, x.code, x.run, x.n) for x in q) == [(0, 73, 3, 1), (3, 72, 1, 1)]
