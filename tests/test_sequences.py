import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.functions import align, cigar, quality, seq
from tidemark.operators import graph, select, simulate, stats
from tidemark.operators import transcripts as tr


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col).first()[0]


def test_sequence_functions(spark):
    assert one(spark, seq.reverse_complement("x"), x="ACGTN") == "NACGT"
    assert one(spark, seq.reverse_complement_rna("x"), x="AAU") == "AUU"
    assert one(spark, seq.reverse_complement_rna("x"), x="AUT") is None
    assert one(spark, seq.homopolymer_compress("x"), x="AAACCGT") == "ACGT"
    assert [tuple(r) for r in one(spark, seq.homopolymer_runs("x"), x="AAACCGT")] == [(0, 3), (1, 2)]
    assert one(spark, seq.burrows_wheeler("x"), x="banana") == "bnn|aaa"
    assert [tuple(r) for r in one(spark, seq.tiles("x", 3), x="ACGTACG")] == [(0, "ACG"), (1, "TAC"), (2, "G")]
    assert one(spark, seq.tiles("x", 3), x="") == []
    assert one(spark, seq.gc_content("x"), x="GCNA") == 2 / 3
    assert [one(spark, seq.genotype_count("x"), x=g) for g in ("0|1", ".|.", "1/1", "2|0:35")] == [1, 0, 2, 1]
    assert one(spark, seq.decode_name(seq.encode_name("x")), x="a b/ü") == "a b/ü"


def test_quality_guess(spark):
    text = "DLXYXXRXWYYTPMLUUQWTXTRSXSWMDMTRNDNSMJFJFFRMV"
    codes = one(spark, quality.codes("x"), x=text)
    assert (min(codes), max(codes)) == (68, 89)
    assert one(spark, quality.encodings(F.lit(68), F.lit(89))) == ["Illumina-1.3", "Illumina-1.5", "Sanger", "Solexa"]


def test_cigar(spark):
    c = "5S10M100N10M2I3D"
    assert one(spark, cigar.coverage("x"), x=c) == 20
    assert one(spark, cigar.reference_span("x"), x=c) == 123
    assert [tuple(r) for r in one(spark, cigar.exons(F.lit(1), "x"), x=c)] == [(0, 10), (110, 123)]
    blocks = F.array(F.struct(F.lit(0).alias("s"), F.lit(10).alias("e")), F.struct(F.lit(110).alias("s"), F.lit(120).alias("e")), F.struct(F.lit(123).alias("s"), F.lit(125).alias("e")))
    assert one(spark, cigar.build(blocks, F.array(F.lit(5), F.lit(15), F.lit(27)), F.lit(30))) == "5S10M100N10M2I3D2M1S"


@settings(max_examples=40, deadline=None)
@given(st.text("ACGT", max_size=9), st.text("ACGT", max_size=9))
def test_global_alignment_is_optimal(a, b):
    m, x, g = align.GLOBAL
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [best[i - 1, j] + g] if i else []
            ways += [best[i, j - 1] + g] if j else []
            ways += [best[i - 1, j - 1] + (m if a[i - 1] == b[j - 1] else x)] if i and j else []
            best[i, j] = max(ways, default=0)
    score, good, bad, ins, dele = align.needleman_wunsch(a, b)
    assert score == best[len(a), len(b)] == good * m + bad * x + (ins + dele) * g
    assert good + bad + dele == len(a) and good + bad + ins == len(b)


@settings(max_examples=40, deadline=None)
@given(st.text("ACGT", max_size=8), st.text("ACGT", max_size=8))
def test_local_alignment_is_optimal(q, t):
    m, x, o, e = align.LOCAL

    def pair(a, b):
        h, up, left = {}, {}, {}
        low = -(10**9)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                up[i, j] = max(h[i - 1, j] + o, up[i - 1, j] + e) if i else low
                left[i, j] = max(h[i, j - 1] + o, left[i, j - 1] + e) if j else low
                h[i, j] = max(0, up[i, j], left[i, j], h[i - 1, j - 1] + (m if a[i - 1] == b[j - 1] else x) if i and j else 0)
        return max(h.values())

    got = align.smith_waterman(q, t)
    assert got["score"] == pair(q, t)
    assert got["matches"] * m + got["mismatches"] * x <= got["score"] + 100


def test_running_sd_and_n50(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0)], "k int, i int, v double")
    got = stats.running_mean_sd(df, ["k"], ["i"], "v").orderBy("i").collect()
    assert [(r.running_mean, r.running_sd) for r in got] == [(1.0, None), (2.0, 1.0)]
    assert stats.n50(spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "n long"), "n").first()[0] == 3
    s = stats.summary(spark.createDataFrame([(float(n),) for n in (1, 2, 3, 4)], "v double"), "v").first()
    assert (s["median"], s["sd"]) == (2.5, 1.290994)
    assert stats.poisson_threshold(1.0, 0.9) == 2


def test_entropy_reduce(spark):
    rows = [(i, 1.0 if i < 3 else 0.0, 1.0 if 3 <= i < 6 else 0.0) for i in range(7)]
    kept = stats.entropy_reduce(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], 0.05)
    assert 2 <= kept.count() < 7


def _tx(*exons):
    return F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for s, e in exons])


def test_transcripts(spark):
    ex = _tx((0, 10), (30, 40), (200, 210))
    plain = lambda x: [tuple(r) for r in x]
    assert plain(one(spark, tr.smooth(ex, 68))) == [(0, 40), (200, 210)]
    assert plain(one(spark, tr.junctions(ex))) == [(10, 30), (40, 200)]
    assert plain(one(spark, tr.subset(ex, 5, 22))) == [(5, 10), (30, 40), (200, 202)]
    assert plain(one(spark, tr.clip(ex, F.lit(5), F.lit(35)))) == [(5, 10), (30, 35)]
    assert one(spark, tr.overlap_bp(ex, _tx((5, 35)))) == 10
    assert plain(one(spark, tr.intersection(ex, _tx((5, 35))))) == [(5, 10), (30, 35)]
    assert one(spark, tr.junctions_match(ex, _tx((3, 12), (28, 41), (199, 300)), 2))
    assert not one(spark, tr.junctions_match(ex, _tx((3, 12), (28, 41), (199, 300)), 1))
    assert one(spark, tr.longest_run(tr.matching_exons(ex, _tx((5, 6), (205, 206))))) == 1
    assert one(spark, tr.contains(ex, F.lit(39))) and not one(spark, tr.contains(ex, F.lit(40)))
    assert one(spark, tr.frames(_tx((0, 4), (10, 15), (20, 30)))) == [0, 2, 0]


def test_paths_and_chain(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 2, 4), ("g", 3, 4), ("g", 4, 5), ("g", 5, 4), ("h", 7, 8)], "grp string, a int, b int")
    assert sorted(map(tuple, (r.path for r in graph.paths(e, "grp").collect()))) == [(1, 2, 4), (1, 3, 4), (7, 8)]
    seg = [("r", 1, "c", "+", 0, 10, 0, 10, 10.0), ("r", 2, "c", "+", 12, 30, 500, 518, 18.0), ("r", 3, "d", "+", 12, 40, 0, 28, 25.0)]
    df = spark.createDataFrame(seg, "grp string, id long, chrom string, strand string, qs long, qe long, ts long, te long, score double")
    best = graph.best_chain(df, "grp", 5, 1000).first()
    assert (best.score, list(best.ids)) == (28.0, [1, 2])


def test_components_against_search(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == label


def test_simulation(spark):
    s = spark.createDataFrame([(1, "ACGT" * 100), (2, "GGCC" * 50)], "id long, seq string")
    reads = simulate.tiled_reads(s, 50, 2.0, 1)
    assert reads.groupBy("id").count().orderBy("id").collect()[0]["count"] == 16
    refs = {1: "ACGT" * 100, 2: "GGCC" * 50}
    assert all(refs[r.id][r.start : r.start + 50] == r.read for r in reads.collect())
    noisy = simulate.with_errors(reads, 0.2, 4).collect()
    assert 0 < sum(r.observed != r.read for r in noisy)
    assert all(r.observed == r.read for r in simulate.with_errors(reads, 0.0, 4).collect())
    got = simulate.emit(s.withColumn("w", F.when(F.col("id") == 1, 3).otherwise(1)), "w", 4000, 5).groupBy("id").count().collect()
    share = {r.id: r["count"] for r in got}
    assert sum(share.values()) == 4000 and 2800 < share[1] < 3200
    v = spark.createDataFrame([("c", 2, "C", "T", "1|0"), ("c", 3, "G", "A", "0|1"), ("c", 4, "T", "G", "1/1")], "chrom string, pos long, ref string, alt string, gt string")
    h = simulate.haplotypes(spark.createDataFrame([("c", "ACGT")], "chrom string, seq string"), v).first()
    assert (h.left, h.right) == ("ATGT", "ACAT")
    f = simulate.fusions(spark.createDataFrame([(i,) for i in range(9)], "id long"), 3, 2).collect()
    assert len({x for r in f for x in (r.left_id, r.right_id)}) == 6


def test_selection(spark):
    df = spark.createDataFrame([("r1/7/0_5", 3), ("r1/7/9_12", 9), ("x", 1)], "name string, n int").withColumn("m", select.molecule(F.col("name")))
    assert [r.n for r in select.best(df.where("m IS NOT NULL"), ["m"], [F.desc("n")]).collect()] == [9]
    assert select.drop_shortest(df, ["m"], "n", [F.col("name")], 1).count() == 2
