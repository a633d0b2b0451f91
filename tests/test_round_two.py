"""Whole inputs, one-pass plans, written numbers, block files and further operators against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tidemark import sources
from tidemark.functions import psl, quality, seq
from tidemark.operators import intervals, kmers, select, stats
from tidemark.plans import catalog
from tidemark.sinks import bam


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation|LogicalRDD|LocalRelation|Range \(", plan))


def _rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = rnd.randrange(400)
        out.append((rnd.choice("ab"), s, s + rnd.randrange(0, 30)))
    return out


def _covered(rows):
    return {(c, p) for c, s, e in rows for p in range(s, e)}


def _runs(spots):
    out = []
    for c, p in sorted(spots):
        if out and out[-1][0] == c and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([c, p, p + 1])
    return [tuple(r) for r in out]


def test_subtract_and_intersect_of_positions(spark):
    a, b = _rows(60, 1), _rows(40, 2)
    da, db = (spark.createDataFrame(r, "chrom string, s long, e long") for r in (a, b))
    for f, want in ((intervals.subtract, _covered(a) - _covered(b)), (intervals.intersect, _covered(a) & _covered(b))):
        for width in (8, 1 << 14):
            got = f(da, db, width=width)
            assert sorted(map(tuple, got.collect())) == _runs(want)
        assert _scans(got) <= 8
    assert _scans(intervals.coverage(da)) <= 2


def test_overlap_joins_keep_repeated_rows(spark):
    a = spark.createDataFrame([("a", 0, 5, None), ("a", 0, 5, None), ("a", 50, 60, "x")], "chrom string, s long, e long, id string")
    b = spark.createDataFrame([("a", 3, 9, "q"), ("a", 4, 6, "r")], "chrom string, s long, e long, id string")
    assert intervals.overlap_join(a, b, how="left_semi").count() == 2 and intervals.overlap_join(a, b, how="left_anti").count() == 1
    left = intervals.overlap_join(a, b, how="left").collect()
    assert len(left) == 5 and sum(r.b_id is None for r in left) == 1


def test_nearest_against_brute_force(spark):
    a, b = _rows(80, 3), [(c, s, e + 1, i) for i, (c, s, e) in enumerate(_rows(25, 4))]
    a = [(c, s, e + 1, i) for i, (c, s, e) in enumerate(a)] + [("z", 1, 2, 900)]
    da, db = (spark.createDataFrame(r, "chrom string, s long, e long, id long") for r in (a, b))

    def gap(x, y):
        return 0 if x[1] < y[2] and y[1] < x[2] else y[1] - x[2] + 1 if y[1] >= x[2] else x[1] - y[2] + 1

    for width in (16, 1 << 14):
        got = {r.a_id: (r.b_id, r.distance) for r in intervals.nearest(da, db, width=width).collect()}
        for x in a:
            near = min(((gap(x, y), y[1], y[3]) for y in b if y[0] == x[0]), default=None)
            assert got[x[3]] == ((near[2], near[0]) if near else (None, None))


def test_long_sequences_are_cut_without_losing_kmers(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 7)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (0, 1, 4, 5, 6, 7, 8, 13, 14, 15, 60)]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    for k in (1, 5, 9):
        want = {}
        for t in texts:
            for i in range(len(t) - k + 1):
                want[t[i : i + k]] = want.get(t[i : i + k], 0) + 1
        assert {r.kmer: r.n for r in kmers.count(df, "seq", k).collect()} == want
    tiles = df.select(seq.tiles("seq", 4).alias("t"), "seq").collect()
    assert all("".join(x.piece for x in r.t) == r.seq and [x.i for x in r.t] == list(range(len(r.t))) for r in tiles)


def test_chunked_reference_slices(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("ACGT") for _ in range(100))
    chunks = seq.chunked(spark.createDataFrame([("c", text)], "name string, seq string"), 16)
    spots = [(i, "c", s, e) for i, (s, e) in enumerate([(0, 1), (15, 17), (16, 32), (0, 100), (90, 130), (5, 5), (120, 130)])]
    got = seq.slices(chunks, spark.createDataFrame(spots, "id long, name string, s long, e long"), 16).collect()
    assert {r.id: r.seq for r in got} == {i: text[s:e] for i, _, s, e in spots}


def test_running_totals_over_ranges(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(1, 9)) for i in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = {r.k: (r.total, r.place) for r in select.running_total(df, ["k"], {"n": "total", "1": "place"}).collect()}
    total = 0
    for place, (k, n) in enumerate(sorted(rows), 1):
        total += n
        assert got[k] == (total, place)
    parts = {r.k: r.part for r in seq.break_by_length(df, "n", 50, ["k"], 7).collect()}
    run = 0
    for place, (k, n) in enumerate(sorted(rows)):
        run += n
        assert parts[k] == max((run - 1) // 50, place // 7)


def test_collapsed_runs(spark):
    df = spark.createDataFrame([([3, 1, 2, 2, 9, 7, 8, 20],), ([],), ([5],)], "xs array<long>")
    assert [r[0] for r in df.select(seq.collapse_coordinates("xs")).collect()] == ["1-3,7-9,20-20", "", "5-5"]


def test_poisson_threshold_of_large_rates():
    assert stats.poisson_threshold(1000.0, 0.95) == 1052
    assert stats.poisson_threshold(2.0, 0.5) == 2 and stats.poisson_threshold(0, 0.9) == 0


def test_scores_of_counts_that_are_zero(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 1, 2])], "k string, i long, c long")
    r = stats.window_scores(df, ["k"], "i", "c", 3, 9).collect()[0]
    assert r.mean_score == pytest.approx((1e-7 + 1 + 0.5) / 3) and r.median_score == 0.5 and r.geometric_score == pytest.approx((1e-7 * 0.5) ** (1 / 3), abs=1e-9)


def test_encodings_by_range_and_by_counts(spark):
    q = "DLXYXXRXWYYTPMLUUQWTXTRSXSWMDMTRNDNSMJFJFFRMV"  # codes 68 to 89
    df = spark.createDataFrame([(1, q), (2, "!!!!"), (3, "hhhhBBBB"), (4, "hhhhCCCC"), (5, ""), (6, "iiii####"), (7, ";;;;hhhh")], "id long, qual string")
    got = df.where("qual <> ''").select("id", quality.encodings(F.array_min(quality.codes("qual")), F.array_max(quality.codes("qual"))).alias("n"))
    assert sorted(next(r.n for r in got.collect() if r.id == 1)) == ["Illumina-1.3", "Illumina-1.5", "Sanger", "Solexa"]
    assert {r.id: r.kind for r in quality.called(df, "qual", ["id"]).collect()} == {1: "J", 2: "S", 3: "I", 4: "J", 6: "P", 7: None}


def test_block_files_are_read_again(spark, tmp_path):
    rnd = random.Random(8)
    data = bytes(rnd.randrange(256) for _ in range(200_000)) + b"a" * 100_000
    packed = bam.bgzf(data)
    assert bam.unbgzf(packed) == data and bam.unbgzf(b"") == b"" and len(sources.bgzf_blocks(packed + bam.END)) == 6
    rows = [(f"r{i}", 16 if i % 3 else 0, "c1" if i % 2 else "*", i + 1, 7, "5M2N3M" if i % 2 else "*", "=" if i % 4 == 1 else "*", i, -i, "ACGTNACG"[: 8 if i % 2 else 0] or "*", "IIIIIIII" if i % 2 else "*", {"NM": "3", "XS": "+"}) for i in range(50)]
    sam = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>")
    made = bam.files(sam, [("c1", 1000)], F.when(F.col("rname") == "*", "unaligned").otherwise(F.col("rname")), 10)
    bam.write(made, f"file://{tmp_path}/out")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert {n.split(".")[0] for n in names} == {"c1", "unaligned"} and len(names) > 2
    got = sources.bam(spark, f"{tmp_path}/out").collect()
    want = sorted(tuple(r[:6]) + (("c1" if r[6] == "=" else r[6]),) + tuple(r[7:11]) for r in rows)
    assert sorted(tuple(r)[:11] for r in got) == want and all(r.tags == {"NM": "3", "XS": "+"} for r in got)


def test_supplementary_layouts(spark):
    df = spark.createDataFrame([("q", "c1,5,-,3M,60,1;c2,+7,4M,30;c3,-8,2M,9,0;", "c4,-11,6M,2;")], "qname string, sa string, xa string")
    got = {(r.rname, r.flag, r.pos, r.mapq, r.cigar) for r in psl.supplementary(df, F.col("sa"), F.col("xa")).collect()}
    assert got == {("c1", 16, 5, 60, "3M"), ("c2", 0, 7, 30, "4M"), ("c3", 16, 8, 9, "2M"), ("c4", 16, 11, 0, "6M")}
    with pytest.raises(Exception, match="cannot be read"):
        psl.supplementary(df.withColumn("sa", F.lit("nonsense")), F.col("sa")).collect()


def test_sort_fields(spark):
    df = spark.createDataFrame([("b", "10"), ("a", "9"), ("a", "10")], "x string, y string")
    assert [tuple(r) for r in df.orderBy(*select.field_order("1,2n", df.columns)).collect()] == [("a", "9"), ("a", "10"), ("b", "10")]
    assert [r.y for r in df.orderBy(*select.field_order("2ni,1i", df.columns)).collect()] == ["10", "10", "9"]
    for bad in ("0", "3", "1x", "1nn", ""):
        with pytest.raises(ValueError):
            select.field_order(bad, df.columns)


def test_survival_curve_and_p_value(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (2, 1, 1), (5, 0, 1)]
    got = stats.kaplan_meier(spark.createDataFrame(rows, "t long, ev long, g long"), "t", "ev", "g").collect()
    assert {(r.g, r.t, r.at_risk, r.events, r.survival) for r in got} == {(0, 1, 4, 1, 0.75), (0, 3, 2, 2, 0.0), (1, 2, 2, 1, 0.5)}
    assert stats.chi2_p_value(3.841458820694124) == pytest.approx(0.05)


@pytest.mark.parametrize("name", ["graph_roots", "unsupported_junction_pairs", "single_mates", "pair_mates"])
def test_queries_that_must_not_be_empty(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
