import hashlib

from pyspark.sql import functions as F
from tidemark import sources
from tidemark.functions import psl
from tidemark.operators import reads, simulate
from tidemark.operators import transcripts as tr

EX = "array<struct<s:bigint,e:bigint>>"


def ex(*p):
    return [{"s": a, "e": b} for a, b in p]


def test_spliced_coordinates(spark):
    d = spark.createDataFrame([("r", "c", ex((10, 20), (50, 60)))], f"ref string, chrom string, exons {EX}")
    got = d.select(*[tr.to_genomic("exons", F.lit(p)) for p in (0, 9, 10, 19, 20)], *[tr.from_genomic("exons", F.lit(p)) for p in (10, 19, 20, 50, 59, 60)]).first()
    assert list(got) == [10, 19, 50, 59, None, 0, 9, None, 10, 19, None]
    rows = spark.createDataFrame([(1, "r", 8, 12)], "id int, ref string, s bigint, e bigint")
    assert [tuple(x) for x in tr.lifted(rows, d).first().exons] == [(18, 20), (50, 52)]
    assert tr.lifted(rows, d, 20).count() == 0


def test_base_scores(spark):
    e = spark.createDataFrame([("t", "c", 0, 10)], "tx string, chrom string, s bigint, e bigint")
    c = spark.createDataFrame([("c", 0, 5, 1), ("c", 5, 8, 4), ("c", 8, 12, 0)], "chrom string, s bigint, e bigint, n int")
    r = tr.base_scores(e, c).first()
    assert (r.n, r.mean_score, r.median_score, r.n_zero, r.n_multi, r.n_single) == (10, 0.575, 0.625, 2, 3, 5)


def test_annotation_rates(spark):
    t = spark.createDataFrame([(1, "a", "g"), (2, "b", "g"), (3, "c", "h")], "read int, tx string, gene string")
    f = spark.createDataFrame([(1, "a", "g", True), (2, "a", "g", False)], "read int, tx string, gene string, full boolean")
    assert tuple(tr.annotation_rates(t, f).first()) == (3, 2, 1, 0, 2)


def test_joined_alignments(spark):
    s = "qName string, tName string, strand string, blockSizes array<bigint>, qStarts array<bigint>, tStarts array<bigint>"
    a = spark.createDataFrame([("q", "c", "+", [5], [0], [10])], s)
    b = spark.createDataFrame([("q", "c", "+", [5], [6], [40]), ("q", "c", "+", [5], [3], [40])], s)
    assert [list(r.tStarts) for r in psl.concatenated(a, b).collect()] == [[10, 40]]
    assert a.select(psl.flipped(F.col("strand"))).first()[0] == "-"


def test_best_by_base(spark):
    d = spark.createDataFrame([("q", 1, 0, 60, 0.9), ("q", 2, 50, 100, 0.8), ("q", 3, 10, 55, 0.7)], "q string, id int, qs bigint, qe bigint, quality double")
    assert sorted((r.id, r.qs, r.qe) for r in reads.best_by_base(d, "q", share=0.5).collect()) == [(1, 0, 60), (2, 60, 100)]
    assert sorted((r.id, r.qs, r.qe) for r in reads.best_by_base(d, "q", share=0.9).collect()) == [(1, 0, 60)]


def test_allele_reads_and_fragments(spark):
    t = spark.createDataFrame([(1, "c", "+", ex((0, 40)), 1.0, 1.0), (2, "c", "+", ex((0, 10), (20, 40)), 1.0, 0.0)], f"id bigint, chrom string, strand string, exons {EX}, w double, rho double")
    h = spark.createDataFrame([("c", "A" * 40, "C" * 40)], "chrom string, left string, right string")
    got = simulate.allele_reads(t, h, "w", "rho", 200, 3)
    rows = got.collect()
    assert len(rows) == 200 and all((r.allele, r.seq) == (("left", "A" * 40) if r.id == 1 else ("right", "C" * 30)) for r in rows)
    f = simulate.mates(simulate.fragments(got, 20, 5, 4, 9), 25).collect()
    assert all(r.fragment == r.seq[r.start : r.start + len(r.fragment)] and len(r.left) == len(r.right) == 25 for r in f)
    sizes = [len(r.fragment) for r in f]
    assert 17 < sum(sizes) / len(sizes) < 23 and len(set(sizes)) > 5


def test_file_sums(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    r = sources.file_sums(spark, str(tmp_path)).first()
    assert (r.length, r.md5) == (3, hashlib.md5(b"abc").hexdigest())
