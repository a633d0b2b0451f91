"""Figures that must not grow faster than the input, and results of the ways that keep them down, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tidemark import sources, tables
from tidemark.sinks import bam
from tidemark.operators import assignment, coverage, graph, junctions, kmers, nonredundant, superkmers

_TURN = str.maketrans("ACTGUNXactgunx", "TGACANXtgacanx")


def _runs(seqs, k, strands):
    windows = {n: [s[i : i + k] for i in range(len(s) - k + 1)] for n, s in seqs.items()}
    times = {}
    for w in itertools.chain(*windows.values()):
        times[w] = times.get(w, 0) + 1
    want = []
    for n, ws in windows.items():
        at = 0
        for v, run in itertools.groupby(times[w] + (times.get(w[::-1].translate(_TURN), 0) if strands and w != w[::-1].translate(_TURN) else 0) for w in ws):
            m = len(list(run))
            want.append((n, at, at + m, v))
            at += m
    return sorted(want)


@pytest.mark.parametrize("strands", [False, True])
@pytest.mark.parametrize("k, letters", [(1, "AC"), (2, "ACGT"), (5, "ACGTUNacgtü𝄞"), (34, "ACGT")])
def test_mappability_of_odd_letters(spark, monkeypatch, strands, k, letters):
    monkeypatch.setattr(superkmers, "BUCKET", 300)
    rnd = random.Random(k)
    part = "".join(rnd.choice(letters) for _ in range(60))
    seqs = {f"s{i}": "".join(rnd.choice([rnd.choice(letters), part[:20], part, part[::-1].translate(_TURN)]) for _ in range(20)) for i in range(12)}
    seqs |= {"same": seqs["s0"], "empty": "", "short": "A", "one": "A" * 300}
    rows = [(n, s) for n, s in seqs.items()] + [("none", None)]
    got = kmers.mappability(spark.createDataFrame(rows, "name string, seq string"), k, strands, 40)
    assert sorted(tuple(r) for r in got.collect()) == _runs(seqs, k, strands)


@pytest.fixture
def written(monkeypatch):
    """The rows of each table that is written."""
    rows, plain = [], tables.kept

    def kept(df, name):
        out = plain(df, name)
        rows.append(out.count())
        return out

    for module in (tables, coverage, graph):
        monkeypatch.setattr(module, "kept", kept)
    return rows


def test_mappability_writes_no_row_a_window(spark, written):
    rnd = random.Random(1)
    seqs = [(i, "".join(rnd.choice("ACGT") for _ in range(2000))) for i in range(8)]
    assert kmers.mappability(spark.createDataFrame(seqs, "name long, seq string"), 20, True, 512).count() == 8
    assert sum(written) < 16000 / 20


@pytest.mark.parametrize("width", [8, None])
def test_genes_at_spots_of_many_transcripts(spark, width):
    rnd = random.Random(16)
    tx = [(rnd.choice(["A", "B", "MIR1", "C-x"]), rnd.choice("xy"), s, s + rnd.randrange(0, 25)) for _ in range(150) for s in [rnd.randrange(-20, 200)]]
    spots = [(i // 2 if i < 40 else i, rnd.choice("xyz"), s, s + rnd.randrange(0, 12)) for i in range(120) for s in [rnd.randrange(-20, 220)]]
    want = []
    for i in (r[0] for r in spots):
        best = {}
        for j, c, s, e in spots:
            for g, gc, gs, ge in tx:
                if j == i and gc == c and s < ge and gs < e:
                    best[g] = max(best.get(g, 0), ge - gs)
        want.append((i, sorted(best, key=lambda g: ("-" in g or g.startswith("MIR"), -best[g], g))))
    table = spark.createDataFrame(tx, "gene string, chrom string, s long, e long")
    got = assignment.genes_at(spark.createDataFrame(spots, "id long, chrom string, s long, e long"), table, width)
    assert sorted((r.id, r.genes) for r in got.collect()) == sorted(want)


def test_genes_at_spots_writes_no_row_a_transcript_and_spot(written, spark):
    spots = spark.range(400).selectExpr("id", "0L AS chrom", "id AS s", "id + 200 AS e")
    tx = spark.range(400).selectExpr("'g' AS gene", "0L AS chrom", "id AS s", "id + 150 AS e")
    got = assignment.genes_at(spots, tx, 64)
    assert got.where("genes = array('g')").count() == 400
    assert max(written) <= 1200


def test_clusters_of_a_hot_locus_write_no_pairs(written, spark):
    tx = spark.range(600).selectExpr("id", "0L AS chrom", "array(named_struct('s', id, 'e', id + 700), named_struct('s', 2000 + 10 * id, 'e', 2010 + 10 * id)) AS exons")
    assert nonredundant.clustered(tx, "any").where("component = 0").count() == 600
    assert max(written) <= 2400


def test_tasks_of_bam_files_grow_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(bam, "TASK", 40)
    sam = spark.range(2000).selectExpr("'r' || id AS qname", "0 AS flag", "'c' || id % 2 AS rname", "int(id) + 1 AS pos", "9 AS mapq", "'3M' AS cigar", "'*' AS rnext", "0 AS pnext", "0 AS tlen", "'ACG' AS seq", "'*' AS qual", "map('NM', '1') AS tags")
    got = bam.files(sam, [("c0", 5000), ("c1", 5000)], F.col("rname"), 20).select("name", "part", F.spark_partition_id().alias("task")).collect()
    assert len({(r.name, r.part) for r in got}) == len(got) and {r.name for r in got} == {"c0", "c1"}
    tasks = [r.task for r in got]
    assert len(set(tasks)) > 20 and max(map(tasks.count, tasks)) <= 10


def test_supported_reads_parse_each_alignment_string_once(spark, written):
    rnd = random.Random(29)
    cigars = ["30M80N20M", "5M80N40M90N20M", "20M10I70N3D30M", "50M", "*", "12M67N12M", "40M100N9M200N40M", "4S20M80N20M2H"]
    rows = [(f"r{i // 2}", rnd.choice([0, 0, 16, 4]), rnd.choice("ab"), rnd.choice([1, 1, 2, None]), rnd.choice([*cigars, None])) for i in range(400)]
    sam = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string").withColumn("tags", F.expr("map('NH', named_struct('type', 'i', 'value', '1'))"))
    j = junctions.of_alignments(sam).where("left_size >= 10 AND right_size >= 10")
    good = junctions.table(j).where("reads >= 6")
    want = sam.join(j.join(good, ["chrom", "l", "r"]).select("qname").distinct(), "qname", "left_semi").drop("tags").collect()
    got = junctions.supported_reads(sam, overhang=10, support=6).drop("tags").collect()
    key = lambda r: str(tuple(r))
    assert 0 < len(want) < len(rows) and sorted(got, key=key) == sorted(want, key=key)
    assert written == [4]  # a row a junction of enough overhang


def test_fastq_over_splits_sorts_no_file(spark, tmp_path):
    rnd = random.Random(28)
    rows = []
    for f in range(3):
        own = [(f"f{f}r{i}", "ACGT" * n, "@I!~" * n) for i in range(150 * f + 1) for n in [rnd.randrange(0, 9)]]
        rows += own
        (tmp_path / f"x{f}.fastq").write_text("".join(f"@{n}\tmore\n{s}\n+\n{q}\n" for n, s, q in own))
    (tmp_path / "y.fastq").write_text("@cut\nAC\n+\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = sources.fastq(spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
        # the only window runs over the splits' counts
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "Window [sum(n" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
