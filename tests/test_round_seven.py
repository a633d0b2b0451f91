"""Work that grows no faster than the input, and results of the ways that keep it down, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tidemark import tables
from tidemark.operators import coverage, fileorder, graph, kmers, running, superkmers


@pytest.fixture
def written(monkeypatch):
    """The names of the tables that are written."""
    names, plain = [], tables.kept

    def kept(df, name):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(tables, "kept", kept)
    monkeypatch.setattr(graph, "kept", kept)
    monkeypatch.setattr(coverage, "kept", kept)
    return names


def test_a_ring_does_not_prolong_paths(spark, written):
    """Before, any ring made the rounds go on until twice the number of edges was looked back over."""
    paths = [(100 * p + i, 100 * p + i + 1, 2) for p in range(40) for i in range(3)]
    edges = [*paths, (9001, 9002, 1), (9002, 9000, 5), (9000, 9001, 3), (9100, 9100, 7)]
    got = {r.id: (r.head, r.distance) for r in graph.ranked_paths(spark.createDataFrame(edges, "a long, b long, step long")).collect()}
    want = {100 * p + i: (100 * p, 2 * i) for p in range(40) for i in range(4)}
    assert got == want | {9000: (9000, 0), 9001: (9000, 3), 9002: (9000, 4), 9100: (9100, 0)}
    assert written.count("paths") <= 8


def test_paths_and_rings_of_all_lengths(spark):
    rnd, edges, want, at = random.Random(22), [], {}, 0
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 64]:
        for ring in (False, True):
            ids = rnd.sample(range(at, at + n), n)
            at += n
            steps = [rnd.randrange(1, 5) for _ in ids]
            edges += [(ids[i], ids[(i + 1) % n], steps[i]) for i in range(n if ring else n - 1)]
            first = ids.index(min(ids)) if ring else 0
            if n > 1 or ring:
                far = 0
                for i in range(n):
                    want[ids[(first + i) % n]] = (ids[first], far)
                    far += steps[(first + i) % n]
    got = graph.ranked_paths(spark.createDataFrame(edges, "a long, b long, step long"))
    assert sorted((r.id, (r.head, r.distance)) for r in got.collect()) == sorted(want.items())


@pytest.mark.parametrize("k, letters", [(1, "AC"), (14, "ACGT"), (5, "ACGTUNacgtü𝄞"), (34, "AC")])
def test_frequent_kmers(spark, monkeypatch, k, letters):
    monkeypatch.setattr(superkmers, "BUCKET", 300)
    rnd = random.Random(k)
    part = "".join(rnd.choice(letters) for _ in range(60))
    seqs = ["".join(rnd.choice([rnd.choice(letters), part]) for _ in range(20)) for _ in range(12)] + ["", "A", None]
    reads = spark.createDataFrame([(s,) for s in seqs], "seq string")
    times = {}
    for s in filter(None, seqs):
        for i in range(len(s) - k + 1):
            times[s[i : i + k]] = times.get(s[i : i + k], 0) + 1
    for least in (1, 4):
        got = kmers.frequent(reads, "seq", k, least, 50)
        assert sorted(tuple(r) for r in got.collect()) == sorted((s, n) for s, n in times.items() if n >= least)


def test_frequent_kmers_make_no_row_of_a_rare_one(spark):
    rnd = random.Random(5)
    reads = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(2000)),)], "seq string")
    got = kmers.frequent(reads, "seq", 14, 10)
    assert got.count() == 0 and "Generate" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Generate") == 1


@pytest.fixture
def files(spark, tmp_path):
    """Files of several texts, read in splits of a few lines: name -> lines ``text tab flag tab number``."""
    rnd, out = random.Random(19), {}
    for f in range(3):
        flags = [(t, rnd.choice("AAN")) for t in range(3 * f, 3 * f + 3) for _ in range(rnd.randrange(0, 90))]
        out[f"x{f}.txt"] = [f"{t}\t{flag}\t{i}" for i, (t, flag) in enumerate(flags)]
        (tmp_path / f"x{f}.txt").write_text("".join(x + "\n" for x in out[f"x{f}.txt"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    yield fileorder.lines(spark, str(tmp_path)), out
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("gaps", [False, True])
def test_runs_and_records_across_splits(files, monkeypatch, gaps):
    monkeypatch.setattr(fileorder, "BLOCK", 7)
    lines, want = files
    if gaps:  # ids no longer follow one another
        lines = lines.where("value NOT LIKE '%5'")
        want = {f: [x for x in xs if not x.endswith("5")] for f, xs in want.items()}
    p, name = F.split("value", "\t"), F.substring_index("file", "/", -1)
    got = fileorder.runs(lines, p[1], at=p[2]).select(name, "run", "n", "first.at", "last.at").collect()
    runs = []
    for f, xs in want.items():
        for i, (_, g) in enumerate(itertools.groupby(xs, lambda x: x.split("\t")[1])):
            g = [x.split("\t")[2] for x in g]
            runs.append((f, i + 1, len(g), g[0], g[-1]))
    assert sorted(tuple(r) for r in got) == sorted(runs)
    got = fileorder.records(lines, 4, ["a", "b", "c", "d"]).select(name, "record", "a", "b", "c", "d").collect()
    assert sorted(tuple(r) for r in got) == sorted((f, i // 4, *xs[i : i + 4]) for f, xs in want.items() for i in range(0, len(xs) - 3, 4))
    got = fileorder.records(lines, 4, ["a", "b", "c", "d"], key=p[0]).select("key", "record", "a", "b", "c", "d").collect()
    texts = [list(g) for xs in want.values() for _, g in itertools.groupby(xs, lambda x: x.split("\t")[0])]
    assert sorted(tuple(r) for r in got) == sorted((xs[0].split("\t")[0], i // 4, *xs[i : i + 4]) for xs in texts for i in range(0, len(xs) - 3, 4))


def test_files_do_not_grow_with_the_suppliers(spark, monkeypatch):
    from tidemark.plans import file_queries

    paths, plain = [], fileorder.lines
    monkeypatch.setattr(fileorder, "lines", lambda s, path: paths.append(path) or plain(s, path))
    for query in (file_queries.neighbours, file_queries.lines_of_four):
        query(spark, "/root/testdata/sf0.01")
    assert len(paths) == 2
    for path in paths:
        assert len(spark.read.text(path).inputFiles()) <= spark.sparkContext.defaultParallelism


def _depths(hits):
    out = {}
    for c, s, e, n in hits:
        for p in range(s, e):
            out[c, p] = out.get((c, p), 0) + n
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_least_depth_of_few_and_of_hot_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(running, "HOT", 20 if hot else 1000)
    rnd = random.Random(21)
    rows = [(i, rnd.choice("ab"), s, s + rnd.choice([0, 1, 2, 5, 30, 90]), rnd.randrange(1, 9)) for i in range(120) for s in [rnd.randrange(-40, 200)]]
    rows += [(200, "c", 3, 4, 5), (201, "c", 3, 4, 6), (202, "c", 9, 9, 2), (203, "c", 5, None, 2)]
    depth = _depths([(c, s, e, n) for _, c, s, e, n in rows if e is not None])
    want = {i: min((depth[c, p] for p in range(s, s if e is None else e)), default=None) for i, c, s, e, _ in rows}
    got = coverage.thinned(spark.createDataFrame(rows, "id long, chrom string, s long, e long, n long"), 12, 7, 16)
    assert {r.id: r.least for r in got.collect()} == want and got.count() == len(rows)


def _ladder(reads, join_gap, chain_gap):
    out = []
    for c in {r[0] for r in reads}:
        depth = _depths([(*r, 1) for r in reads if r[0] == c])
        for level in (1, 2, 4, 8, 16, 32):
            exons = []
            for p in sorted(p for (_, p), n in depth.items() if n >= level):
                if exons and p <= exons[-1][1] + join_gap:
                    exons[-1][1] = p + 1
                else:
                    exons.append([p, p + 1])
            chains = []
            for x in exons:
                if chains and x[0] <= chains[-1][-1][1] + chain_gap:
                    chains[-1].append(x)
                else:
                    chains.append([x])
            out += [(c, level, [tuple(x) for x in chain]) for chain in chains]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_ladder_of_few_and_of_hot_rows(spark, written, monkeypatch, hot):
    monkeypatch.setattr(running, "HOT", 20 if hot else 1000)
    rnd = random.Random(33)
    rows = [(rnd.choice("ab"), s, s + rnd.choice([0, 1, 3, 7, 20])) for _ in range(150) for s in [rnd.choice([rnd.randrange(0, 400), rnd.randrange(0, 30)])]]
    known = [("a", 50, 90), ("a", 50, 60), ("b", 0, 3), ("b", 200, 230), ("c", 0, 400)]
    table = lambda x: spark.createDataFrame(x, "chrom string, s long, e long")
    shown = lambda df: sorted((r.chrom, r.level, [tuple(x) for x in r.exons]) for r in df.collect())
    assert shown(coverage.ladder(table(rows), 2, 9, 16)) == _ladder(rows, 2, 9)
    assert hot or not written  # where no key is hot nothing is written in between
    far = [r for r in rows if r[1] < r[2] and not any(k[0] == r[0] and k[1] < r[2] and r[1] < k[2] for k in known)]
    assert 0 < len(far) < len(rows) and shown(coverage.novel(table(rows), table(known), 2, 9, 16)) == _ladder(far, 2, 9)


def test_tasks_of_transcripts_grow_with_the_lines(spark, monkeypatch):
    from tidemark.plans import views

    monkeypatch.setattr(running, "TASK", 500)
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert views.tx(spark, d).rdd.getNumPartitions() == -(-lines // 500)
    tasks = views.by_id(spark.range(9000)).groupBy(F.spark_partition_id()).count()
    assert tasks.count() == 18 and tasks.agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("hot", [False, True])
def test_consensus_of_few_and_of_hot_rows(spark, monkeypatch, hot):
    from tidemark.operators import nonredundant

    monkeypatch.setattr(running, "HOT", 20 if hot else 1000)
    monkeypatch.setattr(running, "TASK", 25)
    tx = spark.range(200).selectExpr("id", "id % 4 AS chrom", "array(named_struct('s', 100 * (id div 8), 'e', 100 * (id div 8) + 20), named_struct('s', 100 * (id div 8) + 40, 'e', 100 * (id div 8) + 60)) AS exons")
    got = nonredundant.consensus(tx, 1, 1, width=64)
    want = {(c, 100 * g, (8 * g + c, 8 * g + c + 4)) for c in range(4) for g in range(25)}
    assert {(r.chrom, r.exons[0].s, tuple(r.ids)) for r in got.collect()} == want
    # loci are handled where their chromosome's rows met, in as many tasks as there are rows for
    assert hot or "hashpartitioning(chrom" in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.split("Initial Plan")[0].count("Exchange") == 1
