"""Gap repair, contigs, mappability, depth ladder, thinning, file order and compressed coordinates against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from tidemark import sinks, sources
from tidemark.functions import seq
from tidemark.operators import assignment, compression, coverage, fileorder, kmers, stitch


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def ranges(spark, rows, schema="id long, chrom string, s long, e long"):
    return spark.createDataFrame(rows, schema).repartition(3)


# gap repair


def segment(read, strand, exons, q_s, q_e, chrom="c"):
    return read, chrom, strand, exons, q_s, q_e


SEGMENT = "read string, chrom string, strand string, exons array<struct<s:bigint,e:bigint>>, q_s long, q_e long"


def genome(sites, n=600):
    g = ["A"] * n
    for at, letters in sites:
        g[at : at + len(letters)] = letters
    return "".join(g)


def joined(spark, segments, g, known=None, **how):
    chunks = seq.chunked(spark.createDataFrame([("c", g)], "name string, seq string"), 64)
    known = known and spark.createDataFrame(known, "chrom string, l long, r long")
    got = stitch.stitched(spark.createDataFrame(segments, SEGMENT), chunks, 64, known, **how).collect()
    return sorted((r.read, r.part, r.n, r.q_s, r.q_e, [(x.s, x.e) for x in r.exons]) for r in got)


def test_parts_join_at_the_nearest_signal_of_the_best_kind(spark):
    two = [segment("r", "+", [(10, 50), (60, 100)], 0, 90), segment("r", "+", [(300, 340)], 92, 132)]
    # GT two letters before the left end, AG that ends two letters before the right start
    g = genome([(98, "GT"), (296, "AG")])
    assert joined(spark, two, g) == [("r", 1, 2, 0, 132, [(10, 50), (60, 98), (298, 340)])]
    # a nearer AT-AC does not win over it; the minus strand reads the signals turned
    assert joined(spark, two, genome([(98, "GT"), (296, "AG"), (100, "AT")]))[0][5] == [(10, 50), (60, 98), (298, 340)]
    minus = [segment("r", "-", [(10, 100)], 0, 90), segment("r", "-", [(300, 340)], 92, 132)]
    assert joined(spark, minus, genome([(101, "CT"), (298, "AC")]))[0][5] == [(10, 101), (300, 340)]
    assert len(joined(spark, minus, g)) == 2
    # a known junction needs no signal
    assert joined(spark, two, genome([]), [("c", 99, 301)])[0][5] == [(10, 50), (60, 99), (301, 340)]
    assert len(joined(spark, two, genome([]), [("c", 80, 301)])) == 2


def test_parts_that_do_not_join(spark):
    g = genome([(100, "GT"), (298, "AG")])
    far = [segment("r", "+", [(10, 100)], 0, 90), segment("r", "+", [(300, 340)], 101, 132)]
    assert [r[1:3] for r in joined(spark, far, g)] == [(1, 1), (2, 1)]
    near = [segment("r", "+", [(10, 100)], 0, 90), segment("r", "+", [(300, 340)], 90, 132)]
    assert [r[1:3] for r in joined(spark, near, g)] == [(1, 2)]
    assert [r[1:3] for r in joined(spark, near, g, max_intron=150)] == [(1, 1), (2, 1)]
    assert [r[1:3] for r in joined(spark, near, g, min_intron=300)] == [(1, 1), (2, 1)]
    three = [*near, segment("r", "+", [(450, 500)], 132, 180), segment("s", "+", [(5, 9)], 0, 4)]
    assert [r[:3] for r in joined(spark, three, g)] == [("r", 1, 2), ("r", 2, 1), ("s", 1, 1)]


# contigs


def brute_contigs(table, least):
    every = [(a, o, b) for a in table for b in table if a != b for o in range(least, min(len(a), len(b))) if a.endswith(b[:o])]
    best = lambda k, x: max([e[1] for e in every if e[k] == x], default=None)
    nxt = {}
    for a in table:
        o = best(0, a)
        if o is not None:
            to = [e[2] for e in every if e[0] == a and e[1] == o]
            if len(to) == 1 and best(2, to[0]) == o and [e[0] for e in every if e[2] == to[0] and e[1] == o] == [a]:
                nxt[a] = (to[0], o)
    behind = {b for b, _ in nxt.values()}
    out, seen = [], set()
    for h in [*sorted(set(table) - behind), *sorted(table)]:
        if h in seen:
            continue
        text, n, k, x = h, table[h], 1, h
        seen.add(h)
        while x in nxt and nxt[x][0] not in seen:
            x, o = nxt[x]
            text, n, k = text + x[o:], n + table[x], k + 1
            seen.add(x)
        out.append((text, k, n))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contigs(spark, seed):
    rnd = random.Random(seed)
    g = "".join(rnd.choice("ACGT") for _ in range(70))
    table = {g[i : i + 7]: rnd.randrange(1, 9) for i in range(0, 60) if rnd.random() < 0.8}
    ring = "".join(rnd.choice("ACGT") for _ in range(12))
    table |= {(ring * 2)[i : i + 9]: 1 for i in range(12)}
    table |= {"A" * 9: 2, "ACACACAC": 1}
    df = spark.createDataFrame(list(table.items()), "kmer string, n long").repartition(3)
    assert sorted(tuple(r) for r in kmers.assembled(df, 4).collect()) == brute_contigs(table, 4)


# mappability


@pytest.mark.parametrize("strands", [False, True])
def test_mappability_over_pieces(spark, strands):
    rnd = random.Random(5)
    part = "".join(rnd.choice("ACGT") for _ in range(40))
    seqs = {"a": "".join(rnd.choice("ACGT") for _ in range(90)) + part, "b": part + "TT" + turned(part), "c": "ACG", "d": "A" * 50}
    k, times = 6, {}
    for s in seqs.values():
        for i in range(len(s) - k + 1):
            times[s[i : i + k]] = times.get(s[i : i + k], 0) + 1
    want = []
    for n, s in seqs.items():
        count = [times[w] + (times.get(turned(w), 0) if strands and w != turned(w) else 0) for w in (s[i : i + k] for i in range(len(s) - k + 1))]
        at = 0
        for v, run in itertools.groupby(count):
            m = len(list(run))
            want.append((n, at, at + m, v))
            at += m
    got = kmers.mappability(spark.createDataFrame(list(seqs.items()), "name string, seq string"), k, strands, 16)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# depth


def depths(rows, n=400):
    d = {}
    for _, c, s, e in rows:
        for p in range(s, e):
            d[c, p] = d.get((c, p), 0) + 1
    return d


def test_ladder(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("ab"), s, s + rnd.randrange(1, 30)) for i in range(60) for s in [rnd.randrange(350)]]
    d = depths(rows)
    want = []
    for c in "ab":
        level = 1
        while level <= max(v for (x, _), v in d.items() if x == c):
            exons = []
            for p in sorted(p for (x, p), v in d.items() if x == c and v >= level):
                if exons and p - exons[-1][1] <= 3:
                    exons[-1][1] = p + 1
                else:
                    exons.append([p, p + 1])
            loci = []
            for x in exons:
                if loci and x[0] - loci[-1][-1][1] <= 20:
                    loci[-1].append(x)
                else:
                    loci.append([x])
            want += [(c, level, [tuple(x) for x in locus]) for locus in loci]
            level *= 2
    got = coverage.ladder(ranges(spark, rows), 3, 20, 64).collect()
    assert sorted((r.chrom, r.level, [(x.s, x.e) for x in r.exons]) for r in got) == sorted(want)
    known = ranges(spark, [(1, "a", 0, 200)])
    far = [r for r in rows if r[1] == "b" or r[2] >= 200]
    assert {(r.chrom, r.level, r.exons[0].s) for r in coverage.novel(ranges(spark, rows), known, 3, 20, 64).collect()} == {(r.chrom, r.level, r.exons[0].s) for r in coverage.ladder(ranges(spark, far), 3, 20, 64).collect()}


def test_least_under_ranges(spark):
    rnd = random.Random(7)
    cuts = sorted(rnd.sample(range(1000), 120))
    segments = [("a", s, e, rnd.randrange(1, 50)) for s, e in zip(cuts[::2], cuts[1::2])] + [("b", 5, 6, 3)]
    spans = [(i, rnd.choice("aab"), s, s + rnd.randrange(0, 300)) for i in range(200) for s in [rnd.randrange(1000)]]
    want = {i: min([v for c2, s2, e2, v in segments if c2 == c and s2 < e and s < e2 and s < e], default=None) for i, c, s, e in spans}
    got = coverage.least_under(ranges(spark, spans), spark.createDataFrame(segments, "chrom string, s long, e long, depth long"), width=50)
    assert {r.id: r.least for r in got.collect()} == want
    assert coverage.least_under(ranges(spark, spans[:3]), spark.createDataFrame([], "chrom string, s long, e long, depth long")).where("least is not null").count() == 0


def test_thinned(spark):
    rnd = random.Random(8)
    hits = [(i, "a", s, s + 40, rnd.randrange(1, 5)) for i in range(150) for s in [rnd.randrange(60)]] + [(500, "b", 1, 5, 3), (501, "b", 9, 9, 2)]
    d = {}
    for _, c, s, e, n in hits:
        for p in range(s, e):
            d[c, p] = d.get((c, p), 0) + n
    want = {}
    for i, c, s, e, n in hits:
        least = min([d[c, p] for p in range(s, e)], default=None)
        draws = [int(hashlib.md5(f"1|{i}|{k}".encode()).hexdigest()[:8], 16) for k in range(1, n + 1)]
        want[i] = (least, n if (least or 0) <= 20 else sum(x * least < 20 * 2**32 for x in draws))
    got = coverage.thinned(ranges(spark, hits, "id long, chrom string, s long, e long, n long"), 20, width=16).collect()
    assert {r.id: (r.least, r.kept) for r in got} == want and sum(r.kept for r in got) < sum(h[4] for h in hits) / 3


# file order


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_runs_and_records_across_splits(spark, tmp_path, small_splits):
    rnd = random.Random(9)
    want_runs, want_records = [], []
    for f in ("one.txt", "two.txt"):
        keys = []
        while len(keys) < 400:
            keys += [rnd.choice("xyz")] * rnd.choice([1, 1, 2, 3, 60])
        text = [f"{k}\t{i}" + "." * rnd.randrange(30) for i, k in enumerate(keys)]
        text[57] += "long" * 200  # a line longer than several splits
        (tmp_path / f).write_text("\n".join(text) + "\n")
        run = 0
        for k, own in itertools.groupby(enumerate(text), lambda x: x[1][0]):
            own = list(own)
            run += 1
            want_runs.append((f, run, len(own), k, [i for i, _ in own]))
        want_records += [(f, k, *text[4 * k : 4 * k + 4]) for k in range(len(text) // 4)]
    lines = fileorder.lines(spark, str(tmp_path))
    assert lines.select("split").distinct().count() > 20
    p = F.split("value", "\t")
    got = fileorder.grouped(lines, p[0], key=p[0], i=F.regexp_extract(p[1], r"^(\d+)", 1).cast("int")).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.run, r.n, r.rows[0].key, [x.i for x in r.rows]) for r in got) == sorted(want_runs)
    got = fileorder.records(lines, 4, ["a", "b", "c", "d"]).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.record, r.a, r.b, r.c, r.d) for r in got) == sorted(want_records)
    assert sorted(r.line for r in fileorder.numbered(lines).where("file like '%one.txt'").collect()) == list(range(len((tmp_path / "one.txt").read_text().splitlines())))


def test_null_keys_make_runs(spark):
    rows = spark.createDataFrame([("f", 0, i, k) for i, k in enumerate([None, None, "a", None, "a", "a"])], "file string, split long, at long, k string")
    assert [r.run for r in fileorder.consecutive(rows, F.col("k")).orderBy("at").collect()] == [1, 1, 2, 3, 4, 4]


# compressed coordinates


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_runs_and_lifts_over_chunks(spark, size):
    rnd = random.Random(10)
    seqs = {"a": "".join(rnd.choice("ACGT") * rnd.choice([1, 1, 2, 5, 20]) for _ in range(60)), "b": "A" * 30, "c": "ACGT", "d": ""}
    chunks = seq.chunked(spark.createDataFrame(list(seqs.items()), "name string, seq string"), size)
    lost = compression.runs(chunks)
    want, starts = {}, {}
    for n, s in seqs.items():
        at, starts[n] = 0, []
        for i, m in enumerate(re.finditer(r"(.)\1*", s)):
            starts[n].append(at)
            at += len(m.group())
            if len(m.group()) > 1:
                want[n, i] = len(m.group()) - 1
        starts[n].append(at)
    assert {(r["name"], r.pos): r.extra for r in lost.collect()} == want
    places = [(n, i) for n, v in starts.items() for i in range(len(v))]
    got = compression.lifted(spark.createDataFrame(places, "name string, pos long"), lost, 8).collect()
    assert {(r["name"], r.pos): r.original for r in got} == {(n, i): starts[n][i] for n, i in places}
    psl = spark.createDataFrame([("q", "a", [2, 10], [0, 4], [5, 3])], "qName string, tName string, tStarts array<int>, qStarts array<int>, blockSizes array<int>")
    [r] = compression.restored(psl, lost, spark.createDataFrame([("q", 1, 4)], "name string, pos long, extra long"), 8).collect()
    a = starts["a"]
    assert (r.tStarts, r.blockSizes, r.tStart, r.tEnd) == ([a[2], a[10]], [a[7] - a[2], a[13] - a[10]], a[2], a[13])
    assert (r.qStarts, r.qBlockSizes) == ([0, 8], [9, 3])


# reads and their transcripts


def test_full_comes_before_partial_and_unique_genes_count(spark):
    tx = spark.createDataFrame([("t1", "g1", 500, [100, 200]), ("t2", "g2", 500, [100, 200, 400]), ("t3", "MIR7", 500, [150]), ("t4", "g1", 500, [])], "tx string, gene string, length long, cuts array<long>")
    al = [("r1", "t1", [(50, 250)]), ("r1", "t2", [(50, 250)]), ("r2", "t2", [(50, 250)]), ("r2", "t4", [(0, 300)]), ("r3", "t1", [(120, 190)]), ("r4", "t3", [(0, 160), (165, 300)]), ("r4", "t1", [(50, 350)]), ("r5", "t1", [(100, 300)])]
    al = spark.createDataFrame(al, "read string, tx string, exons array<struct<s:bigint,e:bigint>>")
    reads = spark.createDataFrame([(f"r{k}", 250) for k in range(1, 6)], "read string, length long")
    found = assignment.evidence(assignment.longest_blocks(al), reads, tx)
    taken = assignment.chosen(found)
    assert sorted((r.read, r.tx, r.stage, r.seen) for r in taken.collect()) == [("r1", "t1", "full", 2), ("r2", "t2", "partial", 2), ("r4", "t1", "full", 2), ("r4", "t3", "full", 1), ("r5", "t1", "partial", 1)]
    assert sorted(tuple(r) for r in assignment.gene_counts(taken).collect()) == [("g1", 2), ("g2", 1)]
    lines = {r.read: r for r in assignment.report(al, taken).collect()}
    assert (lines["r4"].gene, lines["r4"].unique, lines["r4"].transcripts, lines["r3"].stage, lines["r1"].targets) == ("g1", False, 2, None, 2)
    s = assignment.summary(assignment.report(al, taken)).first()
    assert (s.reads, s.annotated, s.full, s.genes, s.unique_genes) == (5, 4, 2, 2, 2)


# writers


def test_writers_of_records(spark, tmp_path):
    text = "r1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNH:i:1\tXS:A:+"
    (tmp_path / "in").write_text("@SQ\tSN:c\tLN:9\n" + text + "\n")
    rows = sources.sam(spark, str(tmp_path / "in"))
    assert [r[0] for r in sinks.sam_lines(rows, sources.sam_header(spark, str(tmp_path / "in"))).collect()] == ["@SQ\tSN:c\tLN:9", text]
    (tmp_path / "v").write_text("##x\n#CHROM\nc\t7\tid\tA\tG\t1.5\tPASS\tDP=3\tGT\t0/1\nc\t8\t.\tA\tG\t.\tPASS\t.\n")
    assert sorted(r[0] for r in sinks.vcf_lines(sources.vcf(spark, str(tmp_path / "v"))).collect()) == ["c\t7\tid\tA\tG\t1.5\tPASS\tDP=3\tGT\t0/1", "c\t8\t.\tA\tG\t.\tPASS\t."]
    assert [r[0] for r in sinks.wrapped_fasta_lines(spark.createDataFrame([("n", "ACGTAC")], "name string, seq string"), 4).collect()] == [">n\nACGT\nAC"]
