"""GC depth, stitched and printed alignments, mates, files by number, quality profiles and pairless overlap joins against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemark.functions import psl, quality, seq
from tidemark.operators import coverage, fileorder, intervals, kmers, reads, stats


# rows that meet nothing


@pytest.mark.parametrize("slack", [0, 3])
def test_semi_anti_and_left_joins_tell_rows_without_pairs(spark, slack):
    rnd = random.Random(slack)

    def some(n, first):
        rows = [(first + i, rnd.choice("xyz"), s, s + rnd.choice([0, 1, 4, 40])) for i, s in enumerate(rnd.choices(range(300), k=n))]
        return [*rows, (first + n, None, 5, 9), (first + n + 1, "x", None, 9), (first + n + 2, "x", 5, None), rows[0]]

    a, b = some(60, 0), some(25, 1000)
    schema = "id long, chrom string, s long, e long"
    da, db = (spark.createDataFrame(r, schema).repartition(3) for r in (a, b))
    meets = lambda x, y: None not in (*x, *y) and x[1] == y[1] and x[2] - slack < y[3] and y[2] < x[3] + slack
    hit = [x for x in a if any(meets(x, y) for y in b)]
    got = {how: sorted(map(repr, map(tuple, intervals.overlap_join(da, db, how=how, slack=slack, width=64).collect()))) for how in ("left_semi", "left_anti")}
    order = lambda rows: sorted(repr((x[1], x[0], x[2], x[3])) for x in rows)
    shown = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert shown(intervals.overlap_join(da, db, how="left_semi", slack=slack, width=64).select("chrom", "id", "s", "e").collect()) == order(hit)
    assert len(got["left_semi"]) + len(got["left_anti"]) == len(a)
    assert shown(intervals.overlap_join(da, db, how="left_anti", slack=slack, width=64).select("chrom", "id", "s", "e").collect()) == order([x for x in a if x not in hit])
    left = intervals.overlap_join(da, db, how="left", slack=slack, width=64).groupBy("a_id").agg(F.count("*").alias("n"), F.count("b_id").alias("m")).collect()
    # the row that stands twice in each table
    times = Counter(a)
    want = {}
    for x, n in times.items():
        met = sum(meets(x, y) for y in b)
        want[x[0]] = (n * max(met, 1), n * met)
    assert {r.a_id: (r.n, r.m) for r in left} == want
    empty = spark.createDataFrame([], schema)
    assert intervals.overlap_join(da, empty, how="left_semi").count() == 0 and intervals.overlap_join(da, empty, how="left_anti").count() == len(a)


def test_semi_join_makes_no_pairs(spark):
    rows = spark.createDataFrame([(1, "x", 0, 5)], "id long, chrom string, s long, e long")
    plan = intervals.overlap_join(rows, rows, how="left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan


# quality strings


def test_quality_profile_counts_every_letter(spark, monkeypatch):
    monkeypatch.setattr(stats, "LETTERS", 7)
    texts = ["IIJ", "", None, "é!𝄞I", "I" * 30, "!"]
    got = stats.quality_profile(spark.createDataFrame([(t,) for t in texts], "q string"), "q").collect()
    want = Counter((i, ord(c)) for t in texts if t for i, c in enumerate(t))
    assert {(r.position, r.code): r.n for r in got} == want and len(got) == len(want)
    assert stats.quality_profile(spark.createDataFrame([], "q string"), "q").count() == 0


def test_counts_of_codes(spark):
    d = spark.createDataFrame([("!5I~",), ("",), (None,), ("\\]^[",)], "q string")
    rows = d.select(quality.low_count("q", 53), quality.count_between("q", 91, 94)).collect()
    assert [tuple(r) for r in rows] == [(2, 0), (0, 0), (None, None), (0, 4)]


# k-mer tables


def test_zero_and_merged_tables(spark):
    z = kmers.zeros(spark, 3)
    assert sorted(r.kmer for r in z.collect()) == sorted(a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT")
    t = spark.createDataFrame([("AAA", 2), ("ACG", 1)], "kmer string, n long")
    got = {r.kmer: r.n for r in kmers.merged(z, t, t).collect()}
    assert got["AAA"] == 4 and got["ACG"] == 2 and sum(got.values()) == 6 and len(got) == 64
    with pytest.raises(ValueError):
        kmers.zeros(spark, 31)


# alignments

PSL = "qName string, tName string, strand string, qSize long, tStart long, tEnd long, qStart long, blockSizes array<long>, qStarts array<long>, tStarts array<long>"


def entry(blocks, strand="+", q="r", size=100):
    t, x, n = zip(*blocks)
    return q, "c", strand, size, t[0], t[-1] + n[-1], x[0], list(n), list(x), list(t)


def joined(spark, rows):
    return {(r.qName, r.strand): (r.entries, list(zip(r.tStarts, r.qStarts, r.blockSizes))) for r in psl.stitched(spark.createDataFrame(rows, PSL).repartition(2)).collect()}


def test_alignments_of_a_query_are_stitched(spark):
    one = [entry([(10, 0, 5), (20, 5, 5)]), entry([(22, 12, 8), (40, 20, 5)])]
    # the second loses the three target bases that the first holds
    assert joined(spark, one) == {("r", "+"): (2, [(10, 0, 5), (20, 5, 5), (25, 15, 5), (40, 20, 5)])}
    # blocks that adjoin on both sides become one; those that adjoin on the target only do not
    assert joined(spark, [entry([(0, 0, 5)]), entry([(5, 5, 5)]), entry([(10, 11, 4)])]) == {("r", "+"): (3, [(0, 0, 10), (10, 11, 4)])}
    # nothing is left of one that lies within what came before; strands and queries stay apart
    many = [entry([(0, 0, 30)]), entry([(5, 40, 5)]), entry([(0, 0, 9)], "-"), entry([(4, 9, 9)], "-"), entry([(1, 1, 1)], q="s")]
    assert joined(spark, many) == {("r", "+"): (1, [(0, 0, 30)]), ("r", "-"): (2, [(0, 0, 9), (9, 14, 4)]), ("s", "+"): (1, [(1, 1, 1)])}
    assert joined(spark, [entry([(0, 0, 30)])] * 3) == {("r", "+"): (1, [(0, 0, 30)])}
    assert joined(spark, []) == {}


def test_printed_lines(spark):
    d = spark.createDataFrame([("ACGTTT", "ACCGTTT", [2, 4], [0, 2], [0, 3])], "q string, t string, blockSizes array<long>, qStarts array<long>, tStarts array<long>")
    lines = d.select(F.explode(psl.printed(psl.alignment_strings(F.col("q"), F.col("t")), 4)).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in lines] == [("AC-G", "|| |", "ACCG"), ("TTT", "|||", "TTT")]
    no = d.select(psl.printed(F.struct(F.lit("aN").alias("q"), F.lit("AC").alias("t"))).alias("x")).first().x
    assert no[0].marks == "| "


# mates and files


def test_mates_are_cut_apart(spark):
    d = spark.createDataFrame([("r1 length=6", "ACGTTT", "IIIJJJ"), ("r2", "AAACCC", "123456")], "name string, seq string, qual string")
    got = sorted(tuple(r) for r in reads.split_mates(d, 3).collect())
    assert got == [(1, "r1 length=3", "ACG", "III"), (1, "r2", "AAA", "123"), (2, "r1 length=3", "TTT", "JJJ"), (2, "r2", "CCC", "456")]
    for bad in [("r", "ACGT", "IIII"), ("r", "ACGTTT", "III")]:
        with pytest.raises(Exception, match="not two mates"):
            reads.split_mates(spark.createDataFrame([bad], "name string, seq string, qual string"), 3).collect()


def test_files_in_the_order_of_their_numbers(spark, tmp_path):
    for name, text in {"a 10.txt": "k\nl\n", "b2.txt": "c\n\nd\n", "x1y.7.txt": "i\n", "e3.txt": ""}.items():
        (tmp_path / name).write_text(text)
    path = f"file://{tmp_path}"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3")
    try:
        got = [tuple(r) for r in fileorder.concatenated(spark, path).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(["c", "", "d", "i", "k", "l"]))
    (tmp_path / "c07.txt").write_text("z\n")
    with pytest.raises(Exception, match="another file has the number"):
        fileorder.concatenated(spark, path).collect()
    with pytest.raises(Exception, match="no number"):
        fileorder.concatenated(spark, path, r"^b(\d+)").collect()


# GC content and depth


@pytest.mark.parametrize("fragment,best", [(None, None), (7, None), (7, 50), (None, 100)])
def test_gc_depth(spark, fragment, best):
    import hashlib

    rnd = random.Random(3)
    letters = {c: "".join(rnd.choices("ACGTNg", k=90)) for c in "xy"}
    tx = []
    for i in range(40):
        at, exons = rnd.randrange(20), []
        for _ in range(rnd.randrange(1, 5)):
            n = rnd.randrange(1, 12)
            exons.append((at, at + n))
            at += n + rnd.randrange(1, 9)
        tx.append((i, rnd.choice("xyz"), exons))
    parts = []
    for i, chrom, exons in tx:
        bases = [p for s, e in exons for p in range(s, e)]
        if fragment:
            n = len(bases)
            off = n % fragment if hashlib.md5(f"1|{i}".encode()).hexdigest()[0] < "8" else 0
            parts += [(chrom, bases[off + k * fragment : off + (k + 1) * fragment]) for k in range(n // fragment)]
        elif len(bases) >= 10:
            parts.append((chrom, bases))
    depth, every = Counter(), Counter()
    for chrom, bases in parts:
        word = "".join(letters.get(chrom, "")[p : p + 1] for p in bases).upper()
        known = len(word) - word.count("N")
        if known < 4:
            continue
        b = min((word.count("G") + word.count("C")) * 5 // known, 4)
        for p in bases:
            depth[b, chrom, p] += 1
            every[chrom, p] += 1
    if best:
        run, keep = 0, set()
        for d in sorted(set(every.values()), reverse=True):
            run += sum(v == d for v in every.values())
            if run <= best:
                keep |= {k for k, v in every.items() if v == d}
        depth = {k: v for k, v in depth.items() if k[1:] in keep}
    want = Counter()
    for (b, _, _), v in depth.items():
        want[b, v] += 1
    table = spark.createDataFrame(tx, "id long, chrom string, exons array<struct<s:bigint,e:bigint>>").repartition(3)
    chunks = seq.chunked(spark.createDataFrame(list(letters.items()), "name string, seq string"), 16)
    got = coverage.gc_depth(table, chunks, 16, 5, fragment, 10, 4, best, 1, 32).collect()
    assert {(r.bin, r.depth): r.bases for r in got} == want and want


# groups that spread over tasks


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_groups_are_ranked_over_ranges(spark, monkeypatch, many_ranges):
    from tidemark.operators import running, select

    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, 0, 1, 2, 7])) for i in range(400)] + [("lone", 1000, 3)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    assert running.spread(df, ["k"], [F.col("i")], "t").where("k = 'hot'").select("_bin").distinct().count() > 3
    groups = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((i, v))
    renamed = {r.i: r.u for r in select.rename_duplicates(df, "k", [F.col("i")], "u").collect()}
    assert renamed == {i: None if k is None else k if len(g) == 1 else f"{k}[{n}/{len(g)}]" for k, g in groups.items() for n, (i, _) in enumerate(g, 1)}
    left = {r.i for r in select.drop_shortest(df, ["k"], "i", [], 5).collect()}
    assert left == {i for g in groups.values() for i, _ in (g[5:] if len(g) > 5 else g)}
    got = {r.i: (r.running_mean, r.running_sd) for r in stats.running_mean_sd(df, ["k"], ["i"], "v").collect()}
    assert len(got) == len(rows)
    for g in groups.values():
        total = count = ss = 0
        for n, (i, v) in enumerate(g, 1):
            if v is not None:
                total, count = total + v, count + 1
                ss += (v - total / count) ** 2
            assert got[i][0] == (pytest.approx(total / count, abs=1e-6) if count else None)
            assert got[i][1] == (pytest.approx((ss / (n - 1)) ** 0.5, abs=1e-6) if n > 1 else None)
    monkeypatch.setattr(stats, "RUN", 16)
    counted = df.fillna(0, ["v"])
    scores = {r.i: (r.mean_score, r.median_score) for r in stats.window_scores(counted, ["k"], "i", "v", 3, 9).collect()}
    want = {}
    for g in groups.values():
        xs = [(i, 1 / (v or 1e7)) for i, v in g]
        want |= {xs[j][0]: (sum(x for _, x in xs[j - 2 : j + 1]) / 3, sorted(x for _, x in xs[j - 2 : j + 1])[1]) for j in range(2, len(xs))}
    assert scores.keys() == want.keys() and all(scores[i] == pytest.approx(want[i], abs=1e-8) for i in want)
