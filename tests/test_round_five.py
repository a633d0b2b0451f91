"""Ties, repeated numbers and larger tables: what small tables do not show."""

import random
import re
import time

from pyspark.sql import functions as F
from tidemark.operators import intervals as iv
from tidemark.functions import align, seq
from tidemark.operators import compression, errors, reads
from tidemark.plans import catalog
from tidemark.sources import indexed


def test_islands_hold_however_equal_rows_come(spark, monkeypatch):
    """The second pass may see equal rows in another order than the first."""
    real = iv.running

    def turned(df, keys, bin_col, order, value, op, out, inclusive=True):
        return real(df.repartition(1).sortWithinPartitions(F.col(value).asc()), keys, bin_col, order, value, op, out, inclusive)

    rows = spark.createDataFrame([(1, 0, 10, "x"), (1, 100, 110, "x"), (1, 100, 110, "x"), (1, 100, 110, "x"), (1, 400, 401, "x")], "chrom long, s long, e long, strand string")
    monkeypatch.setattr(iv, "running", turned)
    want = [(0, 10, 1), (100, 110, 3), (400, 401, 1)]
    assert sorted((r.s, r.e, r.n) for r in iv.merge(rows, width=64).collect()) == want
    assert sorted((r.s, r.e, r.n) for r in iv.merge(rows, ["chrom", "strand"], 30, width=64).collect()) == want
    assert sorted((r.s, r.e, r.n_all) for r in iv.cogroup_loci({"all": rows}, width=64).collect()) == want


def test_sql_numbers_islands_with_ties_settled():
    """Where rows may be equal, the one that opens an island is counted first: two windows may order ties differently."""
    for name in ("interval_merge", "locus_groups_overlap_only", "loci_min_distance", "loci_stranded", "locus_assignment", "multiway_locus_cogroup", "transcript_depth", "annotate_reads", "smooth_exons"):
        sums = re.findall(r"sum\(f\) OVER \(PARTITION BY [a-z, ]+ ORDER BY (s, e[a-zA-Z, ]*) ROWS UNBOUNDED", catalog.CATALOG[name][1])
        assert sums and all(o.endswith("f DESC") for o in sums), name


def test_lookups_by_name_where_numbers_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 5, 7), ("b", "1", 5, 7), ("c", "1", 6, 8)], "qname string, rname string, pos int, line long")
    indexed.build(rows, str(tmp_path / "store"), F.col("pos") + 1, 1)
    x = indexed.Index(spark, str(tmp_path / "store"))
    assert [r.qname for r in x.by_names(["a"]).collect()] == ["a"]
    assert [r.qname for r in x.by_table(spark.createDataFrame([("b",)], "name string")).collect()] == ["b"]


def _texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        letters = rnd.choice(["AC", "ACGT", "ACGT", "AAAAC"])
        unit = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 6)))
        t = (unit * 40)[: rnd.randint(0, 30)] + "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 30, 90, 160])))
        q = list(t)
        for _ in range(rnd.randint(0, 3)):
            if q:
                q[rnd.randrange(min(len(q), 25))] = rnd.choice("ACGT")
        yield "".join(q), t


def test_short_ways_of_the_aligners_give_what_all_rows_give(monkeypatch):
    pairs = list(_texts(3, 150))
    got = [align.smith_waterman(q, t) for q, t in pairs]
    used = []
    real = align._exact_from
    monkeypatch.setattr(align, "_exact_from", lambda *x: used.append(real(*x)) or 0)
    assert got == [align.smith_waterman(q, t) for q, t in pairs] and sum(map(bool, used)) > 20
    # a text less a stretch of it: every kept letter is a match and no row is needed
    assert align.needleman_wunsch("ACGTTGCA" * 40, "GTTGCA" + "ACGTTGCA" * 39) == (10 * 318 - 15 * 2, 318, 0, 0, 2)


def test_long_texts_align_at_once():
    """Quadratic work on these would take hours."""
    t = "".join(random.Random(1).choices("ACGT", k=2_000_000))
    assert align.needleman_wunsch(t, t[5:])[1:] == (len(t) - 5, 0, 0, 5)
    q = t[:20] + ("A" if t[20] != "A" else "C") + t[21:]
    assert align.smith_waterman(q, t)["cigar"] == f"{len(t)}M"


def test_counts_and_profiles_are_those_of_the_columns(spark, monkeypatch):
    monkeypatch.setattr(errors, "CHUNK", 500)
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("ACGTNé", k=60)) for _ in range(40)]
    rows = [(i, rnd.choice(["10M2I20M3D9M", "5S4=3X8M2D70M", "3N20M4I", "2H60M9I"]), rnd.choice(texts), rnd.choice(texts), rnd.randint(0, 4), rnd.randint(0, 4)) for i in range(60)]
    d = spark.createDataFrame([*rows, (99, None, None, None, 0, 0)], "id long, cigar string, query string, target string, qs int, ts int")
    cols = errors.columns(d)
    assert sorted(map(tuple, errors.counts(d).collect())) == sorted(map(tuple, cols.groupBy("kind", "base", "ref").count().collect()))
    assert sorted(map(tuple, errors.profile(d).collect())) == sorted(map(tuple, reads.error_profile(errors.known(cols)).collect()))
    assert sorted(map(tuple, reads.error_rates(errors.counts(d), True).collect())) == sorted(map(tuple, reads.error_rates(cols).collect()))
    # no letter is a row
    plan = errors.counts(d)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_blocks_are_lifted_once_a_shape(spark):
    """Rows with equal blocks meet the runs as one, and sequences without blocks do not meet them at all."""
    chunks = seq.chunked(spark.createDataFrame([("a", "AACCGT"), ("b", "AAAA")], "name string, seq string"), 3)
    rows = spark.createDataFrame([(i, "a", [0, 2], [1, 2]) for i in range(3)] + [(9, "c", [1], [2])], "id int, tName string, tStarts array<int>, blockSizes array<int>")
    got = compression.restored(rows, compression.runs(chunks), width=2)
    assert sorted((r.id, r.tName, r.tStarts, r.blockSizes, r.tStart, r.tEnd) for r in got.collect()) == [(i, "a", [0, 4], [2, 2], 0, 6) for i in range(3)] + [(9, "c", [1], [2], 1, 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_many_coordinates_collapse_in_one_sort(spark):
    """They were sorted again for each of them."""
    rows = spark.range(1).select(F.sequence(F.lit(0), F.lit(199_998), F.lit(2)).alias("xs"))
    begun = time.monotonic()
    got = rows.select(seq.collapse_coordinates("xs").alias("x")).first().x
    assert got.startswith("0-0,2-2,") and got.count(",") == 99_999
    assert time.monotonic() - begun < 30
