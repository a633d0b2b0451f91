import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import ranges
from tidemark.operators import intervals as iv


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "chrom string, s long, e long" + extra)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def bases(rows_):
    out = {}
    for c, s, e in rows_:
        for p in range(s, e):
            out[(c, p)] = out.get((c, p), 0) + 1
    return out


def runs(depth):
    out = []
    for (c, p), d in sorted(depth.items()):
        if out and out[-1][0] == c and out[-1][2] == p and out[-1][3] == d:
            out[-1] = (c, out[-1][1], p + 1, d)
        else:
            out.append((c, p, p + 1, d))
    return out


def random_sets(seed):
    rnd = random.Random(seed)
    one = lambda: [(rnd.choice("ab"), s, s + rnd.randrange(1, 30)) for s in (rnd.randrange(0, 200) for _ in range(40))]
    return one(), one()


def test_fixed_vectors(spark):
    assert rows(iv.merge(frame(spark, [("c", 0, 5), ("c", 5, 8), ("c", 9, 12)])), "s", "e") == [(0, 8), (9, 12)]
    assert rows(iv.merge(frame(spark, [("c", 0, 5), ("c", 5, 8)]), touch=False), "s", "e") == [(0, 5), (5, 8)]
    assert rows(iv.subtract(frame(spark, [("c", 0, 10)]), frame(spark, [("c", 3, 6)])), "s", "e") == [(0, 3), (6, 10)]
    assert rows(iv.coverage(frame(spark, [("c", 0, 4), ("c", 2, 6)])), "s", "e", "depth") == [(0, 2, 1), (2, 4, 2), (4, 6, 1)]
    assert rows(iv.coverage(frame(spark, [("c", 0, 4), ("c", 4, 8)])), "s", "e", "depth") == [(0, 8, 1)]


@pytest.mark.parametrize("width", [7, 1 << 14])
def test_algebra_against_base_counts(spark, width):
    a, b = random_sets(width)
    da, db = bases(a), bases(b)
    fa, fb = frame(spark, a), frame(spark, b)
    assert rows(iv.coverage(fa, width=width), "chrom", "s", "e", "depth") == runs(da)
    flat = lambda keys: [r[:3] for r in runs(dict.fromkeys(keys, 1))]
    assert rows(iv.subtract(fa, fb, width=width), "chrom", "s", "e") == flat(set(da) - set(db))
    assert rows(iv.intersect(fa, fb, width=width), "chrom", "s", "e") == flat(set(da) & set(db))
    assert rows(iv.union(fa, fb, width=width), "chrom", "s", "e") == flat(set(da) | set(db))
    lengths = spark.createDataFrame([("a", 240), ("b", 240)], "chrom string, length long")
    every = {(c, p) for c in "ab" for p in range(240)}
    assert rows(iv.complement(fa, lengths, width), "chrom", "s", "e") == flat(every - set(da))


@pytest.mark.parametrize("width", [7, 1 << 14])
@pytest.mark.parametrize("slack", [0, 4])
def test_overlap_join_against_all_pairs(spark, width, slack):
    a, b = random_sets(3)
    fa = frame(spark, [(*r, i) for i, r in enumerate(a)], ", id int")
    fb = frame(spark, [(*r, i) for i, r in enumerate(b)], ", id int")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] - slack < y[2] and y[1] < x[2] + slack)
    assert rows(iv.overlap_join(fa, fb, slack=slack, width=width), "a_id", "b_id") == want
    hit = {i for i, _ in want}
    assert rows(iv.overlap_join(fa, fb, how="left_semi", slack=slack, width=width), "id") == [(i,) for i in sorted(hit)]
    assert rows(iv.overlap_join(fa, fb, how="left_anti", slack=slack, width=width), "id") == [(i,) for i in range(len(a)) if i not in hit]
    assert iv.overlap_join(fa, fb, how="left", slack=slack, width=width).count() == len(want) + len(a) - len(hit)


def test_nearest_against_all_pairs(spark):
    a, b = random_sets(5)
    fa = frame(spark, [(*r, i) for i, r in enumerate(a)], ", id int")
    fb = frame(spark, [(*r, i) for i, r in enumerate(b[:6])], ", id int")
    got = {r.a_id: (r.b_id, r.distance) for r in iv.nearest(fa, fb).collect()}
    for i, (c, s, e) in enumerate(a):
        cand = sorted((0 if s < f and t < e else t - e + 1 if t >= e else s - f + 1, t, j) for j, (k, t, f) in enumerate(b[:6]) if k == c)
        assert got[i] == ((cand[0][2], cand[0][0]) if cand else (None, None))


def test_pad_tile_and_empty(spark):
    x = frame(spark, [("c", 3, 21)])
    lengths = spark.createDataFrame([("c", 22)], "chrom string, length long")
    assert rows(iv.pad(x, 5, lengths), "s", "e") == [(0, 22)]
    assert rows(iv.tile(x, 8), "s", "e") == [(3, 11), (11, 19)]
    assert rows(iv.tile(x, 8, whole=False), "s", "e") == [(3, 11), (11, 19), (19, 21)]
    none = x.where("false")
    assert iv.coverage(none).count() == iv.merge(none).count() == iv.overlap_join(none, none).count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([("c", 0, 10, "c", 9, 20), ("c", 0, 10, "c", 10, 20), ("c", 0, 10, "c", 14, 20), ("c", 0, 10, "d", 0, 1)], "c1 string, s1 int, e1 int, c2 string, s2 int, e2 int")
    args = [F.col(c) for c in df.columns]
    got = df.select(ranges.overlaps(*args), ranges.overlap_size(*args), ranges.adjacent(*args), ranges.distance(*args), ranges.compare(*args)).collect()
    assert [tuple(r) for r in got] == [(True, 1, False, 0, 0), (False, 0, True, 1, -1), (False, 0, False, 5, -1), (False, 0, False, -1, -1)]
