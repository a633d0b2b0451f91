"""Sort-means against brute-force k-means in exact integers."""

import hashlib
import random

import numpy as np
import pytest
from tidemark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int"


def brute(rows, k, rounds, dims, scale=256):
    """{(id, vector): (cluster, distance)}, final centroids."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(np.float64(np.float32(x)) * scale)) for x in v)))
    kept = [(i, tuple(max(-centroids.MOST, min(centroids.MOST, x)) for x in v)) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    cs = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _i, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, g in groups.items():
            cs[n] = [sum(x) // len(g) for x in zip(*g)]
    return sorted((repr(i), *near(v)[::-1]) for i, v in kept), cs


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(4)


def check(spark, rows, k, rounds=5, dims=4):
    got = centroids.cluster(rows_of(spark, rows), k, rounds, dims).collect()
    want, cs = brute(rows, k, rounds, dims)
    assert sorted((repr(r.id), r.cluster, r.distance) for r in got) == want
    total = {}
    for _, c, d in want:
        total[c] = total.get(c, 0) + d
    assert all(r.centroid == cs[r.cluster] and r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in got)


def test_random_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(3 * (i % 5), 1) for _ in range(4)]) for i in range(300)]
    check(spark, rows, 7)
    check(spark, rows, 1, rounds=2)


def test_ties_repeats_nulls_and_other_lengths(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randrange(3)) / 256 for _ in range(4)]) for i in range(80)]
    rows += rows[:10] + [(3, [0.5] * 4), (None, [0.25] * 4), (None, [0.25] * 4)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf")] * 4)]
    check(spark, rows, 12)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.1] * 4), (2, [-0.1] * 4)], 5)
    assert centroids.cluster(rows_of(spark, []), 5).count() == 0


def test_large_components_stay_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1, 1]) * float(np.float32(10 ** rnd.uniform(3, 6))) for _ in range(4)]) for i in range(60)] + [(100, [3e38] * 4), (101, [-3e38] * 4)]
    check(spark, rows, 6, rounds=3)


def test_the_scan_stops_early_and_loses_nothing():
    rng = np.random.default_rng(4)
    middle = rng.integers(-5000, 5000, (30, 8))
    x = middle[rng.integers(0, 30, 2000)] + rng.integers(-40, 40, (2000, 8))
    before = np.array([((x[i] - middle) ** 2).sum(1).argmin() for i in range(len(x))])
    c, d, looked = centroids.assign(x, before, middle)
    want = np.stack([((x - m) ** 2).sum(1) for m in middle], 1)
    assert (c == want.argmin(1)).all() and (d == want.min(1)).all() and looked < 3 * len(x)
    c, d, _ = centroids.assign(x, rng.integers(0, 30, len(x)), middle)
    assert (c == want.argmin(1)).all() and (d == want.min(1)).all()


@pytest.mark.parametrize("top", [10, 1 << 26])
def test_squared_is_exact(top):
    rng = np.random.default_rng(5)
    x, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert (centroids.squared(x, c) == np.array(want)).all()


def test_boundary_of_the_scan_is_taken_in():
    """A centroid exactly twice as far as the vector's own distance may tie, and the smaller number wins."""
    c, d, _ = centroids.assign(np.array([[1]]), np.array([1]), np.array([[2], [0]]))
    assert c[0] == 0 and d[0] == 1
