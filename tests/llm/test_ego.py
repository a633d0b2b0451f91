import numpy as np
import pytest
from tidemark.llm import ego

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, v string, component string"


def brute(rows, t=0.9):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i].add(j)
                    links[j].add(i)
    comp = list(ids)
    changed = True
    while changed:
        changed = False
        for i, ns in links.items():
            m = min([comp[i], *(comp[j] for j in ns)])
            if m != comp[i]:
                comp[i], changed = m, True
    return sorted((ids[i], len(links[i]), comp[i]) for i in range(len(rows)))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)
    return sorted((r.id, r.n_links, r.component) for r in ego.near_duplicates(df).collect())


@pytest.mark.parametrize("interval", [4096, 16])
def test_against_brute_force(spark, monkeypatch, interval):
    monkeypatch.setattr(ego, "INTERVAL", interval)
    monkeypatch.setattr(ego, "LEAF", 4)
    rnd = np.random.default_rng(interval)
    base = rnd.standard_normal((40, 8))
    rows = [(i, base[i % 40] + rnd.standard_normal(8) * rnd.choice([0, 0.05, 0.2, 0.4])) for i in range(150)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [None] + [1.0] * 7), (205, [float("inf")] * 8)]
    rows += [(210 + i, rows[3][1]) for i in range(10)] + [(230, [1.0, 2.0]), (231, [1.0, 2.1]), (232, [-1.0, -2.0]), (5, rows[5][1])]
    rnd.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-38, 1e-38]), (2, [3e38, 3e38]), (3, [1.0, -1.0])]
    assert run(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_empty_and_only_invalid(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None), (2, [0.0])]) == [(2, 0, 2), (4, 0, 4)]


def test_pairs_at_the_threshold(spark):
    """0/1 vectors with nine of ten ones in common have a cosine of exactly 0.9."""
    rows = []
    for k in range(20):
        a = [1.0 if i < 10 else 0.0 for i in range(24)]
        b = [0.0] * 24
        for i in [*range(1, 10), 10 + k % 14]:
            b[i] = 1.0
        rows += [(100 * k, [x * (k + 1) for x in a]), (100 * k + 1, [x * (k + 1) for x in b])]
    for n in range(3, 8, 2):
        some = rows[2 * n : 2 * n + 2]
        got = ego.near_duplicates(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect()
        assert [r.n_links for r in got] == [1, 1]
