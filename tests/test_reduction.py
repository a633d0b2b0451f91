"""Transcript reduction and prediction against a brute-force version of their rules."""

import random
from collections import Counter, defaultdict

import pytest
from tidemark.operators import graph, reduction

TX = "id long, chrom string, exons array<struct<s:bigint,e:bigint>>"


def rows_of(spark, tx):
    return spark.createDataFrame([(i, c, [tuple(x) for x in ex]) for i, c, ex in tx], TX).repartition(5)


def near(a, b, t):
    return abs(a[0] - b[0]) <= t and abs(a[1] - b[1]) <= t


def fold(tx):
    got = defaultdict(list)
    for i, c, ex in tx:
        if len(ex) > 1:
            got[c, tuple((a[1], b[0]) for a, b in zip(ex, ex[1:]))].append((i, ex[0][0], ex[-1][1]))
    return {min(x[0] for x in v): (c, j, len(v), min(x[1] for x in v), max(x[2] for x in v)) for (c, j), v in got.items()}


def vote(counts):
    return min(counts, key=lambda v: (-counts[v], v))


def agreed(chains, placed):
    """{family: (chrom, junctions, n, s, e)} from {family: [(chain, at)]}."""
    out = {}
    for f, own in placed.items():
        m = max(at + len(chains[c][1]) for c, at in own)
        left, right = [Counter() for _ in range(m)], [Counter() for _ in range(m)]
        for c, at in own:
            for k, (lo, hi) in enumerate(chains[c][1]):
                left[at + k][lo] += chains[c][2]
                right[at + k][hi] += chains[c][2]
        j = tuple((vote(x), vote(y)) for x, y in zip(left, right))
        s = min(chains[c][3] for c, at in own if at == 0)
        e = max(chains[c][4] for c, at in own if at + len(chains[c][1]) == m)
        edges = [s, *[p for x in j for p in x], e]
        sound = all(a < b for a, b in zip(edges[::2], edges[1::2])) and all(lo <= hi for lo, hi in j)
        own_j = chains[min(own, key=lambda x: (x[1], -len(chains[x[0]][1]), x[0]))[0]][1]
        out[f] = (chains[own[0][0]][0], j if sound or len(own_j) < m else own_j, sum(chains[c][2] for c, _ in own), s, e)
    return out


def brute_families(chains, t, how):
    inside = defaultdict(list)  # big -> (small, at)
    for a, (ca, ja, *_) in chains.items():
        for b, (cb, jb, *_) in chains.items():
            if a != b and ca == cb:
                for k in range(len(ja) - len(jb) + 1):
                    if all(near(x, y, t) for x, y in zip(ja[k:], jb)):
                        inside[a].append((b, k))
    node = {c: c for c in chains}
    for _ in chains:
        for a in chains:
            for b, _k in inside[a]:
                if len(chains[a][1]) == len(chains[b][1]):
                    node[a] = node[b] = min(node[a], node[b])
    up = {}
    for a in chains:
        for b, k in inside[a]:
            if len(chains[a][1]) > len(chains[b][1]):
                key = node[a], node[b]
                up[key] = min(up.get(key, k), k)
    roots = set(node.values()) - {b for _, b in up}
    reach = {}
    for r in roots:
        at, front = {r: 0}, {r}
        while front:
            new = {}
            for (a, b), k in up.items():
                if a in front and b not in at:
                    new[b] = min(new.get(b, 10**9), at[a] + k)
            at |= new
            front = set(new)
        for n, k in at.items():
            reach[r, n] = k
    if how == "greedy":
        m, n = {}, Counter()
        for c, f in node.items():
            m[f] = max(m.get(f, 0), len(chains[c][1]))
            n[f] += chains[c][2]
        best = {}
        for r, x in reach:
            key = (-m[r], -n[r], r)
            best[x] = min(best.get(x, key), key)
        reach = {(r, x): k for (r, x), k in reach.items() if best[x][2] == r}
    placed = defaultdict(list)
    for (r, x), k in reach.items():
        placed[r] += [(c, k) for c in chains if node[c] == x]
    return placed


def brute_predicted(chains, t, least):
    chains = agreed(chains, brute_families(chains, t, "greedy"))
    while True:
        go = []
        for a, (ca, ja, *_) in chains.items():
            for b, (cb, jb, *_) in chains.items():
                if a != b and ca == cb:
                    for k in range(1, len(ja)):
                        if len(jb) > len(ja) - k >= least and all(near(x, y, t) for x, y in zip(ja[k:], jb)):
                            go.append((a, b, k, len(ja) - k))
        right, left = {}, {}
        for a, b, k, n in go:
            right[a] = min(right.get(a, (0, 0, 0)), (-n, b, k))
            left[b] = min(left.get(b, (0, 0, 0)), (-n, a, k))
        pairs = {a: (b, k) for a, (_, b, k) in right.items() if left[b][1:] == (a, k)}
        if not pairs:
            return chains
        behind = {b for b, _ in pairs.values()}
        placed = {}
        for h in set(chains) - behind:
            c, at, own = h, 0, [(h, 0)]
            while c in pairs:
                c, k = pairs[c]
                at += k
                own.append((c, at))
            placed[h] = own
        chains = agreed(chains, placed)


def sample(seed, n, loci=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.randrange(10)
        slots = [a]
        while len(slots) < rnd.randrange(1, 7):
            slots.append(slots[-1] + rnd.choice([1, 1, 1, 2]))
        out.append((i, f"c{rnd.randrange(loci)}", [(100 * x + rnd.randrange(5), 100 * x + 50 + rnd.randrange(5)) for x in slots]))
    return out


def shown(df):
    return sorted((r.chain, r.chrom, r.m, r.n, r.s, r.e, [(x.s, x.e) for x in r.exons]) for r in df.collect())


def wanted(chains):
    out = []
    for f, (c, j, n, s, e) in chains.items():
        edges = [s, *[p for x in j for p in x], e]
        out.append((f, c, len(j), n, s, e, list(zip(edges[::2], edges[1::2]))))
    return sorted(out)


@pytest.mark.parametrize("how", ["exhaustive", "greedy"])
@pytest.mark.parametrize("tolerance", [0, 2])
def test_reduced(spark, how, tolerance):
    tx = sample(tolerance, 150)
    chains = fold(tx)
    assert shown(reduction.reduced(rows_of(spark, tx), tolerance, how, width=128)) == wanted(agreed(chains, brute_families(chains, tolerance, how)))


def test_predicted(spark):
    tx = sample(7, 60, 2)
    assert shown(reduction.predicted(rows_of(spark, tx), 3, width=128)) == wanted(brute_predicted(fold(tx), 3, 1))


def test_support_and_members(spark):
    tx = [(1, "a", [(0, 10), (20, 30), (40, 50)]), (2, "a", [(5, 10), (20, 30)]), (3, "a", [(22, 30), (40, 60)]), (4, "a", [(0, 10), (25, 30)]), (5, "a", [(0, 99)]), (6, "a", [(1, 10), (20, 30), (40, 55)])]
    df = rows_of(spark, tx)
    assert shown(reduction.reduced(df, 0)) == [(1, "a", 2, 4, 0, 60, [(0, 10), (20, 30), (40, 60)]), (4, "a", 1, 1, 0, 30, [(0, 10), (25, 30)])]
    assert [r[0] for r in shown(reduction.reduced(df, 0, support=2))] == [1]
    c = reduction.chains(df)
    assert sorted(map(tuple, reduction.members(df, c).collect())) == [(1, 1), (1, 6), (2, 2), (3, 3), (4, 4)]


def test_no_transcripts(spark):
    assert shown(reduction.reduced(rows_of(spark, []), 2)) == shown(reduction.predicted(rows_of(spark, [(1, "a", [(0, 5)])]), 2)) == []
    with pytest.raises(ValueError):
        reduction.families(reduction.chains(rows_of(spark, [])), how="other")


def test_one_locus_of_many_transcripts(spark):
    """20,000 transcripts of one locus: one long chain and its pieces, so all end in one family."""
    full = [(100 * k, 100 * k + 50) for k in range(120)]
    rnd = random.Random(1)
    tx = [(0, "hot", full)]
    for i in range(1, 20_000):
        a = rnd.randrange(118)
        tx.append((i, "hot", full[a : a + rnd.randrange(2, 5)]))
    got = shown(reduction.reduced(rows_of(spark, tx), 0))
    assert len(got) == 1 and got[0][3] == 20_000 and got[0][6] == full


def test_ranked_paths(spark):
    rnd = random.Random(2)
    ids = list(range(200))
    rnd.shuffle(ids)
    edges, want = [], {}
    for part in (ids[:90], ids[90:92], ids[92:93]):
        at = 0
        want[part[0]] = (part[0], 0)
        for a, b in zip(part, part[1:]):
            step = rnd.randrange(1, 4)
            at += step
            edges.append((a, b, step))
            want[b] = (part[0], at)
    del want[ids[92]]  # a node without an edge
    ring = ids[100:150]
    low = ring.index(min(ring))
    ring = ring[low:] + ring[:low]
    edges += [(a, b, 1) for a, b in zip(ring, ring[1:] + ring[:1])] + [(500, 500, 1)]
    want |= {x: (ring[0], k) for k, x in enumerate(ring)} | {500: (500, 0)}
    got = graph.ranked_paths(spark.createDataFrame(edges, "a long, b long, step long"))
    assert {r.id: (r.head, r.distance) for r in got.collect()} == want
