import random

import numpy as np
from corpus_fixtures import make_docs
from tidemark.llm import simhash
from xxhash import xxh64_intdigest


def brute_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    comp = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    m = min(comp[a], comp[ids[j]])
                    if comp[a] != m or comp[ids[j]] != m:
                        comp[a] = comp[ids[j]] = m
                        changed = True
    return comp


def test_documents_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["Aé", "b", "the", "of\tx", "ÀB", "zz", "q", "w\nr"]
    base = [" ".join(rnd.choice(vocab) + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    texts = base + [b + " end" for b in base] + base[:7] + ["", None, "one", "one two", "  one  TWO ", "x " * 5000]
    rows = list(enumerate(texts))
    got = {r.id: r for r in simhash.near_duplicates(make_docs(spark, rows, extra=True)).collect()}
    fps = [brute_fp(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(enumerate(fps))
    assert {i: r.component for i, r in got.items()} == want


def _meet_all(fps, probe, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "PROBE_FROM", probe)
    links = set()
    starts = [0, 13, 26, 39, 52]
    rot, ring, rep = [], [], []
    for i, f in enumerate(fps):
        for r, s in enumerate(starts):
            rot.append(r)
            ring.append(((f << s) | (f >> (64 - s))) & (2**64 - 1))
            rep.append(i)
    batch = pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(rot, pa.int32()), pa.array(np.array(ring, np.uint64).view(np.int64))], ["rep", "rot", "ring"])
    for b in simhash._meet(iter([batch])):
        links |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    return links


def test_every_link_within_two_bits_is_found(monkeypatch):
    rnd = random.Random(5)
    fps = set()
    while len(fps) < 300:
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(3):
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(fps)
    want = brute_components(list(range(len(fps))), fps)
    for probe in (10_000, 1):
        links = _meet_all(fps, probe, monkeypatch)
        assert all(bin(fps[a] ^ fps[b]).count("1") <= 64 for a, b in links)
        comp = list(range(len(fps)))
        for _ in range(len(fps)):
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
        assert dict(enumerate(comp)) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(make_docs(spark, [])).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, "A B C D")]
    got = sorted((r.id if r.id is not None else -1, r.component) for r in simhash.near_duplicates(make_docs(spark, rows)).collect())
    assert got == [(-1, 2), (2, 2), (5, 2), (5, 2)]


def test_a_fingerprint_of_null_ids_still_links(spark, monkeypatch):
    # 1 - null - 2 chain: the middle one's fingerprint is held by a row without id alone
    base = "w " * 8
    def fake(docs, *a, **k):
        return docs.selectExpr("doc_id AS id", "CAST(n_chars AS bigint) AS fp")

    monkeypatch.setattr(simhash, "fingerprints", fake)
    docs = spark.createDataFrame([(1, base, 0b0000), (None, base, 0b0011), (2, base, 0b1111)], "doc_id long, text string, n_chars long")
    assert {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (None, 1), (2, 1)}


def _shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_wide_fingerprints_do_not_depend_on_the_batch():
    import pyarrow as pa
    from tidemark.llm import kernel

    rnd = random.Random(4)
    texts = ["", "one", "One two", "a b c d e", "a b c d e f", "x " * 2000] + [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(1, 700))) for _ in range(40)]
    every = simhash.wide_fingerprints(*kernel.flat(pa.array(texts)))
    for t, f in zip(texts, every):
        assert (simhash.wide_fingerprints(*kernel.flat(pa.array([t.upper()])))[0] == f).all()
    assert not every[0].any() and (np.bitwise_count(every[6:, None] ^ every[None, 6:]).sum(2)[np.triu_indices(40, 1)] > 60).all()


def test_similar_texts_share_a_group(spark):
    rnd = random.Random(6)
    rows, sims = [], {}
    for k in range(60):
        words = [f"v{rnd.randrange(3000)}" for _ in range(200)]
        copy = list(words)
        for _ in range(1 + k % 4):  # similarity of about 0.95 to 0.82
            copy[rnd.randrange(200)] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        sims[k] = len(a & b) / len(a | b)
    rows += [(1000, rows[0][1].upper()), (1001, ""), (1002, None), (1003, "")]
    docs = make_docs(spark, rows, extra=True)
    kept = {r.doc_id for r in simhash.first_of_group(docs).collect()}
    assert kept & {1000, 1001, 1002, 1003} == {1001} and all(2 * k in kept for k in range(60))
    caught = {k: 2 * k + 1 not in kept for k in range(60)}
    assert np.mean([caught[k] for k in caught if sims[k] >= 0.9]) > 0.98 and np.mean([caught[k] for k in caught if sims[k] >= 0.8]) > 0.9


def test_first_of_group_loses_no_text_when_ids_repeat(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = make_docs(spark, [(1, a), (2, a), (2, b), (7, b), (7, "c d e"), (None, "c d e"), (None, "only here")])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in simhash.first_of_group(docs).collect())
    assert got == [(-1, "only here"), (1, a), (2, b), (7, "c d e")]
    assert simhash.first_of_group(make_docs(spark, [])).count() == 0


def test_a_large_group_over_many_batches(spark):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(3000):
        w = list(words)
        w[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        kept = [r.doc_id for r in simhash.first_of_group(make_docs(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert kept == [0]


def _first_of_each(rows):
    """Ids that stay: the least of each group that is connected by texts that share a route and differ in SIMILAR bits at most."""
    import pyarrow as pa
    from tidemark.llm import graph, kernel

    rows = sorted(rows)
    f, r = simhash._wide(*kernel.flat(pa.array([t for _, t in rows])))
    apart = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    a, b = np.nonzero(np.triu((apart <= simhash.SIMILAR) & ((r[:, None] == r[None]).any(2) | (apart == 0)), 1))
    root = graph.local_roots(len(rows), a, b)
    return [i for k, (i, _) in enumerate(rows) if root[k] == k], int((apart[a, b] > 110).sum())


def test_every_text_within_the_budget_is_grouped(spark, monkeypatch):
    rnd = random.Random(11)
    rows = []
    for k in range(80):
        words = [f"v{rnd.randrange(3000)}" for _ in range(200)]
        for m in range(4):
            copy = list(words)
            for _ in range(m and rnd.randrange(2, 7)):
                copy[rnd.randrange(200)] = f"changed{rnd.randrange(9)}"
            rows.append((4 * k + m, " ".join(copy)))
    want, far = _first_of_each(rows)
    assert far > 100
    docs = make_docs(spark, rows)
    assert sorted(r.doc_id for r in simhash.first_of_group(docs).collect()) == want
    monkeypatch.setattr(simhash, "DIRECT", 1)
    assert sorted(r.doc_id for r in simhash.first_of_group(docs).collect()) == want
    monkeypatch.setattr(simhash, "GROUP", 2)  # groups of four in blocks
    assert sorted(r.doc_id for r in simhash.first_of_group(docs).collect()) == want


def test_wide_links_against_brute_force(monkeypatch):
    from tidemark.llm import graph

    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**64, (60, 16), dtype=np.uint64)
    for lim in (26, 90, 171, 171, 190):  # chains of links, each copy of an earlier one
        copy = f[rng.integers(0, len(f), 120)]
        for row in copy:
            for b in rng.choice(1024, rng.integers(lim // 2, lim + 1), replace=False):
                row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        f = np.concatenate([f, copy])
    n = len(f)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= simhash.SIMILAR
    a, b = np.nonzero(np.triu(near, 1))
    arcs = list(range(len(simhash._ARCS)))
    assert sum(simhash._ARCS) == 1024 and simhash.SIMILAR // len(simhash._ARCS) == 2
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(simhash, "CANDIDATES", chunk)
        assert (simhash._alike(f, n, arcs) == graph.local_roots(n, a, b)).all()
        across = (a < 250) & (b >= 250)
        assert (simhash._alike(f, 250, arcs) == graph.local_roots(n, a[across], b[across])).all()
    monkeypatch.setattr(simhash, "CANDIDATES", 1 << 10)
    pairs = np.concatenate(simhash._direct(f, np.full(n, n)), axis=1)
    assert set(map(tuple, pairs.T.tolist())) == set(zip(a.tolist(), b.tolist()))


def test_similar_pairs_are_caught_and_others_left(spark):
    """Recall over pairs of texts of 60 to 1,000 words: 0.9 at a similarity of 0.8 or more, next to none below 0.65."""
    rnd = random.Random(21)
    rows, sims = [], []
    for k in range(400):
        n = rnd.choice([60, 150, 400, 1000])
        words = [f"v{rnd.randrange(5000)}" for _ in range(n)]
        copy = list(words)
        for _ in range(rnd.randrange(max(2, n // 12))):
            copy[rnd.randrange(n)] = f"new{rnd.randrange(99)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        sims.append(len(a & b) / len(a | b))
    kept = {r.doc_id for r in simhash.first_of_group(make_docs(spark, rows)).collect()}
    assert all(2 * k in kept for k in range(400))
    share = lambda lo, hi: np.mean([2 * k + 1 not in kept for k, s in enumerate(sims) if lo <= s < hi])
    assert sum(0.8 <= s < 1 for s in sims) > 60 and sum(s < 0.65 for s in sims) > 30
    assert share(0.8, 1) > 0.95 and share(0.9, 1) > 0.99 and share(0, 0.65) < 0.05
