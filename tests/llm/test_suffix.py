import random

import pytest
from corpus_fixtures import make_docs
from tidemark.llm import suffix


def brute(rows, length):
    """{row number: mask of removed bytes}, documents in (id, text) order, null ids first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        out[i] = gone
    return out


def check(spark, rows, length, rounds=4, extra=False):
    got = suffix.repeats(make_docs(spark, rows, extra), length, rounds=rounds).collect()
    want = []
    for i, gone in brute(rows, length).items():
        b = (rows[i][1] or "").encode()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n_spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((-1 if rows[i][0] is None else rows[i][0], len(b), sum(gone), n_spans, kept))
    have = [(-1 if r.id is None else r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(have) == sorted(want)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return got


@pytest.mark.parametrize("length", [8, 20, 40])
def test_against_brute_force(spark, length):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(0, 200))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 70):
        t = rnd.choice(base)
        a = rnd.randrange(0, len(t) + 1)
        rows.append((i, t[:a] + rnd.choice(["", "X", "abc"]) + t[a:]))
    rows += [(100, "ab" * 300), (101, None), (102, ""), (103, "ab" * 40), (104, base[0] * 3), (5, base[5]), (None, base[6]), (7, base[7])]
    rnd.shuffle(rows)
    check(spark, rows, length, extra=length == 20)


def test_hundred_bytes_at_every_alignment(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(140))
    rows = [(i, "".join(rnd.choice("klmnop") for _ in range(i)) + passage[: 99 + i % 3] + "".join(rnd.choice("qrstuv") for _ in range(i % 7))) for i in range(80)]
    got = check(spark, rows, 100)
    assert sum(r.n_removed > 0 for r in got) > 40


def test_rounds_do_not_change_the_result(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * (1 + i % 3)) for i in range(12)]
    assert len({tuple(sorted((r.id, r.n_removed) for r in check(spark, rows, 20, rounds=r))) for r in (1, 2)}) == 1


def test_empty_table_and_short_strings(spark):
    assert suffix.repeats(make_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.cover_for(5)
    for v, residues in suffix.COVERS:
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))


def test_more_buckets_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 16)
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abc ") for _ in range(150)) for _ in range(20)]
    check(spark, [(i, base[i % 20][i % 3 :]) for i in range(60)], 20)


def test_tying_starts_are_found_once(spark, monkeypatch):
    import numpy as np
    from tidemark.llm import scratch

    tables, written = {}, scratch.written

    def keep(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(scratch, "written", keep)
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice("abc ") for _ in range(150))) for i in range(20)]
    rows += [(20 + i, "x" * (i + 1) + rows[i][1]) for i in range(5)]
    check(spark, rows, 40)
    strings = {}
    for i, t in rows:
        for p in range(len(t) - 39):
            strings.setdefault(t[p : p + 40], []).append((i, p))
    want = {x for at in strings.values() if len(at) > 1 for x in at}
    got = set()
    for r in tables["suffix-tied"].collect():  # what each round reads
        block = suffix._Block(r.ids, r.offs, r.text, r.copies, 40)
        for p in suffix._starts(block, r.starts):
            k = np.searchsorted(block.offs, p, "right") - 1
            got.add((int(block.ids[k]), int(p - block.offs[k])))
    assert len(want) > 1000 and want <= got and len(got) < 2 * len(want)


def test_the_first_of_equal_strings_stays_in_any_order():
    import numpy as np

    rng = np.random.default_rng(2)
    hi = rng.integers(0, 50, 5000).astype(np.uint64)
    order = suffix._order(hi, hi)
    lead = suffix._leads(order, suffix._first(hi[order]))
    assert sorted(lead) == sorted(np.unique(hi, return_index=True)[1])
    assert not len(suffix._leads(order[:0], np.zeros(0, bool)))
