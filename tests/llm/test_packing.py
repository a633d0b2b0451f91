import random
import zlib

import numpy as np
import public_tokenizers
from corpus_fixtures import make_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import kernel, packing
from tidemark.llm.tokens import Encoder
from tokenizers import Tokenizer


def _tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", "it's a 'test' don't", "  a  b\n\n c\t\td \n", "é×ü÷", "日本語 text ١٢", "a b", "<|endoftext|>", "x\x1cy\x0bz", " \u0085 q", "A" * 3000]


def test_ids_are_those_of_the_tokenizer_file():
    import pyarrow as pa

    want = [e.ids for e in _tokenizer().encode_batch(ODD, add_special_tokens=False)]
    assert Encoder().encode(*kernel.flat(pa.array(ODD))) == want


def test_pieces_and_packing_round_trip(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "x1", "é"]) for _ in range(rnd.randrange(0, 300))) for _ in range(120)] + ODD + [None, "same", "same"]
    rows = list(enumerate(texts))
    cap = 64
    got = packing.pack(packing.pieces(make_docs(spark, rows, extra=True), cap), cap).collect()
    t = _tokenizer()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    total = 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        ps = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert all(p.length == cap for p in ps[1:]) and (len(ids) > cap or len(ps) == 1)
        at = 0
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    assert len(bins) <= -(-total // cap) + 1


def test_certificates_and_many_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 100)
    rows = [(i % 7, 0, 0, 1 + i % 2, i % 11) for i in range(900)]  # rows repeat ids, and whole rows
    got = packing.pack(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), 64).collect()
    assert sorted((r.id, r.length, r.ids_crc32) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    assert len({r.sequence_id for r in got}) == -(-sum(r[3] for r in rows) // 64)
    assert all(r.part_bins >= r.part_bound > 0 for r in got)


def test_a_packing_that_saves_nothing_is_not_taken(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_PARTITION", 4)
    rows = [(i, 0, 0, 33 if i % 2 else 22, i) for i in range(400)]  # 33 never pairs with 33; 22 goes beside it only
    got = packing.pack(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), 64).collect()
    assert len(got) == 400 and len({r.sequence_id for r in got}) <= 240
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length


def test_exchange_reaches_the_bound_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_PARTITION", 32)
    rnd = random.Random(2)
    rows = [(i, 0, 0, rnd.choice([3, 5, 9, 17, 33, 50, 64]), i) for i in range(600)]
    cut = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut, 64).collect()
    assert len(got) == 600
    size = np.array([r[3] for r in rows])
    x, n = np.unique(size, return_counts=True)
    whole = len(packing.best_fit_decreasing(size, 64)[2])  # as if packed in one task
    assert packing.lower_bound(x, n, 64) <= len({r.sequence_id for r in got}) <= 1.02 * whole
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_optimum(sizes):
    cap = 20

    def fits(rest, bins, k):
        if not rest:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b + rest[0] <= cap and b not in seen:
                seen.add(b)
                if fits(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]], k):
                    return True
        return len(bins) < k and fits(rest[1:], [*bins, rest[0]], k)

    ordered = sorted(sizes, reverse=True)
    best = next(k for k in range(1, len(sizes) + 1) if fits(ordered, [], k))
    x, n = np.unique(sizes, return_counts=True)
    bins, offset, fill = packing.best_fit_decreasing(np.array(sizes), cap)
    assert packing.lower_bound(x, n, cap) <= best <= len(fill)
    assert fill.max() <= cap and (np.bincount(bins, sizes) == fill).all()


def test_empty_table(spark):
    assert packing.pack(packing.pieces(make_docs(spark, []))).count() == 0
