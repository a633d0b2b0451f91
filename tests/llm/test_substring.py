"""Substring dedup against a brute-force version of its definition."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus_fixtures import make_docs
from tidemark.llm import kernel, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """{row number: (n_words, spans, kept)} from (id, text); null ids come last."""
    order = [(i is None, i or 0) for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for o, w in zip(order, words):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, o), o)
    out = []
    for o, w in zip(order, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < o:
                gone[k : k + width] = [True] * width
        spans, k = [], 0
        while k < len(w):
            e = k
            while e < len(w) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e))
            k = max(e, k + 1)
        out.append((len(w), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check(spark, rows, width=50, extra=False):
    df = make_docs(spark, rows, extra).repartition(3)
    got = sorted((repr(r.id), r.n_words, [tuple(s) for s in r.spans], bytes(r.kept).decode(), r.n_removed) for r in substring.repeats(df, width).collect())
    want = sorted((repr(i), n, s, k, sum(b - a for a, b in s)) for (i, _), (n, s, k) in zip(rows, brute(rows, width)))
    assert got == want


@pytest.mark.parametrize("width", [1, 2, 5, 12])
def test_random_texts_with_shared_passages(spark, width):
    rnd = random.Random(width)
    vocabulary = [f"w{k}" for k in range(6)] if width > 2 else [f"w{k}" for k in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(width, 4 * width + 3))] for _ in range(5)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(3 * width))] + rnd.choice(passages)
        rows.append((i, "".join(w + rnd.choice([" ", "\n", "\t ", "\r\n"]) for w in words)))
    check(spark, rows, width)


def test_null_empty_short_repeated_rows_and_clashing_columns(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(5, p), (5, p), (5, "a " + p), (None, p + " tail"), (None, "x " + p), (7, None), (8, ""), (9, " \n\t"), (10, "one two"), (4, "é " * 55), (11, "é " * 51), (1, "z " * 200), (2, "z " * 60), (-3, "y y"), (12, " ".join(["n"] * 60))]
    check(spark, rows, extra=True)


def test_empty_table(spark):
    assert substring.repeats(make_docs(spark, [])).count() == 0


def test_ids_of_other_types(spark):
    p = " ".join(f"p{k}" for k in range(50))
    df = spark.createDataFrame([("b", p), ("a", p), (None, p)], "doc_id string, text string")
    assert {r.id: r.n_removed for r in substring.repeats(df).collect()} == {"a": 0, "b": 50, None: 50}


def test_groups_of_copies_and_partial_overlaps(spark):
    rnd = random.Random(3)
    base = [f"v{rnd.randrange(1000)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(60)]
    rows += [(100 + i, " ".join(base[a : a + 90] + [f"u{i}"] + base[a + 90 : a + 150])) for i in range(40) for a in [rnd.randrange(150)]]
    rows += [(-1 - i, " ".join([f"t{i}"] + base[a : a + 55])) for i in range(20) for a in [rnd.randrange(240)]]
    check(spark, rows)


def test_long_text_in_blocks_and_words_that_fill_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"q{rnd.randrange(10**6)}" for _ in range(3000)]
    text = " ".join(words)
    whole = substring.word_hashes(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(kernel, "CHUNK", 64)
    assert (substring.word_hashes(np.frombuffer(text.encode(), np.uint8)) == whole).all()
    monkeypatch.setattr(substring, "WINDOWS", 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()])], ["place", "text_hash", "text"])
    got = pa.Table.from_batches(list(substring._cut(50)([batch]))).to_pylist()
    assert sorted(w for r in got for w in range(r["start"], r["start"] + r["n"])) == list(range(2951))
    long = "L" * 500 + " end"
    assert len(substring.word_hashes(np.frombuffer(long.encode(), np.uint8))) == 2


def test_long_texts_end_to_end(spark):
    rnd = random.Random(5)
    words = [f"q{rnd.randrange(10**6)}" for _ in range(320_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:150_000] + ["new"] + words[150_001:])), (3, "short " + " ".join(words[:60]))]
    got = {r.id: r for r in substring.repeats(make_docs(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 319_999 and bytes(got[2].kept) == b"new"
    assert bytes(got[3].kept) == b"short" and [tuple(s) for s in got[3].spans] == [(1, 61)]


def test_words_that_defeat_hashes_modulo_powers_of_two(spark):
    tm = ["ab"[bin(k).count("1") % 2] for k in range(1024)]
    other = ["ba"[bin(k).count("1") % 2] for k in range(1024)]
    rows = [(1, "".join(tm) + " " + " ".join(f"x{k}" for k in range(49))), (2, "".join(other) + " " + " ".join(f"x{k}" for k in range(49)))]
    assert {r.n_removed for r in substring.repeats(make_docs(spark, rows)).collect()} == {0}


def test_digest_of_the_kept_words():
    assert hashlib.sha256(b" ".join(b"a\x0b\x0c b\t".split())).hexdigest() == hashlib.sha256(b"a b").hexdigest()
