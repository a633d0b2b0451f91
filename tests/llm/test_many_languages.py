"""Language identification with more languages than give a full sample."""

import random
from collections import Counter

import numpy as np
from corpus_fixtures import make_docs
from tidemark.llm import features, langid


def _rows(n):
    rnd = random.Random(9)
    rows = []
    for k in range(n):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        for _ in range(12 if k < n - 6 else 8):  # the last ones are the rarest
            rows.append((len(rows), " ".join(rnd.choice(words) for _ in range(40)), f"l{k:03d}"))
    return rows


def test_every_language_is_learned(spark):
    rows = _rows(70)
    docs = make_docs(spark, rows)
    model = langid.train(docs, "doc_id % 4 <> 2")
    assert model.names == sorted({r[2] for r in rows})
    got = {r.id: r.lang_pred for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i] == lang for i, _, lang in held]) > 0.95
    rare = [r for r in held if r[2] >= "l064"]
    assert rare and np.mean([got[i] == lang for i, _, lang in rare]) > 0.9


def test_samples_are_bounded_and_leave_no_label_out(spark):
    rows = make_docs(spark, [(i, "x", f"l{i % 7 % 5}") for i in range(900)] + [(2000, "x", "l0"), (2000, "x", "l1"), (None, "x", "l1"), (2001, "x", None)])
    want = {f"l{k}": sum(1 for i in range(900) if i % 7 % 5 == k) for k in range(5)}
    for n in (1, 20, 1000):
        got = features.per_label(rows, "doc_id", "lang", dict.fromkeys(want, n)).collect()
        assert Counter(r.sample_label for r in got) == {k: min(n, v) for k, v in want.items()}
        assert all(r.sample_id < 900 and r.sample_label == f"l{r.sample_id % 7 % 5}" for r in got)


def test_one_text_of_an_id_is_learned(spark):
    docs = make_docs(spark, [(1, "b"), (1, "a"), (2, "c"), (3, None)])
    sample = features.per_label(docs, "doc_id", "lang", {"en": 9})
    got = features.fitted(docs, sample, lambda col: [(t or "").encode() for t in col.to_pylist()], lambda label, rows: (label, rows))
    assert got == (["en"] * 3, [b"a", b"c", b""])
    assert features.fitted(docs, sample.limit(0), lambda col: [], lambda label, rows: (label, rows)) == ([], [])


def test_losses_are_the_same_sums(monkeypatch):
    rnd = np.random.default_rng(3)
    x, label = rnd.random((60, langid.DIMS), np.float32), np.array([f"l{k % 6}" for k in range(60)], object)
    model = langid.Model(sorted(set(label)), x, label)
    want = model.losses(x)
    monkeypatch.setattr(langid, "FULL_LANGUAGES", 5)
    assert np.allclose(model.losses(x), want)
