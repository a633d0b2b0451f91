"""Fill-in-middle: exact round trips, and the definition written out by hand."""

import hashlib
import random

import numpy as np
import pytest
from corpus_fixtures import make_docs
from tidemark.llm import fim

TEXTS = ["", None, "a", "ab", "héllo wörld", "日本語 テキスト", "😀😁 mixed\n\nlines\tand tabs", "<P> inside", "x<S>", "y<M>z", "almost <P or S> <", "é" * 3000, "\u0000nul", "tail<"]


def by_hand(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    x, y, z = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def test_every_row_by_hand(spark):
    rnd = random.Random(1)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "no id"), (5, "again"), (5, "again")]
    rows += [(1000 + i, "".join(rnd.choice("ab <PSM>é\n😀") for _ in range(rnd.randrange(40)))) for i in range(300)]
    got = fim.fill_in_middle(make_docs(spark, rows, extra=True).repartition(4)).collect()
    have = sorted((repr(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode()) for r in got)
    want = []
    for i, t in rows:
        n, form, p, m, out = by_hand(i, t)
        want.append((repr(i), n, form, p, m, out, t or ""))
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(make_docs(spark, [])).count() == 0


@pytest.mark.parametrize("unit", ["codepoint", "word", "line"])
def test_units_and_round_trip(unit):
    rnd = random.Random(2)
    for _ in range(400):
        t = "".join(rnd.choice("ab  \n<>PSMé日😀") for _ in range(rnd.randrange(60))).encode()
        drawn = tuple(rnd.randrange(2**32) for _ in range(4))
        n, form, p, m, out = fim.transform(t, drawn, unit)
        assert fim.restored(out, form) == t
        at = fim.boundaries(fim.decoded(t), unit)
        assert n == len(at) - 1 and (np.diff(at) > 0).all() and at[-1] == len(t.decode())
        if form != "plain":
            assert p in at and p + m in at
    words = fim.boundaries(fim.decoded(b"two  words\n last"), "word")
    assert words.tolist() == [0, 5, 12, 16] and fim.boundaries(fim.decoded(b"a\nbc\n\nd"), "line").tolist() == [0, 2, 5, 6, 7]
    with pytest.raises(ValueError):
        fim.boundaries(fim.decoded(b"x"), "page")


def test_bytes_that_are_not_text_come_back():
    t = b"ok \xff\xfe bad \xc3"
    for turn in (0, 99):
        _, form, _, _, out = fim.transform(t, (3, 9, 0, turn))
        assert form != "plain" and fim.restored(out, form) == t


def test_very_long_text(spark):
    t = "long é " * 300_000
    [r] = fim.fill_in_middle(make_docs(spark, [(3, t)])).collect()
    assert bytes(r.restored).decode() == t and r.n == len(t)
