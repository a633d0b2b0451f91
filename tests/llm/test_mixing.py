import math
import random
from collections import Counter, defaultdict

import pytest
from corpus_fixtures import make_docs
from tidemark.llm import mixing


def test_exponent_meets_limits():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = mixing.exponent(shares, repeat_limit=2.0)
    w = mixing.weights(shares, a)
    r = [w[s] / shares[s] for s in shares]
    assert max(r) / min(r) == pytest.approx(2.0)
    target = (mixing.entropy(shares) + math.log(3)) / 2
    assert mixing.entropy(mixing.weights(shares, mixing.exponent(shares, target_entropy=target))) == pytest.approx(target)
    assert mixing.exponent(shares, repeat_limit=100) == 0.0
    sharp = mixing.exponent(shares, target_entropy=0.1)  # below the entropy of the shares: above 1
    assert sharp > 1 and mixing.entropy(mixing.weights(shares, sharp)) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        mixing.exponent({"a": 0.5, "b": 0.5}, target_entropy=0.1)
    assert mixing.exponent({}, 2.0) == 1.0


def _docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(rnd.randrange(1, 40))), "en", rnd.choice(["hot"] * 8 + ["b", None])) for i in range(900)]
    return rows, make_docs(spark, rows, extra=True)


def test_every_source_reaches_its_weight(spark):
    rows, docs = _docs(spark)
    got = mixing.mix(docs, repeat_limit=1.5).select("doc_id", "source", "mix_epoch", "mix_tokens", "mix_order").collect()
    totals, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        totals[s] += len(t.split())
    for r in got:
        taken[r.source] += r.mix_tokens
    times = Counter(r.doc_id for r in got)
    assert set(times) == {r[0] for r in rows}  # every document at least once
    assert {r.mix_tokens for r in got if r.doc_id == 3} == {len(rows[3][1].split())}
    ratio = {s: taken[s] / totals[s] for s in totals}
    longest = max(len(t.split()) for _, t, _, _ in rows)
    a = mixing.exponent({s or "": n / sum(totals.values()) for s, n in totals.items()}, 1.5)
    w = mixing.weights({s or "": n / sum(totals.values()) for s, n in totals.items()}, a)
    least = min(w[s or ""] / totals[s] for s in totals)
    for s in totals:
        want = w[s or ""] / totals[s] / least
        assert want * totals[s] - longest - 1 <= taken[s] <= want * totals[s] + 1
    assert min(ratio.values()) == pytest.approx(1.0)
    assert all(0 <= r.mix_order < 1 for r in got)
    assert max(times.values()) <= 2


def test_budget_below_one_epoch_takes_a_part_of_each(spark):
    rows, docs = _docs(spark)
    got = mixing.mix(docs, budget=4000, target_entropy=0.9).collect()
    assert 4000 - 3 * 40 <= sum(r.mix_tokens for r in got) <= 4000
    assert max(Counter(r.doc_id for r in got).values()) == 1


def test_empty_and_tokenless(spark):
    assert mixing.mix(make_docs(spark, [])).count() == 0
    got = mixing.mix(make_docs(spark, [(1, None), (2, ""), (None, "a b"), (2, "")])).collect()
    assert len(got) == 4
