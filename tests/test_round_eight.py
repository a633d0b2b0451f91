"""What reduction and prediction shuffle: chains that meet no other one are set apart, and pairs look up their chains only where two junctions do not settle them."""

import random

import pytest
from tidemark.operators import reduction

TX = "id long, chrom string, exons array<struct<s:bigint,e:bigint>>"


def shuffled(spark, job):
    """Rows that the stages of ``job`` write to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = stages()
    return sum(s.shuffleWriteRecords() for s in map(every.apply, range(every.size())) if (s.stageId(), s.attemptId()) not in before)


@pytest.mark.parametrize("run", [lambda tx: reduction.reduced(tx, 2), lambda tx: reduction.predicted(tx, 2)])
def test_chains_that_meet_no_other_are_not_voted_on(spark, run):
    n, m = 1500, 8
    tx = spark.createDataFrame([(i, f"c{i % 7}", [(10_000 * i + 100 * k, 10_000 * i + 100 * k + 50) for k in range(m + 1)]) for i in range(n)], TX)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        rows = shuffled(spark, lambda: run(tx).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # each junction once where chains meet (predicted: twice), and a few rows a chain
    assert n * m <= rows < n * (2 * m + 10)


def test_meetings(spark):
    rnd = random.Random(24)
    chains = {i: [(100 * k + rnd.randrange(3), 100 * k + 40 + rnd.randrange(3)) for k in range(a, a + rnd.randrange(1, 7))] for i in range(70) for a in [rnd.randrange(6)]}
    rows = [(i, "ab"[i % 2], j, len(j)) for i, j in chains.items()]
    c = spark.createDataFrame(rows, "chain long, chrom string, junctions array<struct<l:bigint,r:bigint>>, m int").repartition(3)
    near = lambda x, y: abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1
    want = {(a, k, b, len(x), len(y)) for a, x in chains.items() for b, y in chains.items() if a != b and a % 2 == b % 2 for k in range(len(x)) if all(near(p, q) for p, q in zip(x[k:], y))}
    assert {min(mb - k, ms) for _, k, _, mb, ms in want} >= {1, 2, 3}
    for width in (16, 1024):
        got = [tuple(r) for r in reduction.meetings(c, 1, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    some = reduction.meetings(c, 1, where="at > 0 AND ms > mb - at").collect()
    assert {tuple(r) for r in some} == {w for w in want if w[1] > 0 and w[4] > w[3] - w[1]}


def test_families_of_chains_apart(spark):
    tx = [(1, "a", [(0, 10), (20, 30), (40, 50)]), (2, "a", [(5, 10), (20, 30)]), (3, "a", [(500, 510), (520, 530)]), (4, "b", [(5, 10), (20, 30)]), (5, "b", [(9, 10)])]
    c = reduction.chains(spark.createDataFrame(tx, TX))
    for how in ("exhaustive", "greedy"):
        assert sorted(map(tuple, reduction.families(c, 0, how).collect())) == [(1, 1, 0), (1, 2, 0), (3, 3, 0), (4, 4, 0)]
    assert sorted((r.chain, r.n) for r in reduction.predicted(spark.createDataFrame(tx, TX), 0).collect()) == [(1, 2), (3, 1), (4, 1)]
    assert [r.chain for r in reduction.reduced(spark.createDataFrame(tx, TX), 0, support=2).collect()] == [1]


def test_transcripts_of_orders_are_dealt_out_once(spark):
    from tidemark.plans.reduction_queries import slot_tx

    plan = slot_tx(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1


def test_ends_keep_their_types(spark):
    c = spark.createDataFrame([(1, "a", [(10, 20), (30, 40)], 2, 1, 0, 50), (2, "a", [(10, 20)], 1, 1, 0, 30)], "chain long, chrom string, junctions array<struct<l:bigint,r:int>>, m int, n long, s int, e bigint")
    got = reduction.consensus(c, reduction.families(c, 0))
    assert got.schema["junctions"].dataType.simpleString() == "array<struct<l:bigint,r:int>>"
    assert [(r.chain, r.n, [tuple(j) for j in r.junctions]) for r in got.collect()] == [(1, 2, [(10, 20), (30, 40)])]
