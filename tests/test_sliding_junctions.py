from tidemark.operators import junctions


def test_equivalent_junctions_slide_until_the_letters_differ(spark):
    seq = "G" + "AC" * 100 + "T"  # a cut of 4 letters can slide over the whole repeat
    sites = spark.createDataFrame([("c", 101, 105)], "chrom string, l bigint, r bigint")
    got = junctions.equivalent(sites, spark.createDataFrame([("c", seq)], "chrom string, seq string")).collect()
    want = {k for k in range(len(seq)) if k + 4 <= len(seq) and seq[:k] + seq[k + 4 :] == seq[:101] + seq[105:]}
    assert {(r.el, r.er) for r in got} == {(k, k + 4) for k in want} and len(got) > 150
