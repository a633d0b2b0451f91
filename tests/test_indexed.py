"""Look-ups by name, number and coordinates against a scan, and that they read no other part."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidemark.sources import indexed

SCHEMA = "qname string, rname string, pos int, n int, flag int, line long"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(f"r{rnd.randrange(300)}", rnd.choice(["c1", "c1", "c1", "c2"]), rnd.randrange(1, 5000), rnd.randrange(1, 80), rnd.choice([0, 256, 2048]), i) for i in range(2000)]


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    indexed.build(df, path, F.col("pos") + F.col("n"), 12, primary=F.col("flag").bitwiseAND(2304) == 0, buckets=8)
    return path


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_look_ups(spark, rows, store):
    x = indexed.Index(spark, store)
    names = ["r7", "r19", "nobody"]
    assert got(x.by_names(names)) == sorted(r for r in rows if r[0] in names)
    assert got(x.by_table(spark.createDataFrame([(n,) for n in names], "name string"))) == sorted(r for r in rows if r[0] in names)
    assert got(x.by_ordinals([3, 1999, 5000])) == sorted(r for r in rows if r[5] in (3, 1999))
    for chrom, s, e in (("c1", 100, 140), ("c2", 1, 5000), ("c3", 1, 9), ("c1", 4999, 4999)):
        assert got(x.by_range(chrom, s, e)) == sorted(r for r in rows if r[1] == chrom and r[2] <= e and r[2] + r[3] > s)
    want = []
    for n in ("r7", "r19"):
        own = [r for r in rows if r[0] == n and r[4] == 0]
        want += own and [min(own, key=lambda r: r[5])]
    assert got(x.by_names(names, primary=True)) == got(x.by_table(spark.createDataFrame([(n,) for n in names], "name string"), True)) == sorted(want)
    with pytest.raises(ValueError):
        x.by_names([f"n{i}" for i in range(indexed.MOST + 1)])


def test_only_the_parts_named_are_read(spark, rows, store, tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(store, copy)
    want = sorted(r for r in rows if r[1] == "c1" and r[2] <= 140 and r[2] + r[3] > 100)
    bounds = spark.read.parquet(f"{copy}/parts").collect()
    needed = {r.part for r in bounds if r.chrom == "c1" and r["first"] <= 140 and r.end > 100}
    assert len({r.part for r in bounds}) == 12 and len(needed) <= 2
    for part in Path(copy, "data").glob("part=*"):  # what is not needed cannot be read any more
        if int(part.name.split("=")[1]) not in needed:
            for f in part.glob("*.parquet"):
                f.write_bytes(b"no table")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    x = indexed.Index(spark, str(copy))
    assert got(x.by_range("c1", 100, 140)) == want
    name = want[0][0]
    alone = [r for r in rows if r[0] == name]
    parts = {r.part for r in spark.read.parquet(f"{copy}/names").where(F.col("name") == name).collect()}
    if parts - needed:
        with pytest.raises(Exception):  # noqa: B017 - the name has records in parts that are gone
            got(x.by_names([name]))
    one = next(r for r in want if r[0] == name)
    assert got(x.by_ordinals([one[5]])) == [one] and alone


def test_no_records(spark, tmp_path):
    indexed.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), F.col("pos") + F.col("n"), 3)
    x = indexed.Index(spark, str(tmp_path / "none"))
    assert got(x.by_names(["a"])) == got(x.by_range("c1", 1, 9)) == got(x.by_ordinals([1])) == []
