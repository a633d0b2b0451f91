"""Every registered query against its own SQL in DuckDB on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest
from tidemark.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list) else repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.CATALOG))
def test_query_equals_its_sql(spark, duck, name):
    fn, sql = catalog.CATALOG[name]
    got = fn(spark, str(DATA))
    rows = [tuple(r) for r in got.collect()]
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(got.columns) == sorted(rel.columns)
    assert norm(got.columns, rows) == norm(rel.columns, rel.fetchall())
