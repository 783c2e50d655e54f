"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("RILLFOLD_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())))
    done = db.execute(SQL[name])
    names = [x[0] for x in done.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in done.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["pk", "ck", "v"]
