"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from leadloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float) or hasattr(v, "quantize"):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = db.execute(SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["userId", "name", "email", "date", "count"]
    assert set(e.oracle_sql()) <= set(e.queries())
