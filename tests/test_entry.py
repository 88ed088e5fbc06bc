"""Every registered query against its SQL on the smallest data."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("GRISTDEX_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return repr(v)
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in entry.oracle_sql():
        want = db.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
