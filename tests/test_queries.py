"""Every registered query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from tactuslab.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (str, bool)):
        return x
    return round(float(x), 9)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in values)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        expected = con.execute(ORACLES[name])
        columns = [d[0] for d in expected.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, expected.fetchall())
