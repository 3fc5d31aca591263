"""Every named query runs; those with an SQL twin agree with it."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in SQL:
        found = engine.execute(SQL[name])
        assert compare(df.columns, rows, [d[0] for d in found.description], found.fetchall()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["split_a", "split_b", "reason", "pairs"]
