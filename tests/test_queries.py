"""Every registered query of the engine against its SQL, on the small tables if they are there."""

import os

import pytest

from lodestack.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("LODESTACK_TESTDATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    got = rows([tuple(r) for r in found.collect()], found.columns)
    assert got == rows(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
