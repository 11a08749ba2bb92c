"""Every registered query against its SQL check, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
from declcensus.plans.oracles import ORACLES
from declcensus.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        view = name.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    expected = tables.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got.columns, got.collect()) == _rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() == 6
