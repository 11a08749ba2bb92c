"""Registered queries that SQL can express, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
from declcensus.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    got, expected = QUERIES[name](spark, DATA), connection.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = expected.columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, expected.fetchall()))
