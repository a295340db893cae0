"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from trailgraph.oracles import ORACLES
from trailgraph.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def sorted_rows(rows, columns, order):
    positions = [columns.index(name) for name in order]
    return sorted((tuple(row[p] for p in positions) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    rows = found.collect()
    assert rows
    cursor = duck.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    order = sorted(found.columns)
    assert order == sorted(columns)
    expected = sorted_rows(cursor.fetchall(), columns, order)
    assert sorted_rows(rows, found.columns, order) == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "depth"]
