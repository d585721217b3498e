"""Every registered query against its SQL, value for value."""

import duckdb
import pytest

from __spark_entry__ import entry
from testbed.catalogue import catalogue
from testbed.oracles import oracles

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_an_oracle():
    assert set(catalogue()) == set(oracles())


@pytest.mark.parametrize("name", list(catalogue()))
def test_query_matches_oracle(spark, duck, name):
    result = catalogue()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    found = [tuple(row[c] for c in columns) for row in result.collect()]
    cursor = duck.execute(oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert found
    assert _sorted(found) == _sorted(expected)
    assert [type(v) for v in found[0]] == [type(v) for v in expected[0]]


def test_entry_has_rows(spark):
    assert entry(spark).count() == 200
