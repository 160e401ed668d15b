"""Every registered query against its SQL counterpart on the same tables."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from repoquarry.plans.oracles import ORACLES
from repoquarry.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= contract.queries().keys() and ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(repr, result.fetchall()))
    found = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert found == expected
    assert expected, "the input must make the query return rows"


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
