"""Queries with an SQL twin against it."""

import duckdb
import pytest

from check_oracles import TABLES, compare
from revaxis.llm.queries import ORACLES, QUERIES


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    outcome, _ = compare(spark, connection, sf_dir, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome
