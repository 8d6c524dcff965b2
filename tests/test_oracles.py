"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare
from workload.registry import ORACLES, QUERIES

from conftest import SF_DIR


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    outcome, _ = compare(spark, connection, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith(("ok", "rows only")), outcome


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
