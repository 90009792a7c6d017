"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.plans.registry import all_oracles, all_queries
from tools.compare import TABLES, rows_key

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KEYS = sorted(all_queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(KEYS) == set(all_oracles())
    assert set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle_rows AS {entry.oracle_sql()[key]}")  # as the checks run it
    cur = con.execute("SELECT * FROM oracle_rows")
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert rows_key(df.columns, rows) == rows_key(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "mtd" in df.columns
