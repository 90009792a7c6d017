"""The queries that SQL can express, against their SQL on DuckDB."""

import duckdb
import pytest

from ledgerlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, key):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    c.execute(f"CREATE VIEW v AS {ORACLES[key]}")
    df = QUERIES[key](spark, SF)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM v").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
