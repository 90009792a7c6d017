"""Time the DuckDB oracles of every key at one scale (single-node reference
point: the reference runs its cost SQL on this engine). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerlens.plans.registry import all_oracles  # noqa: E402
from tools.compare import TABLES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    threads = int(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    times = {}
    for key, sql in all_oracles().items():
        t0 = time.perf_counter()
        con.execute(sql).fetchall()
        times[key] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "duckdb_oracle_seconds", "value": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    main()
