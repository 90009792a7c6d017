"""Plan audit of every registered query: scans, shuffles, broadcasts,
Python nodes and windows without a partition key, from the executed plan.

Usage: python tools/plan_audit.py [sf_dir]  -> markdown table on stdout.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan().toString()
    # AQE: the final plan after the run.
    final = df._sc._jvm.PythonSQLUtils.explainString(qe, "formatted")
    return {
        "scans": len(re.findall(r"^\(\d+\) Scan parquet", final, re.M)),
        "shuffles": len(re.findall(r"^\(\d+\) Exchange\b", final, re.M)),
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange", final, re.M)),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)),
        "global_window": len(re.findall(r"Window \[[^\n]*windowspecdefinition\((?:[^,()]*\s(?:ASC|DESC)[^)]*)\)", plan)),
        "pushed": "PushedFilters: [" in final and bool(re.search(r"PushedFilters: \[[^\]]+\]", final)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from ledgerlens.plans.registry import all_queries
    from ledgerlens.session import local_session

    spark = local_session()
    print("| key | parquet scans | shuffles | broadcasts | python nodes | windows without partition | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for key, fn in all_queries().items():
        a = audit(fn(spark, sf_dir))
        print(f"| {key} | {a['scans']} | {a['shuffles']} | {a['broadcasts']} | {a['python']} | {a['global_window']} | {'yes' if a['pushed'] else 'no'} |")
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
