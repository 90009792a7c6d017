"""As-of joins and global ranks against plain loops; no task holds a key, or all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.asof import asof_join, last_days_rows
from ledgerlens.operators.ranks import global_rank

D = dt.date(2023, 11, 5)


def day(n):
    return D + dt.timedelta(days=n)


@pytest.mark.parametrize("keyed", [True, False])
def test_asof_join(spark, keyed):
    rng = random.Random(keyed)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), day(rng.randrange(0, 400, 7)), i) for i in range(200)] + [("a", None, 9)]
    asked = [(rng.choice(["a", "b", None, "hot", "none"]), day(rng.randrange(-30, 450)), i) for i in range(300)] + [("a", None, 300)]
    keys = ["k"] if keyed else []
    r = spark.createDataFrame(rows, "k string, d date, v int")
    q = spark.createDataFrame(asked, "k string, d date, n int")
    if not keyed:
        q = q.drop("k")
    got = {x["n"]: x["v"] for x in asof_join(q, r, keys, "d", ["v"]).collect()}
    assert len(got) == len(asked)
    for k, d, n in asked:
        before = [(x, v) for y, x, v in rows if d and x and x <= d and (y == k or not keyed)]
        assert got[n] == (max(before)[1] if before else None)


def test_asof_join_splits_a_hot_key(spark):
    """The merge and its exchange are by key and month, not by key."""
    r = spark.createDataFrame([("hot", day(0), 1)], "k string, d date, v int")
    plan = asof_join(r.drop("v"), r, ["k"], "d", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [last(_taken" in plan and "hashpartitioning(k#" in plan
    assert any("hashpartitioning(k#" in line and "_block#" in line for line in plan.split("\n"))


def test_last_days_rows(spark):
    rng = random.Random(7)
    rows = {(day(rng.randrange(0, 200)), t): float(rng.randrange(0, 5) * 10) for t in "abc" for _ in range(25 if t != "c" else 3)}
    df = spark.createDataFrame([(d, t, v) for (d, t), v in rows.items()], "date date, tenant string, total_pods double")
    got = {(r["as_of"], r["tenant"]): (r["latest_date"], r["value"], r["baseline_value"], r["delta"], r["pct"]) for r in last_days_rows(df).collect()}
    days = sorted({d for d, _ in rows})
    want = {}
    at = days[0]
    while at <= days[-1] + dt.timedelta(days=59):
        lo = at - dt.timedelta(days=59)
        latest = max((d for d in days if d <= at), default=None)
        if at <= days[-1]:
            for t in {t for d, t in rows if lo <= d <= at}:
                value = lambda until: next((rows[d, t] for d in reversed(days) if lo <= d <= until and (d, t) in rows), 0.0)
                v, b = value(latest), value(latest - dt.timedelta(days=30))
                want[at, t] = (latest, v, b, v - b, (v - b) / b if b else None)
        at += dt.timedelta(days=1)
    assert got == want


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 0.0, 0.0, rng.random()]), f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "v double, t string").repartition(6)
    order = [F.col("v").desc_nulls_last(), F.col("t").asc()]
    ranked = global_rank(df, order)
    assert "Window [row_number" in (plan := ranked._jdf.queryExecution().executedPlan().toString()) and "SinglePartition" not in plan
    got = {r["t"]: r["rank"] for r in ranked.collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {t: i for i, (_, t) in enumerate(want, 1)}
    assert global_rank(df.where("false"), order).collect() == []
