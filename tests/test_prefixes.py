"""Month prefixes give what the facts give, before and after upserts, and reports read nothing else."""

import datetime as dt
import random

import pytest

from ledgerlens.operators import costs as C
from ledgerlens.operators.prefixes import month_prefixes
from ledgerlens.plans.jobs import cost_refresh, cost_report_for_period, read_prefixes, upsert_costs
from ledgerlens.sinks import versions
from ledgerlens.sinks.tables import read_derived, read_upserted, upsert_table

SCHEMA = "date date, account string, service string, amount double"
D0 = dt.date(2023, 1, 1)


def some_facts(seed, n=600, since=0, until=460):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = (D0 + dt.timedelta(days=rng.randrange(since, until)), rng.choice(["a", "b", "c"]), rng.choice(["s", "t", "Tax"]))
        rows[key] = rng.choice([None, 0.0, -5.25, round(rng.random() * 1000, 2)])
    out = [(*k, v) for k, v in rows.items()]
    return out + [(D0 + dt.timedelta(days=400), None, "s", 3.0), (D0 + dt.timedelta(days=430), "a", None, 4.0), (None, "a", "s", 9.0)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def views(df):
    """Everything a report reads, of facts or prefixes."""
    anchors = C.month_anchors(df, ordered=False)
    yield C.period_metrics(df, None, 2)
    yield C.period_metrics(df, "2024-03-30", 2)
    yield C.period_metrics(df, "2024-02-29", 2)
    yield C.period_metrics(df, "2022-01-05", 2)
    yield C.period_metrics_for_month(df, "2024-02-01", 2)
    yield anchors
    yield C.period_metrics_for_anchors(df, anchors, money_scale=2)
    yield C.period_metrics_for_anchors(df, anchors.select("account", "month_start"), full_month=True, money_scale=2)
    yield C.period_metrics_for_anchors(df, anchors.where("false"), money_scale=2)
    yield C.latest_loaded(df)
    for lo, hi in ((None, None), (dt.date(2024, 3, 1), dt.date(2024, 4, 2)), (dt.date(2024, 3, 20), dt.date(2024, 3, 22)), (dt.date(2024, 3, 28), None), (None, dt.date(2023, 1, 1))):
        yield C.accounts_between(df, lo, hi)
    for period in ("current", "month:2024-01-01"):
        for mtd in (True, False):
            yield cost_report_for_period(df, period, mtd=mtd, money_scale=2)


def test_prefixes_give_what_facts_give(spark):
    facts = spark.createDataFrame(some_facts(1), SCHEMA)
    assert C.latest_date(facts) == C.latest_date(month_prefixes(facts, 2))
    for of_facts, of_prefixes in zip(views(facts), views(month_prefixes(facts, 2)), strict=True):
        assert rows_of(of_facts) == rows_of(of_prefixes)


def test_an_upsert_keeps_them_and_works_out_touched_months_only(spark, scratch):
    path = f"{scratch}/costs"
    assert read_prefixes(spark, path) is None
    upsert_costs(spark, path, [spark.createDataFrame(some_facts(2), SCHEMA)], 2)
    before = versions.head(spark, path)["derived"]["prefixes"]["parts"]
    upsert_costs(spark, path, [spark.createDataFrame([(dt.date(2024, 2, 3), "a", "s", 7.0), (dt.date(2024, 9, 9), "d", "s", 1.0)], SCHEMA)], 2)
    after = versions.head(spark, path)["derived"]["prefixes"]["parts"]
    assert sorted(n for n in after if after[n] != before.get(n)) == ["month=2024-02-01", "month=2024-09-01"]
    columns = ["account", "service", "month", "prefix_sums", "prefix_rows"]
    assert rows_of(read_prefixes(spark, path).select(columns)) == rows_of(month_prefixes(read_upserted(spark, path), 2).select(columns))


def test_a_report_scans_no_facts(spark, scratch):
    path = f"{scratch}/costs"
    upsert_costs(spark, path, [spark.createDataFrame(some_facts(3), SCHEMA)], 2)
    report = cost_report_for_period(read_prefixes(spark, path), "month:2024-01-01", money_scale=2)
    read = report.inputFiles()
    assert read and all("/d=prefixes/" in f for f in read)
    plan = C.period_metrics(read_prefixes(spark, path), "2024-03-30", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_table_loaded_without_them_gets_them_with_the_next_upsert(spark, scratch):
    path = f"{scratch}/costs"
    one = spark.createDataFrame([(D0, "a", "s", 1.0), (dt.date(2023, 5, 5), "a", "s", 2.0)], SCHEMA)
    upsert_table(spark, path, [one], C.FACT_KEYS)
    with pytest.raises(RuntimeError, match="lacks month=2023-01-01, month=2023-05-01"):
        read_prefixes(spark, path)
    upsert_costs(spark, path, [spark.createDataFrame([(D0, "b", "s", 3.0)], SCHEMA)], 2)
    assert rows_of(read_prefixes(spark, path).select("account", "month")) == [("a", D0), ("a", dt.date(2023, 5, 1)), ("b", D0)]
    # A later upsert without them leaves its months without, and says so.
    upsert_table(spark, path, [spark.createDataFrame([(D0, "b", "s", 4.0)], SCHEMA)], C.FACT_KEYS)
    with pytest.raises(RuntimeError, match="lacks month=2023-01-01;"):
        read_derived(spark, path, "prefixes")


def test_an_overtaken_load_publishes_prefixes_of_the_merged_rows(spark, scratch, monkeypatch):
    path, real, waiting = f"{scratch}/costs", versions.commit, [1]
    theirs = spark.createDataFrame([(D0, "b", "s", 2.0), (dt.date(2023, 7, 1), "b", "s", 5.0)], SCHEMA)

    def commit(*a):
        if waiting and waiting.pop():
            upsert_costs(spark, path, [theirs], 2)
        real(*a)

    monkeypatch.setattr(versions, "commit", commit)
    upsert_costs(spark, path, [spark.createDataFrame([(D0, "a", "s", 1.0)], SCHEMA)], 2)
    columns = ["account", "service", "month", "prefix_sums", "prefix_rows"]
    assert read_upserted(spark, path).count() == 3
    assert rows_of(read_prefixes(spark, path).select(columns)) == rows_of(month_prefixes(read_upserted(spark, path), 2).select(columns))


def test_the_daily_load_keeps_them(spark, scratch):
    path = f"{scratch}/costs"
    lines = spark.createDataFrame([(dt.date(2024, 7, 10), "a", None, "s", 3.0)], "date date, account string, linked_account string, service string, amount double")
    cost_refresh(spark, lines, path, ["a"], "2024-08-01", money_scale=2)
    assert rows_of(C.period_metrics(read_prefixes(spark, path), "2024-07-31", 2).select("account", "service", "mtd")) == [("a", "s", 3.0)]
