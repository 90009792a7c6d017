"""Writes: keyed upsert, range replacement, staged publish, CSV export,
cost pages (batch and streaming) and the daily cost load."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import costs as C
from ledgerlens.plans.jobs import cost_refresh
from ledgerlens.sinks import versions
from ledgerlens.sinks.tables import (
    export_csv,
    exported,
    latest_published,
    merge_latest,
    publish_tables,
    read_published,
    read_replaced,
    read_upserted,
    replace_all,
    replace_range,
    stored_summary,
    upsert_table,
)
from ledgerlens.sources.cost_pages import chain_faults, read_cost_pages, read_pages
from ledgerlens.streaming.cost_landing import start_cost_load

SCHEMA = "date date, account string, service string, amount double"
D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 2, 1)


def _table(spark, path):
    return _rows(read_upserted(spark, path).select("date", "account", "service", "amount"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))


def test_upsert_last_wins_and_null_keys(spark):
    existing = spark.createDataFrame([(D1, "a", "s", 1.0), (D2, "a", "s", 2.0), (D1, None, "s", 5.0)], SCHEMA)
    b1 = spark.createDataFrame([(D1, "a", "s", 10.0), (D1, None, "s", 6.0)], SCHEMA)
    b2 = spark.createDataFrame([(D1, "a", "s", 100.0), (D3, "b", "t", 3.0)], SCHEMA)
    got = _rows(merge_latest(existing, [b1, b2], C.FACT_KEYS))
    assert got == _rows(
        spark.createDataFrame(
            [(D1, "a", "s", 100.0), (D2, "a", "s", 2.0), (D3, "b", "t", 3.0), (D1, None, "s", 5.0), (D1, None, "s", 6.0)],
            SCHEMA,
        )
    )


def test_upsert_within_batch_last_row_wins(spark):
    b = spark.createDataFrame([(D1, "a", "s", 1.0, 1), (D1, "a", "s", 2.0, 2)], SCHEMA + ", seq int")
    got = merge_latest(None, [b], C.FACT_KEYS, seq_col="seq")
    assert [r["amount"] for r in got.collect()] == [2.0]


def test_upsert_table_is_idempotent(spark, scratch):
    path = f"{scratch}/costs"
    batch = spark.createDataFrame([(D1, "a", "s", 1.0), (D3, "a", "s", 3.0)], SCHEMA)
    upsert_table(spark, path, [batch], C.FACT_KEYS)
    upsert_table(spark, path, [batch], C.FACT_KEYS)
    first = _table(spark, path)
    assert first == _rows(batch)
    # A later batch touching only January leaves February untouched.
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 9.0)], SCHEMA)], C.FACT_KEYS)
    assert _table(spark, path) == [(D1, "a", "s", 9.0), (D3, "a", "s", 3.0)]


def test_upsert_keeps_rows_without_a_date(spark, scratch):
    path = f"{scratch}/costs"
    upsert_table(spark, path, [spark.createDataFrame([(None, "a", "s", 1.0), (D1, "a", "s", 2.0)], SCHEMA)], C.FACT_KEYS)
    upsert_table(spark, path, [spark.createDataFrame([(None, "b", "s", 5.0)], SCHEMA)], C.FACT_KEYS)
    assert _table(spark, path) == [(D1, "a", "s", 2.0), (None, "a", "s", 1.0), (None, "b", "s", 5.0)]


def test_a_doubled_key_without_a_sequence_fails(spark):
    b = spark.createDataFrame([(D1, "a", "s", 1.0), (D1, "a", "s", 2.0)], SCHEMA)
    with pytest.raises(Exception, match="holds a key twice"):
        merge_latest(None, [b], C.FACT_KEYS).collect()


def test_a_failed_upsert_leaves_the_table(spark, scratch):
    path = f"{scratch}/costs"
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA)], C.FACT_KEYS)
    twice = spark.createDataFrame([(D1, "a", "s", 2.0), (D1, "a", "s", 3.0)], SCHEMA)
    with pytest.raises(Exception):
        upsert_table(spark, path, [twice], C.FACT_KEYS)
    assert _table(spark, path) == [(D1, "a", "s", 1.0)]
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 4.0)], SCHEMA)], C.FACT_KEYS)
    assert _table(spark, path) == [(D1, "a", "s", 4.0)]


def test_upserted_table_prunes_months(spark, scratch):
    path = f"{scratch}/costs"
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 1.0), (D3, "a", "s", 3.0)], SCHEMA)], C.FACT_KEYS)
    upsert_table(spark, path, [spark.createDataFrame([(D3, "b", "s", 4.0)], SCHEMA)], C.FACT_KEYS)
    df = C.date_range(read_upserted(spark, path), D3, D3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert df.count() == 2


def test_replace_range_empty_input_deletes(spark):
    existing = spark.createDataFrame([(D1, "a", "s", 1.0), (D3, "a", "s", 3.0)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    got = _rows(replace_range(existing, empty, "date", dt.date(2024, 1, 1), dt.date(2024, 1, 31), C.FACT_KEYS))
    assert got == [(D3, "a", "s", 3.0)]
    outside = spark.createDataFrame([(dt.date(2024, 3, 1), "a", "s", 4.0)], SCHEMA)
    got = _rows(replace_range(existing, outside, "date", D1, dt.date(2024, 1, 31), C.FACT_KEYS))
    assert got == [(D3, "a", "s", 3.0), (dt.date(2024, 3, 1), "a", "s", 4.0)]


def test_publish_moves_one_pointer_for_all_tables(spark, scratch):
    base = f"{scratch}/pub"
    assert read_published(spark, base, "a") is None
    one, two = (spark.createDataFrame([(D1, "a", "s", x)], SCHEMA) for x in (1.0, 2.0))
    publish_tables({"a": one, "b": one}, base)
    bad = two.withColumn("amount", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        publish_tables({"a": two, "b": bad}, base)  # fails between its tables
    assert _rows(read_published(spark, base, "a")) == _rows(read_published(spark, base, "b")) == [(D1, "a", "s", 1.0)]
    publish_tables({"a": two, "b": two}, base)
    assert _rows(read_published(spark, base, "a")) == [(D1, "a", "s", 2.0)]


def test_a_half_written_pointer_is_passed_over(spark, scratch):
    base = f"{scratch}/pub"
    publish_tables({"a": spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA)}, base)
    for text in ("", '{"tab'):
        with open(f"{base}/_versions/000000000005.json", "w") as f:
            f.write(text)
        assert read_published(spark, base, "a").count() == 1
    publish_tables({"a": spark.createDataFrame([], SCHEMA)}, base)
    assert read_published(spark, base, "a").count() == 0


def test_errors_are_not_taken_for_an_empty_table(spark, scratch):
    base = f"{scratch}/pub"
    os.makedirs(f"{base}/_versions")
    assert read_published(spark, base, "a") is None and read_upserted(spark, base) is None
    with open(f"{base}/_versions/000000000001.json", "w") as f:
        f.write("")
    with pytest.raises(RuntimeError, match="no pointer"):
        read_published(spark, base, "a")
    with pytest.raises(RuntimeError, match="no pointer"):
        cost_refresh(spark, spark.createDataFrame([], SCHEMA), base, ["a"], "2024-08-01")


def _meanwhile(monkeypatch, job):
    """Runs ``job`` once, just before the next commit."""
    real, waiting = versions.commit, [job]

    def commit(*a):
        if waiting:
            waiting.pop()()
        real(*a)

    monkeypatch.setattr(versions, "commit", commit)


@pytest.mark.parametrize("other", [D3, D1])
def test_a_load_that_another_job_overtakes_loses_nothing(spark, scratch, monkeypatch, other):
    """The other job writes another month (its state is built upon) or the same one (merged again)."""
    path = f"{scratch}/costs"
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA)], C.FACT_KEYS)
    theirs = spark.createDataFrame([(other, "b", "t", 2.0)], SCHEMA)
    _meanwhile(monkeypatch, lambda: upsert_table(spark, path, [theirs], C.FACT_KEYS))
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 5.0), (D2, "a", "s", 6.0)], SCHEMA)], C.FACT_KEYS)
    assert _table(spark, path) == sorted([(D1, "a", "s", 5.0), (D2, "a", "s", 6.0), (other, "b", "t", 2.0)], key=lambda t: tuple(str(x) for x in t))
    assert not versions.Folder(spark, path).names("_staging")


def test_a_load_gives_up_when_it_is_always_overtaken(spark, scratch, monkeypatch):
    path, real = f"{scratch}/costs", versions.commit
    theirs = [spark.createDataFrame([(D1, "b", "t", 2.0)], SCHEMA)]

    def commit(*a):
        monkeypatch.setattr(versions, "commit", real)
        upsert_table(spark, path, theirs, C.FACT_KEYS)
        monkeypatch.setattr(versions, "commit", commit)
        real(*a)

    monkeypatch.setattr(versions, "commit", commit)
    with pytest.raises(versions.Conflict):
        upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA)], C.FACT_KEYS, attempts=2)
    assert _table(spark, path) == [(D1, "b", "t", 2.0)]


def test_tables_are_published_on_the_state_they_were_read_from(spark, scratch):
    base = f"{scratch}/pub"
    one = spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA)
    publish_tables({"a": one, "b": one}, base)
    seen = versions.latest(spark, base)
    two = one.withColumn("amount", F.lit(2.0))
    publish_tables({"a": two, "b": two}, base)
    # Both tables of the state seen belong together; a result of it does not go over the newer one.
    assert _rows(read_published(spark, base, "a", seen)) == _rows(read_published(spark, base, "b", seen)) == _rows(one)
    with pytest.raises(versions.Conflict):
        publish_tables({"a": one, "b": one}, base, seen)
    assert _rows(read_published(spark, base, "a")) == _rows(two)


def test_two_jobs_do_not_publish_the_same_version(spark, scratch):
    versions.commit(spark, scratch, 1, {"tables": {}})
    with pytest.raises(RuntimeError, match="another job"):
        versions.commit(spark, scratch, 1, {"tables": {}})


def test_export_csv(spark, scratch):
    path = f"{scratch}/csv"
    assert exported(spark, path) is None
    one = export_csv(spark.createDataFrame([("Total", "1.234,50")], "service string, cell_text string"), path)
    back = spark.read.option("header", True).csv(one).collect()
    assert [tuple(r) for r in back] == [("Total", "1.234,50")]
    # A failing export leaves the one before; a later one stands beside it.
    with pytest.raises(Exception, match="stop"):
        export_csv(spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("x")), path)
    assert exported(spark, path) == one
    two = export_csv(spark.createDataFrame([("Total", "2")], "service string, cell_text string"), path)
    assert exported(spark, path) == two != one and os.path.isdir(one)


def _page(days):
    return {
        "ResultsByTime": [
            {
                "TimePeriod": {"Start": d, "End": d},
                "Groups": [{"Keys": [svc], "Metrics": {"UnblendedCost": {"Amount": amt}}} for svc, amt in groups],
            }
            for d, groups in days
        ]
    }


def _write_page(path, page):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(page, f, indent=2)


def test_cost_pages(spark, scratch):
    _write_page(f"{scratch}/land/account=acme/p1.json", _page([("2024-01-01", [("AWS Lambda", "1.5"), ("Tax", "0.2")])]))
    _write_page(f"{scratch}/land/account=acme/p2.json", _page([("2024-01-02", [("AWS Lambda", "2")])]))
    got = _rows(read_cost_pages(spark, f"{scratch}/land").drop("seq"))
    assert got == [(D1, "acme", "AWS Lambda", 1.5), (D1, "acme", "Tax", 0.2), (D2, "acme", "AWS Lambda", 2.0)]


def test_streaming_load_takes_new_pages_once(spark, scratch):
    land, table, ckpt = f"{scratch}/land", f"{scratch}/costs", f"{scratch}/ckpt"
    _write_page(f"{land}/account=acme/p1.json", _page([("2024-01-01", [("S3", "1.0")])]))
    start_cost_load(spark, land, table, ckpt).awaitTermination()
    _write_page(f"{land}/account=acme/p2.json", _page([("2024-01-01", [("S3", "4.0")]), ("2024-02-01", [("S3", "3")])]))
    start_cost_load(spark, land, table, ckpt).awaitTermination()
    start_cost_load(spark, land, table, ckpt).awaitTermination()  # nothing new
    assert _table(spark, table) == [(D1, "acme", "S3", 4.0), (D3, "acme", "S3", 3.0)]


@pytest.mark.parametrize("larger", ["old", "new"])
def test_streaming_load_keeps_the_page_that_came_last(spark, scratch, larger):
    """Two pages of one key in one batch; Spark packs files by size, not by age."""
    many = [("2024-01-01", [(f"svc{i}", "7") for i in range(200)])]
    old, new = [("2024-01-01", [("S3", "1.0")])], [("2024-01-01", [("S3", "4.0")])]
    land = f"{scratch}/land/account=acme"
    _write_page(f"{land}/b.json", _page(old + many * (larger == "old")))
    _write_page(f"{land}/a.json", _page(new + many * (larger == "new")))
    os.utime(f"{land}/b.json", (1_700_000_000, 1_700_000_000))
    os.utime(f"{land}/a.json", (1_700_000_100, 1_700_000_100))
    start_cost_load(spark, f"{scratch}/land", f"{scratch}/costs", f"{scratch}/ckpt").awaitTermination()
    got = read_upserted(spark, f"{scratch}/costs").where("service = 'S3'").collect()
    assert [r["amount"] for r in got] == [4.0]


@pytest.mark.parametrize("broken", ['{"ResultsByTime": [{"TimePeriod": {"Start": "2024-01-02"', '{"Other": 1}'])
def test_an_unreadable_page_fails(spark, scratch, broken):
    _write_page(f"{scratch}/land/account=acme/p1.json", _page([("2024-01-01", [("S3", "1.0")])]))
    with open(f"{scratch}/land/account=acme/p2.json", "w") as f:
        f.write(broken)
    with pytest.raises(Exception):
        read_cost_pages(spark, f"{scratch}/land").collect()


def test_cost_refresh_windows(spark, scratch):
    path = f"{scratch}/costs"
    lines = spark.createDataFrame(
        [
            (dt.date(2023, 7, 31), "a", "L1", "s", 1.0),
            (dt.date(2023, 8, 1), "a", "L1", "s", 2.0),
            (dt.date(2024, 7, 10), "a", "L1", "s", 3.0),
            (dt.date(2024, 7, 10), "a", "L2", "s", 30.0),
            (dt.date(2024, 7, 10), "a", None, "s", 0.5),
        ],
        "date date, account string, linked_account string, service string, amount double",
    )
    excl = spark.createDataFrame([("a", "L2")], "account string, linked_account string")
    s = cost_refresh(spark, lines, path, ["a"], "2024-08-01", exclusions=excl).first()
    # Nothing loaded: backfill from 2023-08-01; 2023-07-31 is outside; L2 is left out, NULL kept.
    assert (s["total_rows"], s["min_date"], s["max_date"]) == (2, dt.date(2023, 8, 1), dt.date(2024, 7, 10))
    assert _table(spark, path) == [(dt.date(2023, 8, 1), "a", "s", 2.0), (dt.date(2024, 7, 10), "a", "s", 3.5)]
    w = C.load_windows(read_upserted(spark, path), ["a", "b"], "2024-08-01").collect()
    assert sorted((r["account"], r["start"], r["stop"]) for r in w) == [
        ("a", dt.date(2024, 7, 9), dt.date(2024, 8, 2)),
        ("b", dt.date(2023, 8, 1), dt.date(2024, 8, 2)),
    ]
    # An account whose last row is older than the previous month: found by
    # the second, account-filtered lookup, and reloaded from the day before.
    w = C.load_windows(read_upserted(spark, path), ["a"], "2024-10-03").collect()
    assert [(r["account"], r["start"]) for r in w] == [("a", dt.date(2024, 7, 9))]


def test_replace_all(spark, scratch):
    path = f"{scratch}/t"
    assert read_replaced(spark, path) is None
    replace_all(spark.createDataFrame([(D1, "a", "s", 1.0), (D3, "a", "s", 2.0)], SCHEMA), path)
    replace_all(spark.createDataFrame([(D2, "b", "s", 5.0)], SCHEMA), path)
    assert _rows(read_replaced(spark, path)) == [(D2, "b", "s", 5.0)]
    bad = spark.createDataFrame([(D2, "b", "s", 6.0)], SCHEMA).withColumn("amount", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        replace_all(bad, path)
    assert _rows(read_replaced(spark, path)) == [(D2, "b", "s", 5.0)]
    replace_all(spark.createDataFrame([(D1, "a", "s", 1.0)], SCHEMA), path, ["account"])
    assert _rows(read_replaced(spark, path).select("date", "account", "service", "amount")) == [(D1, "a", "s", 1.0)]


def test_table_names_and_service_collapse(spark):
    from ledgerlens.sources.tables import is_valid_table_name

    assert is_valid_table_name("cost_facts") and is_valid_table_name("_t1")
    assert not is_valid_table_name("costs; DROP TABLE x") and not is_valid_table_name("1abc")
    df = spark.createDataFrame(
        [("a", "s", None, 2.0), ("a", "s", 1.0, None), ("a", "t", 3.0, 4.0)], "account string, service string, mtd double, avg6 double"
    )
    got = _rows(C.collapse_duplicate_services(df))
    assert got == [("a", "s", 1.0, 2.0), ("a", "t", 3.0, 4.0)]


def test_results_do_not_depend_on_broadcast(spark):
    """The shuffle-join fallbacks (no broadcast anywhere) give the same rows."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    keys = [
        "period_metrics_per_account", "period_metrics_all_anchors", "linked_account_exclusion",
        "service_label", "incremental_window", "daily_delta_seeded",
    ]
    want = {k: _rows(entry.queries()[k](spark, sf)) for k in keys}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in keys:
            df = entry.queries()[k](spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan, k
            assert _rows(df) == want[k], k
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_service_map_with_a_doubled_raw_name_does_not_multiply_facts(spark):
    facts = spark.createDataFrame([(D1, "a", "raw1", 1.0), (D1, "a", "raw2", 2.0)], SCHEMA)
    dim = spark.createDataFrame([("raw1", "L"), ("raw1", "L"), ("raw2", "M")], "raw string, label string")
    got = _rows(C.label_services(facts, dim))
    assert got == [(D1, "a", "L", 1.0), (D1, "a", "M", 2.0)]


def _chain(days, token=None, after=None):
    return {"ResultsByTime": _page(days)["ResultsByTime"]} | ({"PageToken": token} if token else {}) | ({"NextPageToken": after} if after else {})


def _day(i, amount="1"):
    return (f"2024-01-{i:02d}", [("S3", amount)])


def test_a_chain_of_pages_is_read_in_its_order(spark, scratch):
    """Names and times of the files say another order than the tokens; a path with a blank and a plus."""
    land = f"{scratch}/land/account=my acct+1/request=r 1"
    order = ["", "t9", "t3", "t7", "t1"]
    for k, t in enumerate(order):
        path = f"{land}/{9 - k}.json"
        _write_page(path, _chain([_day(1, str(k))], t, order[k + 1] if k < 4 else None))
        os.utime(path, (1_700_000_000 - 10 * k, 1_700_000_000 - 10 * k))
    rows = read_cost_pages(spark, f"{scratch}/land")
    assert [(r["account"], r["amount"]) for r in merge_latest(None, [rows], C.FACT_KEYS, "seq").collect()] == [("my acct+1", 4.0)]
    assert [r["amount"] for r in rows.orderBy("seq").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize(
    "pages, faults",
    [
        ([("", "a"), ("a", "b"), ("b", "")], []),
        ([("", "a"), ("b", "")], [("missing_page", "a"), ("unasked_page", "b")]),
        ([("a", "b"), ("b", "")], [("no_first", None), ("unasked_page", "a")]),
        ([("", "a"), ("a", "b")], [("missing_page", "b"), ("no_end", None)]),
        ([("", "a"), ("a", ""), ("a", "")], [("doubled_page", "a"), ("two_ends", None)]),
        ([("", ""), ("", "")], [("two_ends", None), ("two_firsts", None)]),
        ([("", ""), ("a", "b"), ("b", "c"), ("c", "a")], [("cycle", "3")]),
    ],
)
def test_chain_faults(spark, scratch, pages, faults):
    for i, (token, after) in enumerate(pages):
        _write_page(f"{scratch}/land/account=x/request=1/{i}.json", _chain([_day(1 + i)], token, after))
    got = sorted(((r["fault"], r["detail"]) for r in chain_faults(read_pages(spark, f"{scratch}/land")).collect()), key=str)
    assert got == faults
    if faults:
        with pytest.raises(ValueError, match="incomplete"):
            read_cost_pages(spark, f"{scratch}/land")
    else:
        assert read_cost_pages(spark, f"{scratch}/land").count() == len(pages)


@pytest.mark.parametrize(
    "day, what",
    [
        ({"TimePeriod": {"Start": "2024-01-02"}}, "no Groups"),
        ({"TimePeriod": {"Start": "2024-01-02"}, "Groups": None}, "no Groups"),
        ({"TimePeriod": {"End": "2024-01-02"}, "Groups": []}, "no start"),
        ({"Groups": []}, "no start"),
        ({"TimePeriod": {"Start": "2024-01-02"}, "Groups": [{"Keys": ["s"], "Metrics": {"UnblendedCost": {}}}]}, "no amount"),
        ({"TimePeriod": {"Start": "2024-01-02"}, "Groups": [{"Keys": ["s"]}]}, "no amount"),
        ({"TimePeriod": {"Start": "2024-01-02"}, "Groups": [{"Keys": [], "Metrics": {"UnblendedCost": {"Amount": "1"}}}]}, "no key"),
    ],
)
def test_a_page_with_a_part_missing_fails(spark, scratch, day, what):
    _write_page(f"{scratch}/land/account=x/1.json", {"ResultsByTime": [*_page([_day(1)])["ResultsByTime"], day]})
    with pytest.raises(Exception, match=what):
        read_cost_pages(spark, f"{scratch}/land").collect()


def test_a_day_without_costs_is_no_error(spark, scratch):
    _write_page(f"{scratch}/land/account=x/1.json", _page([("2024-01-01", []), _day(2)]))
    assert read_cost_pages(spark, f"{scratch}/land").count() == 1


def test_summaries_come_from_file_footers(spark, scratch):
    path, base = f"{scratch}/costs", f"{scratch}/pub"
    assert stored_summary(spark, path) is None and latest_published(spark, base, "daily", "date") is None
    upsert_table(spark, path, [spark.createDataFrame([(D1, "a", "s", 1.0), (None, "a", "s", 2.0), (D3, "b", "s", 3.0)], SCHEMA)], C.FACT_KEYS)
    upsert_table(spark, path, [spark.createDataFrame([(D2, "a", "s", 1.0)], SCHEMA)], C.FACT_KEYS)
    summary = stored_summary(spark, path)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date)]" in plan and "PushedAggregation: [COUNT(*)]" in plan
    assert tuple(summary.first()) == (4, D1, D3) == tuple(C.load_summary(read_upserted(spark, path)).first())
    publish_tables({"daily": spark.createDataFrame([(D2,), (D3,), (None,)], "date date"), "none": spark.createDataFrame([], "date date")}, base)
    assert latest_published(spark, base, "daily", "date") == D3
    assert latest_published(spark, base, "none", "date") is None and latest_published(spark, base, "other", "date") is None
