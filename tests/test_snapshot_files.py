"""Snapshot JSON files generated in a fresh folder: reading, flattening,
validation reasons, coverage of years, and the end-to-end load."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import snapshots as S
from ledgerlens.plans.jobs import snapshot_refresh
from ledgerlens.sinks.tables import read_published
from ledgerlens.sources import snapshot_files as SF


def _write(path, payload, gz=False, raw=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = raw if raw is not None else json.dumps(payload).encode()
    if gz:
        data = gzip.compress(data)
    with open(path, "wb") as f:
        f.write(data)


def _year_payload(year, tenants, base):
    out = {}
    for i, day in enumerate([dt.date(year, 1, 1), dt.date(year, 6, 30), dt.date(year, 12, 31)]):
        out[day.isoformat()] = [
            {"tenant": t, "total": base + 10 * i + k, "onboarded": base // 2 + i} for k, t in enumerate(tenants)
        ]
    return out


def test_partition_year_and_templates():
    assert SF.partition_year("s3://b/p/year=2024/snap.json") == 2024
    assert SF.partition_year("/x/year=20245/a") is None
    assert SF.partition_year("/x/y/a.json") is None
    paths = SF.build_input_paths({"a": "/r/a/year={year}/s.json"}, [2023, 2024])
    assert paths == {"a": ["/r/a/year=2023/s.json", "/r/a/year=2024/s.json"]}
    with pytest.raises(ValueError):
        SF.build_input_paths({"a": "/r/a/s.json"}, [2024])


def test_target_years():
    assert SF.target_years(None, 2026, 2024) == ([2024, 2025, 2026], True)
    assert SF.target_years(dt.date(2026, 3, 1), 2026, 2024) == ([2026], False)


def test_gzip_with_and_without_suffix(spark, scratch):
    p1 = f"{scratch}/a/year=2024/snap.json.gz"
    p2 = f"{scratch}/b/year=2024/snap.json"
    p3 = f"{scratch}/c/year=2024/snap.json"
    _write(p1, _year_payload(2024, ["t1"], 10), gz=True)
    _write(p2, _year_payload(2024, ["t2"], 20), gz=True)  # gzip bytes, no suffix
    _write(p3, _year_payload(2024, ["t3"], 30))
    texts = SF.read_texts(spark, {"a": [p1], "b": [p2], "c": [p3]})
    rows = SF.flatten(texts)
    good = S.require_valid(S.validate_rows(rows))
    got = sorted((r["tenant"], r["pods"]) for r in good.collect())
    assert got == [("t1", 10), ("t1", 20), ("t1", 30), ("t2", 20), ("t2", 30), ("t2", 40), ("t3", 30), ("t3", 40), ("t3", 50)]


def test_every_bad_row_reason(spark, scratch):
    payload = {
        "not-a-date": [{"tenant": "a", "total": 1, "onboarded": 0}],
        "2024-01-02": {"tenant": "a"},
        "2024-01-03": [5],
        "2024-01-04": [{"total": 1, "onboarded": 0}],
        "2024-01-05": [{"tenant": "b", "onboarded": 0}],
        "2024-01-06": [{"tenant": "c", "total": None, "pods": 3, "onboarded": 0}],
        "2024-01-07": [{"tenant": "d", "total": 3}],
        "2024-01-08": [{"tenant": "e", "total": "abc", "onboarded": 0}],
        "2024-01-09": [{"tenant": "f", "total": -1, "onboarded": 0}],
        "2024-01-10": [{"tenant": "g", "total": 1.5, "onboarded": 0}],
        "2023-12-31": [{"tenant": "h", "total": 1, "onboarded": 0}],
        "2024-01-11": [{"tenant": "  ok  ", "pods": "7", "onboarded": 9}],
    }
    p = f"{scratch}/s/year=2024/snap.json"
    _write(p, payload)
    v = S.validate_rows(SF.flatten(SF.read_texts(spark, {"s": [p]})))
    reasons = {r["reason"] for r in v.collect()}
    assert reasons == {
        "bad_date", "not_a_list", "not_an_object", "no_tenant", "no_total", "no_onboarded",
        "total_not_numeric", "total_negative", "total_not_whole", "year_mismatch", None,
    }
    ok = v.where(F.col("reason").isNull()).collect()
    assert [(r["tenant"], r["pods"], r["onboarded"]) for r in ok] == [("ok", 7, 7)]
    with pytest.raises(ValueError, match="invalid snapshot rows"):
        S.require_valid(v)


def test_top_level_must_be_object(spark, scratch):
    p = f"{scratch}/s/year=2024/snap.json"
    _write(p, None, raw=b"[1, 2]")
    rows = SF.flatten(SF.read_texts(spark, {"s": [p]}))
    assert rows.where(~F.col("top_is_object")).count() == 1


def test_normalize_and_checks(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-05T23:30:00-05:00", " a\t", "src", "10", "12"),
            ("20240107", "b", "src", "1e1", "3"),
            ("bad", "c", "src", "1", "1"),
            ("2024-01-07", "  ", "src", "1", "1"),
            ("2024-01-07", "d", "src", None, "1"),
            ("5 Jan 2024", "e", "src", "2", "1"),
            ("01/02/2024", "f", "src", "3", "1"),
            ("2024/1/9", "g", "src", "4", "1"),
        ],
        "date string, tenant string, source_backend string, pods string, onboarded string",
    )
    got = sorted(tuple(r) for r in S.normalize_snapshots(raw).collect())
    assert got == [
        (dt.date(2024, 1, 2), "f", "src", 3, 1),
        (dt.date(2024, 1, 5), "e", "src", 2, 1),
        (dt.date(2024, 1, 6), "a", "src", 10, 10),
        (dt.date(2024, 1, 7), "b", "src", 10, 3),
        (dt.date(2024, 1, 9), "g", "src", 4, 1),
    ]
    dup = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "a", "x", 1, 1), (dt.date(2024, 1, 1), "a", "y", 1, 1)],
        "date date, tenant string, source_backend string, pods long, onboarded long",
    )
    assert S.snapshot_conflicts(dup).count() == 0
    with pytest.raises(ValueError, match="several snapshots"):
        S.check_unique(dup)
    conflict = dup.union(spark.createDataFrame([(dt.date(2024, 1, 1), "a", "z", 2, 1)], dup.schema))
    with pytest.raises(ValueError, match="different values"):
        S.check_unique(conflict)


def test_bootstrap_then_refresh(spark, scratch):
    root = f"{scratch}/land"
    templates = {src: f"{root}/{src}/year={{year}}/snap.json" for src in ("s1", "s2", "s3")}
    # s1 starts a year late (leading year skipped in bootstrap); s3 is gzip without suffix.
    for year in (2024, 2025):
        _write(templates["s2"].format(year=year), _year_payload(year, ["b"], 100 * (year - 2023)))
        _write(templates["s3"].format(year=year), _year_payload(year, ["c"], 50 * (year - 2023)), gz=True)
    _write(templates["s1"].format(year=2025), _year_payload(2025, ["a"], 7))
    base = f"{scratch}/trends"
    out = snapshot_refresh(spark, templates, base, current_year=2025, bootstrap_year=2024)
    assert out["mode"] == "bootstrap"
    assert out["files"] == {"s1": 1, "s2": 2, "s3": 2}
    daily = read_published(spark, base, "daily")
    b = sorted((r["date"], r["daily_delta"], r["total_pods"]) for r in daily.where("tenant = 'b'").collect())
    assert b[0] == (dt.date(2024, 1, 1), 100, 100)
    assert b[3] == (dt.date(2025, 1, 1), 80, 200)  # versus the previous row (2024-12-31: 120)

    # Refresh: 2025 changes; seeds come from 2024-12-31 / 2024-12-01.
    _write(templates["s2"].format(year=2025), _year_payload(2025, ["b"], 500))
    out2 = snapshot_refresh(spark, templates, base, current_year=2025, bootstrap_year=2024)
    assert out2["mode"] == "refresh"
    daily2 = read_published(spark, base, "daily")
    assert out2["version"] > out["version"]
    b2 = sorted((r["date"], r["daily_delta"], r["total_pods"]) for r in daily2.where("tenant = 'b'").collect())
    assert b2[3] == (dt.date(2025, 1, 1), 380, 500)
    assert b2[:3] == b[:3]
    # Tenant a has no seed at 2024-12-31: its first delta is its whole total.
    a = sorted((r["date"], r["daily_delta"]) for r in daily2.where("tenant = 'a'").collect())
    assert a[0] == (dt.date(2025, 1, 1), 7)
    # Sum of deltas equals the last value per tenant (bootstrap history is complete).
    for t in ("b", "c"):
        rows = daily2.where(F.col("tenant") == t).orderBy("date").collect()
        assert sum(r["daily_delta"] for r in rows) == rows[-1]["total_pods"]


def test_gap_fails(spark, scratch):
    root = f"{scratch}/land"
    templates = {"s": f"{root}/s/year={{year}}/snap.json"}
    _write(templates["s"].format(year=2023), _year_payload(2023, ["a"], 1))
    _write(templates["s"].format(year=2025), _year_payload(2025, ["a"], 1))
    with pytest.raises(FileNotFoundError, match="year=2024"):
        snapshot_refresh(spark, templates, f"{scratch}/d", current_year=2025, bootstrap_year=2022)
    assert read_published(spark, f"{scratch}/d", "daily") is None


def test_duplicate_date_key_last_wins(spark, scratch):
    p = f"{scratch}/s/year=2024/snap.json"
    raw = (
        b'{"2024-01-01": [{"tenant": "a", "total": 1, "onboarded": 0}],'
        b' "2024-01-01": [{"tenant": "a", "total": 2, "onboarded": 1}]}'
    )
    _write(p, None, raw=raw)
    good = S.require_valid(S.validate_rows(SF.flatten(SF.read_texts(spark, {"s": [p]}))))
    assert [(r["tenant"], r["pods"], r["onboarded"]) for r in good.collect()] == [("a", 2, 1)]


def test_refresh_with_only_a_monthly_table(spark, scratch):
    from ledgerlens.sinks.tables import publish_tables

    templates = {"s": f"{scratch}/land/s/year={{year}}/snap.json"}
    _write(templates["s"].format(year=2025), _year_payload(2025, ["a"], 10))
    monthly = spark.createDataFrame(
        [(dt.date(2024, 12, 1), "a", "s", 4, 4, 1, 1)],
        "month_start date, tenant string, source_backend string, monthly_delta bigint, total_pods bigint, "
        "monthly_onboarded_delta bigint, onboarded_pods bigint",
    )
    publish_tables({"monthly": monthly}, f"{scratch}/t")
    out = snapshot_refresh(spark, templates, f"{scratch}/t", 2025, 2024)
    assert out["mode"] == "refresh"
    daily = read_published(spark, f"{scratch}/t", "daily").orderBy("date").collect()
    assert [(r["date"], r["daily_delta"]) for r in daily][0] == (dt.date(2025, 1, 1), 10)  # no daily seed
    m = read_published(spark, f"{scratch}/t", "monthly").orderBy("month_start").collect()
    assert [(r["month_start"], r["monthly_delta"]) for r in m][:2] == [(dt.date(2024, 12, 1), 4), (dt.date(2025, 1, 1), 6)]


def _good(spark, path, raw):
    _write(path, None, raw=raw)
    return S.require_valid(S.validate_rows(SF.flatten(SF.read_texts(spark, {"s": [path]})))).collect()


def test_an_empty_object_has_no_rows(spark, scratch):
    assert _good(spark, f"{scratch}/s/year=2024/a.json", b"{}") == []
    assert _good(spark, f"{scratch}/s/year=2024/b.json", b'{"2024-01-01": []}') == []


def test_a_null_in_a_list_is_rejected(spark, scratch):
    p = f"{scratch}/s/year=2024/snap.json"
    _write(p, None, raw=b'{"2024-01-01": [null, {"tenant": "a", "total": 1, "onboarded": 0}]}')
    v = S.validate_rows(SF.flatten(SF.read_texts(spark, {"s": [p]}))).collect()
    assert sorted(str(r["reason"]) for r in v) == ["None", "not_an_object"]


def test_a_doubled_key_in_a_row_takes_the_last_value(spark, scratch):
    got = _good(spark, f"{scratch}/s/year=2024/snap.json", b'{"2024-01-01": [{"tenant": "a", "total": 1, "onboarded": 0, "total": 5}]}')
    assert [(r["tenant"], r["pods"]) for r in got] == [("a", 5)]


def test_large_counters_stay_exact(spark, scratch):
    n = 2**53 + 1
    got = _good(spark, f"{scratch}/s/year=2024/snap.json", b'{"2024-01-01": [{"tenant": "a", "total": %d, "onboarded": "%d"}, {"tenant": "b", "total": 1e3, "onboarded": 2.0}]}' % (n, n))
    assert sorted((r["tenant"], r["pods"], r["onboarded"]) for r in got) == [("a", n, n), ("b", 1000, 2)]
    raw = spark.createDataFrame([("2024-01-01", "a", "s", str(n), str(n)), ("2024-01-01", "b", "s", "7.9", "3")], "date string, tenant string, source_backend string, pods string, onboarded string")
    assert sorted((r["tenant"], r["pods"]) for r in S.normalize_snapshots(raw).collect()) == [("a", n), ("b", 7)]


def test_a_load_without_rows_leaves_the_tables(spark, scratch):
    templates = {"s": f"{scratch}/land/s/year={{year}}/snap.json"}
    _write(templates["s"].format(year=2024), _year_payload(2024, ["a"], 1))
    first = snapshot_refresh(spark, templates, f"{scratch}/t", 2024, 2024)
    before = read_published(spark, f"{scratch}/t", "daily").count()
    _write(templates["s"].format(year=2024), None, raw=b'{"2024-01-01": []}')
    again = snapshot_refresh(spark, templates, f"{scratch}/t", 2024, 2024)
    assert first["version"] == 1 and again["version"] is None and again["mode"] == "refresh"
    assert read_published(spark, f"{scratch}/t", "daily").count() == before > 0
