"""Registered snapshot and trend queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import snapshots as S
from ..operators import trends as T
from ..operators.asof import last_days_rows
from ..plans.jobs import pod_report, wide_pod_report
from ..sinks.tables import replace_range
from ..sources import fixtures as fx
from ..sources.snapshot_files import year_coverage

# Report dates of the checked queries (FIXTURES.md).
AS_OF = "2001-08-01"
REFRESH_YEAR = 2001
EVENTS_AS_OF = "2024-01-30"
MONTHS = 12
DAYS = 60
WINDOW_DAYS = 30
#: The wide report's columns: the tenants of the stand-in (the names in ``region``).
TENANTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
BOOTSTRAP_YEAR = 1994
LAST_EXPECTED_YEAR = 2002


def _snap(spark, sf_dir):
    return fx.region_snapshot(spark, sf_dir)


def daily_table(spark, sf_dir) -> DataFrame:
    return T.daily_rows(_snap(spark, sf_dir))


def monthly_table(spark, sf_dir) -> DataFrame:
    return T.monthly_rows(_snap(spark, sf_dir))


def _windows(spark, sf_dir):
    return T.report_windows(monthly_table(spark, sf_dir), daily_table(spark, sf_dir), AS_OF, MONTHS, DAYS)


def q_snapshot_normalize(spark, sf_dir):
    return S.normalize_snapshots(fx.dirty_snapshots(spark, sf_dir))


def q_snapshot_validate(spark, sf_dir):
    return S.validate_rows(fx.raw_snapshot_rows(spark, sf_dir))


def _two_readings(spark, sf_dir):
    return fx.region_snapshot(spark, sf_dir).unionByName(fx.lineitem_snapshot(spark, sf_dir))


def q_snapshot_conflicts(spark, sf_dir):
    return S.snapshot_conflicts(_two_readings(spark, sf_dir))


def q_snapshot_duplicates(spark, sf_dir):
    return S.snapshot_duplicates(_two_readings(spark, sf_dir))


def q_snapshot_load_summary(spark, sf_dir):
    return S.snapshot_load_summary(fx.snapshot(spark, sf_dir))


def q_leading_gap_check(spark, sf_dir):
    s = fx.snapshot(spark, sf_dir)
    found = s.select("source_backend", F.year("date").alias("year")).distinct()
    sources = [fx.SOURCE_EVEN, fx.SOURCE_ODD, fx.SOURCE_EVENTS]
    return year_coverage(spark, sources, range(BOOTSTRAP_YEAR, LAST_EXPECTED_YEAR + 1), found)


def q_daily_delta(spark, sf_dir):
    return daily_table(spark, sf_dir)


def q_month_end_snapshot(spark, sf_dir):
    return T.month_end_snapshots(_snap(spark, sf_dir))


def q_monthly_delta(spark, sf_dir):
    return monthly_table(spark, sf_dir)


def _seeds(spark, sf_dir):
    return T.seed_values(daily_table(spark, sf_dir), monthly_table(spark, sf_dir), REFRESH_YEAR)


def q_seed_values(spark, sf_dir):
    d, m = _seeds(spark, sf_dir)
    return d.select(F.lit("daily").alias("kind"), "*").unionByName(m.select(F.lit("monthly").alias("kind"), "*"))


def q_daily_delta_seeded(spark, sf_dir):
    d, _ = _seeds(spark, sf_dir)
    return T.daily_rows(T.year_rows(_snap(spark, sf_dir), REFRESH_YEAR), d)


def q_monthly_delta_seeded(spark, sf_dir):
    _, m = _seeds(spark, sf_dir)
    return T.monthly_rows(T.year_rows(_snap(spark, sf_dir), REFRESH_YEAR), m)


def q_replace_range(spark, sf_dir):
    import datetime as dt

    seeds, _ = _seeds(spark, sf_dir)
    new_rows = T.daily_rows(fx.changed_snapshot(spark, sf_dir, REFRESH_YEAR), seeds)
    return replace_range(
        daily_table(spark, sf_dir),
        new_rows,
        "date",
        dt.date(REFRESH_YEAR, 1, 1),
        dt.date(REFRESH_YEAR, 12, 31),
        key_cols=("date", "tenant"),
    )


def q_monthly_trend_window(spark, sf_dir):
    return T.monthly_trend_window(monthly_table(spark, sf_dir), AS_OF, MONTHS)


def q_daily_trend_window(spark, sf_dir):
    return T.daily_trend_window(daily_table(spark, sf_dir), AS_OF, DAYS)


def q_trend_matrix_total(spark, sf_dir):
    m, d = _windows(spark, sf_dir)
    return T.trend_matrix(m, d, "total", MONTHS)


def q_trend_matrix_onboarded(spark, sf_dir):
    m, d = _windows(spark, sf_dir)
    return T.trend_matrix(m, d, "onboarded", MONTHS)


def q_trend_totals(spark, sf_dir):
    return T.trend_totals(q_trend_matrix_total(spark, sf_dir))


def q_trend_pivot(spark, sf_dir):
    return T.trend_pivot(q_trend_matrix_total(spark, sf_dir), TENANTS)


def q_pod_report_wide(spark, sf_dir):
    matrix, totals, last = pod_report(monthly_table(spark, sf_dir), daily_table(spark, sf_dir), AS_OF)
    return wide_pod_report(matrix, totals, last, TENANTS)


def q_last_30_days(spark, sf_dir):
    m, d = _windows(spark, sf_dir)
    return T.last_days_row(d, T.report_tenants(m, d, "total"), "total", WINDOW_DAYS)


def q_last_30_days_total(spark, sf_dir):
    return T.last_days_total(q_last_30_days(spark, sf_dir))


def q_last_30_days_events(spark, sf_dir):
    """30-day row on the events source: its history is shorter than the
    window, so every baseline is empty and counts as 0."""
    snap = fx.events_snapshot(spark, sf_dir)
    d = T.daily_trend_window(T.daily_rows(snap), EVENTS_AS_OF, DAYS, ordered=False)
    m = T.monthly_trend_window(T.monthly_rows(snap), EVENTS_AS_OF, MONTHS, ordered=False)
    return T.last_days_row(d, T.report_tenants(m, d, "onboarded"), "onboarded", WINDOW_DAYS)


def q_onboarded_share(spark, sf_dir):
    return T.onboarded_share(q_trend_matrix_onboarded(spark, sf_dir))


def q_latest_monthly_rows(spark, sf_dir):
    return T.latest_rows(monthly_table(spark, sf_dir), "month_start", 20)


def q_latest_daily_rows(spark, sf_dir):
    return T.latest_rows(daily_table(spark, sf_dir), "date", 20)


def q_tenant_order(spark, sf_dir):
    m, d = _windows(spark, sf_dir)
    last = T.last_days_row(d, T.report_tenants(m, d, "total"), "total", WINDOW_DAYS)
    return T.tenant_order(T.trend_matrix(m, d, "total", MONTHS), last)


def q_last_30_days_every_day(spark, sf_dir):
    """The 30-day row as of every day at once."""
    return last_days_rows(daily_table(spark, sf_dir), "total_pods", WINDOW_DAYS, DAYS)


def q_distinct_keys(spark, sf_dir):
    m, d = _windows(spark, sf_dir)
    return T.report_tenants(m, d, "total").orderBy("tenant")


def q_trend_class(spark, sf_dir):
    m = q_trend_matrix_total(spark, sf_dir)
    return m.select("month_start", "tenant", X.trend_class("delta", "pct").alias("trend_class"))


def q_pod_report_text(spark, sf_dir):
    m = q_trend_matrix_onboarded(spark, sf_dir)
    return m.select(
        "month_start",
        "tenant",
        X.format_count_it("value").alias("value_text"),
        X.format_count_it("delta", sign=True).alias("delta_text"),
        X.pct_text("pct").alias("pct_text"),
        X.share_pct_text("value", "reference_value").alias("share_text"),
        X.share_class("value", "reference_value").alias("share_class"),
    )


QUERIES = {
    "trend_class": q_trend_class,
    "pod_report_text": q_pod_report_text,
    "snapshot_normalize": q_snapshot_normalize,
    "snapshot_validate": q_snapshot_validate,
    "snapshot_conflicts": q_snapshot_conflicts,
    "snapshot_duplicates": q_snapshot_duplicates,
    "snapshot_load_summary": q_snapshot_load_summary,
    "leading_gap_check": q_leading_gap_check,
    "daily_delta": q_daily_delta,
    "month_end_snapshot": q_month_end_snapshot,
    "monthly_delta": q_monthly_delta,
    "seed_values": q_seed_values,
    "daily_delta_seeded": q_daily_delta_seeded,
    "monthly_delta_seeded": q_monthly_delta_seeded,
    "replace_range": q_replace_range,
    "monthly_trend_window": q_monthly_trend_window,
    "daily_trend_window": q_daily_trend_window,
    "trend_matrix_total": q_trend_matrix_total,
    "trend_matrix_onboarded": q_trend_matrix_onboarded,
    "trend_totals": q_trend_totals,
    "trend_pivot": q_trend_pivot,
    "pod_report_wide": q_pod_report_wide,
    "last_30_days": q_last_30_days,
    "last_30_days_total": q_last_30_days_total,
    "last_30_days_events": q_last_30_days_events,
    "onboarded_share": q_onboarded_share,
    "latest_monthly_rows": q_latest_monthly_rows,
    "latest_daily_rows": q_latest_daily_rows,
    "tenant_order": q_tenant_order,
    "last_30_days_every_day": q_last_30_days_every_day,
    "distinct_keys": q_distinct_keys,
}
