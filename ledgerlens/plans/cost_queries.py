"""Registered cost queries: each reads the stand-in tables and runs a job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import py_shift_month_start
from ..operators import costs as C
from ..plans.jobs import cost_report_for_period, wide_cost_report
from ..sinks.tables import merge_latest
from ..sources import fixtures as fx

# Report anchors of the checked queries (FIXTURES.md).
ANCHOR = "2000-03-31"  # previous month is a leap February
FULL_MONTH = "2000-03-01"
PER_ACCOUNT_MONTH = "2001-03-01"
SCALE = fx.MONEY_SCALE
# Incremental load scenario (FIXTURES.md).
LOAD_TODAY = "2001-08-01"
LOADED_BEFORE = "2001-07-01"
NOT_YET_LOADED = "MACHINERY"  # an account with nothing loaded: 12-month backfill
#: The exported report: an account and its services (labels of the stand-in).
WIDE_ACCOUNT = "HOUSEHOLD"
WIDE_SERVICES = ("Urgent", "High", "Tax", "5-LOW")
UPSERT_FROM_1 = "2001-06-15"
UPSERT_FROM_2 = "2001-07-15"


def labeled_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``costs`` view: facts with NULL-key slices, services labelled."""
    return C.label_services(fx.cost_fact_with_nulls(spark, sf_dir), fx.fixture_service_map(spark))


def q_daily_cost_rollup(spark, sf_dir):
    return C.daily_cost_rollup(fx.cost_lines(spark, sf_dir), SCALE)


def q_linked_account_exclusion(spark, sf_dir):
    lines = C.exclude_linked_accounts(
        fx.cost_lines(spark, sf_dir), fx.linked_account_exclusions(spark, sf_dir)
    )
    return C.daily_cost_rollup(lines, SCALE)


def q_service_label(spark, sf_dir):
    return labeled_costs(spark, sf_dir)


def q_tax_filter(spark, sf_dir):
    return C.tax_filter(labeled_costs(spark, sf_dir), include_tax=False)


def q_table_projection(spark, sf_dir):
    return C.table_projection(fx.cost_fact(spark, sf_dir), ["date", "account", "amount"])


def q_period_metrics_mtd(spark, sf_dir):
    return C.period_metrics(labeled_costs(spark, sf_dir), ANCHOR, money_scale=SCALE)


def q_period_metrics_full(spark, sf_dir):
    return C.period_metrics_for_month(labeled_costs(spark, sf_dir), FULL_MONTH, money_scale=SCALE)


def q_period_metrics_latest(spark, sf_dir):
    return C.period_metrics(labeled_costs(spark, sf_dir), None, money_scale=SCALE)


def q_period_metrics_per_account(spark, sf_dir):
    costs = labeled_costs(spark, sf_dir)
    lo = dt.date.fromisoformat(PER_ACCOUNT_MONTH)
    hi = py_shift_month_start(lo, 1) - dt.timedelta(days=1)
    anchors = C.month_anchors(costs, ordered=False, lo=lo, hi=hi).select("account", "anchor_date")
    return C.period_metrics_for_anchors(costs, anchors, money_scale=SCALE)


def q_period_metrics_all_anchors(spark, sf_dir):
    """Month-to-date metrics for every (account, month anchor) in one job:
    every period option of every account at once."""
    costs = labeled_costs(spark, sf_dir)
    return C.period_metrics_for_anchors(costs, C.month_anchors(costs, ordered=False), money_scale=SCALE)


def q_period_metrics_all_months(spark, sf_dir):
    """Whole-month metrics for every (account, month) in one job."""
    costs = labeled_costs(spark, sf_dir)
    months = C.month_anchors(costs, ordered=False).select("account", "month_start")
    return C.period_metrics_for_anchors(costs, months, full_month=True, money_scale=SCALE)


def q_month_anchors(spark, sf_dir):
    return C.month_anchors(labeled_costs(spark, sf_dir))


def q_latest_loaded(spark, sf_dir):
    return C.latest_loaded(fx.cost_fact_with_nulls(spark, sf_dir))


def q_period_options(spark, sf_dir):
    return C.period_options(C.month_anchors(labeled_costs(spark, sf_dir), ordered=False))


def _mtd_no_tax(spark, sf_dir):
    """Per-account report input: month-to-date metrics of the listed
    (non-NULL) accounts, tax left out."""
    metrics = C.period_metrics(labeled_costs(spark, sf_dir), ANCHOR, money_scale=SCALE, ordered=False)
    return C.report_accounts(C.tax_filter(metrics, include_tax=False))


def q_service_totals(spark, sf_dir):
    return C.service_totals(_mtd_no_tax(spark, sf_dir), money_scale=SCALE)


def q_day_level_totals(spark, sf_dir):
    return C.service_totals(fx.day_level_costs(spark, sf_dir, ANCHOR), money_scale=SCALE)


def q_service_order(spark, sf_dir):
    return C.service_order(_mtd_no_tax(spark, sf_dir)).select("account", "service", "mtd", "rank")


def q_service_report(spark, sf_dir):
    return C.service_report(_mtd_no_tax(spark, sf_dir), money_scale=SCALE)


def q_distinct_accounts(spark, sf_dir):
    return C.accounts(labeled_costs(spark, sf_dir))


def _existing_costs(spark, sf_dir):
    f = fx.cost_fact(spark, sf_dir)
    return f.where((F.col("date") < F.lit(LOADED_BEFORE)) & (F.col("account") != NOT_YET_LOADED))


def q_incremental_window(spark, sf_dir):
    """Rows an incremental run loads: per-account windows from the loaded
    table, applied to the source facts in one join."""
    source = fx.cost_fact(spark, sf_dir)
    accounts = fx.cost_lines(spark, sf_dir).select("account")
    windows = C.load_windows(_existing_costs(spark, sf_dir), accounts, LOAD_TODAY)
    return C.select_load_window(source, windows)


def _upserted(spark, sf_dir):
    f = fx.cost_fact_with_nulls(spark, sf_dir)
    existing = f.where(F.col("date") < F.lit(LOADED_BEFORE))
    b1 = f.where(F.col("date") >= F.lit(UPSERT_FROM_1)).withColumn("amount", F.col("amount") * 2)
    b2 = f.where(F.col("date") >= F.lit(UPSERT_FROM_2)).withColumn("amount", F.col("amount") + 1)
    return merge_latest(existing, [b1, b2], ("date", "account", "service"))


def q_cost_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)


def q_load_summary(spark, sf_dir):
    return C.load_summary(_upserted(spark, sf_dir))


def q_loaded_totals(spark, sf_dir):
    return C.loaded_totals(q_incremental_window(spark, sf_dir), SCALE)


def q_safe_ratio(spark, sf_dir):
    return C.service_share(labeled_costs(spark, sf_dir), "Tax", "Urgent", SCALE)


def q_month_shift(spark, sf_dir):
    return C.month_shift(fx.cost_fact(spark, sf_dir))


def q_report_text(spark, sf_dir):
    r = q_service_report(spark, sf_dir)
    return r.select(
        "account",
        "service",
        "metric",
        X.cost_cell_text("value", "pct").alias("cell_text"),
        X.cost_pct_class("pct").alias("pct_class"),
    )


def q_period_labels(spark, sf_dir):
    opts = C.period_options(C.month_anchors(labeled_costs(spark, sf_dir), ordered=False))
    return opts.select(
        "account", "option", X.period_label("option").alias("period_label"), *X.row_label_columns("month_start")
    )


def q_report_for_past_month(spark, sf_dir):
    """The report of an earlier month with the dashboard's defaults (whole
    month, tax shown), for the accounts of the current view, with labels."""
    return cost_report_for_period(labeled_costs(spark, sf_dir), f"month:{FULL_MONTH}", money_scale=SCALE)


def q_report_current(spark, sf_dir):
    """The current view's defaults: month-to-date at the latest date, tax left out."""
    return cost_report_for_period(labeled_costs(spark, sf_dir), money_scale=SCALE)


def q_report_current_whole_month(spark, sf_dir):
    """The current view on whole months: each account's latest month."""
    return cost_report_for_period(labeled_costs(spark, sf_dir), mtd=False, money_scale=SCALE)


def q_report_past_month_mtd(spark, sf_dir):
    """An earlier month, month-to-date: each account's own anchor in it."""
    return cost_report_for_period(labeled_costs(spark, sf_dir), f"month:{FULL_MONTH}", mtd=True, money_scale=SCALE)


def q_cost_report_wide(spark, sf_dir):
    """One account's report of an earlier month as it is exported."""
    return wide_cost_report(q_report_for_past_month(spark, sf_dir), WIDE_ACCOUNT, WIDE_SERVICES)


def q_collapse_duplicate_services(spark, sf_dir):
    """Per account and service the first known value of each metric, over two partial readings."""
    metrics = _mtd_no_tax(spark, sf_dir).select("account", "service", "mtd", "avg12")
    one = metrics.withColumn("avg12", F.lit(None).cast("double"))
    two = metrics.withColumn("mtd", F.lit(None).cast("double"))
    return C.collapse_duplicate_services(one.unionByName(two))


QUERIES = {
    "cost_report_wide": q_cost_report_wide,
    "report_current": q_report_current,
    "report_current_whole_month": q_report_current_whole_month,
    "report_past_month_mtd": q_report_past_month_mtd,
    "collapse_duplicate_services": q_collapse_duplicate_services,
    "report_for_past_month": q_report_for_past_month,
    "distinct_accounts": q_distinct_accounts,
    "incremental_window": q_incremental_window,
    "cost_upsert": q_cost_upsert,
    "load_summary": q_load_summary,
    "loaded_totals": q_loaded_totals,
    "safe_ratio": q_safe_ratio,
    "month_shift": q_month_shift,
    "report_text": q_report_text,
    "period_labels": q_period_labels,
    "daily_cost_rollup": q_daily_cost_rollup,
    "linked_account_exclusion": q_linked_account_exclusion,
    "service_label": q_service_label,
    "tax_filter": q_tax_filter,
    "table_projection": q_table_projection,
    "period_metrics_mtd": q_period_metrics_mtd,
    "period_metrics_full": q_period_metrics_full,
    "period_metrics_latest": q_period_metrics_latest,
    "period_metrics_per_account": q_period_metrics_per_account,
    "period_metrics_all_anchors": q_period_metrics_all_anchors,
    "period_metrics_all_months": q_period_metrics_all_months,
    "month_anchors": q_month_anchors,
    "latest_loaded": q_latest_loaded,
    "period_options": q_period_options,
    "service_totals": q_service_totals,
    "day_level_totals": q_day_level_totals,
    "service_order": q_service_order,
    "service_report": q_service_report,
}
