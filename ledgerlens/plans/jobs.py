"""End-to-end jobs: the daily cost load, the snapshot load, and the two
reports. Each composes the operators; writes go through the sinks."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import py_shift_month_start
from ..operators import costs as C
from ..operators import prefixes as P
from ..operators import snapshots as S
from ..operators import trends as T
from ..sinks import versions
from ..sinks.tables import latest_published, publish_export, publish_tables, read_derived, read_published, read_upserted, replace_range, stored_summary, upsert_table
from ..sources import snapshot_files as SF
from ..sources import snapshot_stream as ST


#: The derived table of a cost table that holds its month prefixes.
PREFIXES = "prefixes"

DAILY_SCHEMA = (
    "date date, tenant string, source_backend string, daily_delta bigint, total_pods bigint, "
    "daily_onboarded_delta bigint, onboarded_pods bigint"
)
MONTHLY_SCHEMA = (
    "month_start date, tenant string, source_backend string, monthly_delta bigint, total_pods bigint, "
    "monthly_onboarded_delta bigint, onboarded_pods bigint"
)


def cost_refresh(
    spark: SparkSession,
    source_lines: DataFrame,
    table_path: str,
    accounts: Iterable[str] | DataFrame,
    today: dt.date | str,
    backfill_months: int = 12,
    exclusions: DataFrame | None = None,
    money_scale: int | None = None,
) -> DataFrame:
    """Daily cost load: per-account windows from the loaded table, the
    source cut to them in one join, linked-account exclusions, the daily
    rollup, and a keyed upsert of the touched months (staged, then made
    visible by one pointer). Returns the load summary (rows, first and last
    day of the table)."""
    existing = read_upserted(spark, table_path)
    if existing is None:
        existing = spark.createDataFrame([], "date date, account string, service string, amount double")
    windows = C.load_windows(existing, accounts, today, backfill_months)
    lines = C.select_load_window(source_lines, windows)
    if exclusions is not None:
        lines = C.exclude_linked_accounts(lines, exclusions)
    facts = C.daily_cost_rollup(lines, money_scale)
    upsert_costs(spark, table_path, [facts], money_scale)
    loaded = stored_summary(spark, table_path)
    return C.load_summary(existing) if loaded is None else loaded


def upsert_costs(spark: SparkSession, table_path: str, batches: Sequence[DataFrame], money_scale: int | None = None, seq_col: str | None = None) -> DataFrame:
    """Upsert cost facts with their month prefixes, which move with the same pointer."""
    derived = {PREFIXES: lambda rows: P.month_prefixes(rows, money_scale)}
    return upsert_table(spark, table_path, batches, C.FACT_KEYS, C.PARTITION_COLUMN, seq_col=seq_col, derived=derived)


def read_prefixes(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The month prefixes of a cost table: what reports read in place of its facts."""
    return read_derived(spark, table_path, PREFIXES)


def snapshot_refresh(
    spark: SparkSession,
    templates: Mapping[str, str],
    base: str,
    current_year: int,
    bootstrap_year: int,
) -> dict:
    """Snapshot load. Bootstrap (nothing loaded): every year from the
    bootstrap year, missing leading years skipped, tables replaced. Refresh:
    the current year only, seeds from the year before, that year replaced.
    Both tables (``daily`` and ``monthly`` under ``base``) are published by one
    pointer; a failure leaves both untouched. So do files without any row:
    then nothing is published."""
    seen = versions.latest(spark, base)  # both tables are read from it, and the result goes on top of it
    daily_old = read_published(spark, base, "daily", seen)
    monthly_old = read_published(spark, base, "monthly", seen)
    latest = latest_published(spark, base, "daily", "date", seen)
    if latest is None:
        latest = latest_published(spark, base, "monthly", "month_start", seen)
    years, bootstrap = SF.target_years(latest, current_year, bootstrap_year)
    paths = SF.build_input_paths(templates, years)

    at = {source: list(zip(years, ps, strict=True)) for source, ps in paths.items()}
    found = ST.discover(spark, at).where("found").select("source_backend", "year", "path").collect()
    present = {source: [r["path"] for r in sorted(found) if r["source_backend"] == source] for source in paths}
    found_rows = [(r["source_backend"], SF.partition_year(r["path"]) or r["year"]) for r in found]
    coverage = SF.year_coverage(spark, list(paths), years, spark.createDataFrame(found_rows, "source_backend string, year int"))
    bad = coverage.where(
        (F.col("status") == "gap") | ((F.col("status") == "skipped_leading") & F.lit(not bootstrap))
    ).first()
    if bad is not None:
        raise FileNotFoundError(f"snapshot file missing: source={bad['source_backend']} year={bad['year']}")

    # One job walks the files, checks their rows and keys, and writes them; it is
    # given up if a check fails, and the trend rows are worked out from what it wrote.
    staging = f"_staging/{uuid.uuid4().hex}"
    gate = S.LoadGate(list(paths))
    validated = gate.rows(S.validate_rows(gate.files(SF.rows_of_items(ST.read_items(spark, present)))))
    unique = S.one_per_key(S.normalize_snapshots(validated.where(F.col("reason").isNull())))
    try:
        gate.keys(unique).select(*S.SNAPSHOT_COLUMNS).write.parquet(f"{base}/{staging}")
        load = gate.check()
        mode = "bootstrap" if bootstrap else "refresh"
        out = {"mode": mode, "years": years, "files": {s: len(p) for s, p in present.items()}, "version": None} | load
        if load["min_date"] is None:
            return out
        snaps = spark.read.parquet(f"{base}/{staging}")
        if bootstrap:
            daily_new = T.daily_rows(snaps)
            monthly_new = T.monthly_rows(snaps)
        else:
            # A table never published counts as empty: no seeds, nothing to keep.
            if daily_old is None:
                daily_old = spark.createDataFrame([], DAILY_SCHEMA)
            if monthly_old is None:
                monthly_old = spark.createDataFrame([], MONTHLY_SCHEMA)
            d_seed, m_seed = T.seed_values(daily_old, monthly_old, current_year)
            # Every row read from the current year's files is written, even one
            # dated outside the replaced range (it then replaces by key).
            daily_new = replace_range(
                daily_old.select(*T.DAILY_COLUMNS), T.daily_rows(snaps, d_seed), "date",
                dt.date(current_year, 1, 1), dt.date(current_year, 12, 31), ("date", "tenant"),
            )
            monthly_new = replace_range(
                monthly_old.select(*T.MONTHLY_COLUMNS), T.monthly_rows(snaps, m_seed), "month_start",
                dt.date(current_year, 1, 1), dt.date(current_year, 12, 1), ("month_start", "tenant"),
            )
        stamp = F.current_timestamp().alias("updated_at")
        out["version"] = publish_tables(
            {"daily": daily_new.select(*T.DAILY_COLUMNS, stamp), "monthly": monthly_new.select(*T.MONTHLY_COLUMNS, stamp)}, base, seen
        )
        return out
    finally:
        versions.Folder(spark, base).remove(staging)


def cost_report(
    costs: DataFrame,
    anchor: dt.date | str | None = None,
    month: dt.date | str | None = None,
    include_tax: bool = False,
    money_scale: int | None = None,
) -> DataFrame:
    """Report matrix (long form, with cell text) per account: month-to-date
    at ``anchor`` (latest date if None), or whole months for ``month``."""
    metrics = (
        C.period_metrics_for_month(costs, month, money_scale, ordered=False)
        if month is not None
        else C.period_metrics(costs, anchor, money_scale, ordered=False)
    )
    report = C.service_report(C.tax_filter(metrics, include_tax), money_scale=money_scale)
    return report.withColumn("cell_text", X.cost_cell_text("value", "pct")).withColumn(
        "pct_class", X.cost_pct_class("pct")
    )


def pod_report(
    monthly: DataFrame, daily: DataFrame, as_of: dt.date | str, metric: str = "total", months: int = 12, days: int = 60
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix with text and classes, totals, 30-day row) for one metric."""
    mw, dw = T.report_windows(monthly, daily, as_of, months, days)
    matrix = T.trend_matrix(mw, dw, metric, months)
    tenants = T.report_tenants(mw, dw, metric)
    last = T.last_days_row(dw, tenants, metric)
    # The order reads total pods, on the rows this metric's view keeps.
    order = T.tenant_order(matrix, T.last_days_row(dw, tenants, "total", rows_of=metric))
    matrix = matrix.join(order.select("tenant", "rank"), "tenant", "left").select(
        "*",
        X.format_count_it("value").alias("value_text"),
        X.pct_text("pct").alias("pct_text"),
        X.trend_class("delta", "pct").alias("trend_class"),
    )
    return matrix, T.trend_totals(matrix), last


def wide_cost_report(report: DataFrame, account: str, services: Sequence[str]) -> DataFrame:
    """One account's report for export: a row per report line in its order,
    columns ``Metric`` (the line's label), ``Total`` and ``services`` (in the
    account's service order); a cell is its text, empty where a service has none.

    ``report`` comes from :func:`cost_report_for_period`.
    """
    rows = report.where(F.col("account") == F.lit(account)).groupBy("row_position", F.col("row_label").alias("Metric"))
    wide = rows.pivot("service", ["Total", *services]).agg(F.first("cell_text")).orderBy("row_position")
    return wide.select("Metric", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("Total", *services)])


def _csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\n\\r]'), quoted).otherwise(text), F.lit(""))


def cost_report_lines(report: DataFrame) -> DataFrame:
    """(account, row_position, line): every account's report as CSV lines, a header
    (position 0) and a line per report row, each with the account's own services
    in their order. ``report`` comes from :func:`cost_report_for_period`."""
    cell = F.struct("col_position", "service", "cell_text")
    rows = report.groupBy("account", "row_position", "row_label").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    values = F.transform("cells", lambda c: _csv_cell(c["cell_text"]))
    names = F.transform("cells", lambda c: _csv_cell(c["service"]))
    lines = F.array(
        F.when(F.col("row_position") == 1, F.struct(F.lit(0).cast("bigint").alias("p"), F.array_join(F.concat(F.array(F.lit("Metric")), names), ",").alias("line"))),
        F.struct(F.col("row_position").alias("p"), F.array_join(F.concat(F.array(_csv_cell(F.col("row_label"))), values), ",").alias("line")),
    )
    out = rows.select("account", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
    return out.select("account", F.col("l.p").alias("row_position"), "l.line")


def export_cost_reports(report: DataFrame, path: str) -> str:
    """Every account's report as a CSV file of its own (folder ``account=<name>``),
    written in one job and then named by the pointer (``sinks.tables.exported``).
    Returns the folder."""
    lines = cost_report_lines(report).repartition("account").sortWithinPartitions("account", "row_position")
    return publish_export(lines.select("account", "line").write.partitionBy("account").text, lines.sparkSession, path)


def wide_pod_report(matrix: DataFrame, totals: DataFrame, last_days: DataFrame, tenants: Sequence[str]) -> DataFrame:
    """The pod report for export: a row per month, newest first, then the
    30-day row; columns ``period`` (its month's first day, or ``last_days``),
    ``Total`` and ``tenants`` (in the report's order). Months hold values, the
    30-day row the change. Inputs are those :func:`pod_report` returns."""
    period = F.date_format("month_start", "yyyy-MM-dd").alias("period")
    long = (
        matrix.select(period, "tenant", "value")
        .unionByName(totals.select(period, F.lit("Total").alias("tenant"), "value"))
        .unionByName(last_days.select(F.lit("last_days").alias("period"), "tenant", F.col("delta").alias("value")))
        .unionByName(T.last_days_total(last_days).select(F.lit("last_days").alias("period"), F.lit("Total").alias("tenant"), F.col("delta").alias("value")))
    )
    wide = long.groupBy("period").pivot("tenant", ["Total", *tenants]).agg(F.first("value"))
    return wide.orderBy((F.col("period") == "last_days").asc(), F.col("period").desc())


def cost_report_for_period(
    costs: DataFrame,
    period: str = "current",
    mtd: bool | None = None,
    include_tax: bool | None = None,
    money_scale: int | None = None,
) -> DataFrame:
    """Report rows of every account for one period option, in one job.

    ``period`` is ``current`` or ``month:YYYY-MM-01`` (see
    :func:`~ledgerlens.operators.costs.period_options`). Defaults: month-to-date
    and tax left out for ``current``; whole months and tax shown for an
    earlier month.

    * current, month-to-date: the table-wide latest date as anchor;
    * current, whole month: each account's latest month;
    * earlier month, month-to-date: each account's own anchor in that month;
    * earlier month, whole month: that calendar month.

    Only accounts present in the current view get a report (as in the
    dashboard, whose account list comes from it). Each row carries the label
    of its report row, counted back from the account's period.
    """
    current = period == "current"
    mtd = current if mtd is None else mtd
    include_tax = (not current) if include_tax is None else include_tax
    # The current view lists the accounts with rows from the start of the
    # latest date's month up to that date (its month-to-date window).
    latest = C.latest_date(costs)
    first = latest.replace(day=1) if latest else None
    listed = C.accounts_between(costs, first, latest)
    if current:
        # A listed account's latest month is that month, so only it is read.
        own = C.month_anchors(costs, ordered=False, lo=first, hi=latest)
        if mtd:
            metrics = C.period_metrics(costs, latest, money_scale, ordered=False)
        else:
            metrics = C.period_metrics_for_anchors(
                costs, own.select("account", "month_start"), full_month=True, money_scale=money_scale, ordered=False
            ).drop("month_start")
    else:
        month = dt.date.fromisoformat(period.split(":", 1)[1][:10])
        own = C.month_anchors(costs, ordered=False, lo=month, hi=py_shift_month_start(month, 1) - dt.timedelta(days=1))
        if mtd:
            metrics = C.period_metrics_for_anchors(
                costs, own.select("account", "anchor_date"), money_scale=money_scale, ordered=False
            ).drop("anchor_date")
        else:
            metrics = C.period_metrics_for_month(costs, month, money_scale, ordered=False).join(
                own.select("account"), "account", "left_semi"
            )
    label_ref = own.select("account", F.col("anchor_date" if mtd else "month_start").alias("_ref"))
    metrics = metrics.join(listed, "account", "left_semi")
    report = C.service_report(C.tax_filter(metrics, include_tax), money_scale=money_scale)
    labels = label_ref.select("account", *X.row_label_columns("_ref"))
    label = F.coalesce(
        *[F.when(F.col("metric") == m, F.col(f"label_{m}")) for m, _ in X.ROW_LABELS]
    )
    return (
        report.join(labels, "account", "left")
        .select(
            *report.columns,
            label.alias("row_label"),
            X.cost_cell_text("value", "pct").alias("cell_text"),
            X.cost_pct_class("pct").alias("pct_class"),
        )
    )
