"""Cost facts: rollup, dimension labels, filters, anchors and period metrics.

Facts have the columns ``date, account, service, amount``. Every function
takes and returns DataFrames; the only driver actions are small lookups (the
table-wide latest date, an anchor frame's size and date bounds, the accounts
of a load without recent rows) whose results become literals so that
Parquet pruning reaches the fact scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_index, month_start, py_month_start, py_shift_month_start
from ..functions.ratio import money_value, safe_ratio, sum_money
from . import prefixes as P

FACT_KEYS = ("date", "account", "service")

# The period columns of a cost report and how deltas pair them.
MONTH_COLUMNS = ("mtd", "prev_mtd", "prev2_mtd", "prev3_mtd", "prev4_mtd", "prev5_mtd")
AVG_COLUMNS = (("avg6", 6), ("avg12", 12))
DELTA_PAIRS = (
    ("delta_prev", "pct_prev", "mtd", "prev_mtd"),
    ("delta_prev2", "pct_prev2", "prev_mtd", "prev2_mtd"),
    ("delta_prev3", "pct_prev3", "prev2_mtd", "prev3_mtd"),
    ("delta_prev4", "pct_prev4", "prev3_mtd", "prev4_mtd"),
    ("delta_prev5", "pct_prev5", "prev4_mtd", "prev5_mtd"),
    ("delta_avg6", "pct_avg6", "mtd", "avg6"),
    ("delta_avg12", "pct_avg12", "mtd", "avg12"),
)
HISTORY_MONTHS = 12
VALUE_COLUMNS = MONTH_COLUMNS + tuple(name for name, _ in AVG_COLUMNS)
METRIC_COLUMNS = (
    VALUE_COLUMNS
    + tuple(d for d, _, _, _ in DELTA_PAIRS)
    + tuple(p for _, p, _, _ in DELTA_PAIRS)
)


# Partition column of the stored cost table (first day of the date's month).
PARTITION_COLUMN = "month"


def date_range(df: DataFrame, lo: dt.date | None, hi: dt.date | None, hi_inclusive: bool = True) -> DataFrame:
    """Cut to ``lo <= date <= hi`` (or ``< hi``) with literal bounds.

    The bounds reach the Parquet scan as pushed filters; when the table is
    partitioned by month the same bounds also prune whole partitions.
    """
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("date") >= F.lit(lo))
    if hi is not None:
        cond = cond & ((F.col("date") <= F.lit(hi)) if hi_inclusive else (F.col("date") < F.lit(hi)))
    if PARTITION_COLUMN in df.columns:
        m = F.col(PARTITION_COLUMN)
        if lo is not None:
            cond = cond & (m >= F.lit(py_month_start(lo)))
        if hi is not None:
            last_day = hi if hi_inclusive else hi - dt.timedelta(days=1)
            cond = cond & (m <= F.lit(py_month_start(last_day)))
    return df.where(cond)


# --------------------------------------------------------------------------
# Rollup, exclusion, labels, filters
# --------------------------------------------------------------------------


def daily_cost_rollup(lines: DataFrame, money_scale: int | None = None) -> DataFrame:
    """Daily cost per (date, account, service) from raw cost lines.

    Partial aggregation runs map-side, so a hot key is collapsed in every
    task before the shuffle.
    """
    return lines.groupBy(*FACT_KEYS).agg(
        money_value(sum_money("amount", money_scale)).alias("amount")
    )


def exclude_linked_accounts(lines: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop lines of an account whose linked account is listed for it.

    ``exclusions`` has (account, linked_account). Lines with a NULL linked
    account never match and stay, as with a NOT filter on a dimension.
    """
    ex = exclusions.select(
        F.col("account").alias("_ex_account"), F.col("linked_account").alias("_ex_linked")
    ).distinct()
    cond = (F.col("account") == F.col("_ex_account")) & (
        F.col("linked_account") == F.col("_ex_linked")
    )
    return lines.join(ex, cond, "left_anti")


def label_services(facts: DataFrame, service_map: DataFrame) -> DataFrame:
    """Show the mapped label of a service, or the raw name when unmapped.

    The raw name is the dimension's key: a map that lists a raw name twice
    is reduced to one label first, so facts are never multiplied by the join:
    the one at the last ``position``, where the map has that column.
    """
    label = F.max_by("label", "position") if "position" in service_map.columns else F.max("label")
    dim = service_map.groupBy(F.col("raw").alias("_raw")).agg(label.alias("_label"))
    joined = facts.join(dim, facts["service"] == F.col("_raw"), "left")
    cols = [c for c in facts.columns]
    return joined.select(
        *[
            F.coalesce(F.col("_label"), facts["service"]).alias("service") if c == "service" else facts[c]
            for c in cols
        ]
    )


def tax_filter(df: DataFrame, include_tax: bool = False, tax_label: str = "Tax") -> DataFrame:
    """Drop the tax service unless tax mode is on; a NULL service is kept."""
    if include_tax:
        return df
    return df.where(~F.col("service").eqNullSafe(F.lit(tax_label)))


def table_projection(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Read with a column list; the list reaches the scan's ReadSchema."""
    if not columns:
        return df
    return df.select(*columns)


def incremental_window(df: DataFrame, start: dt.date | str, stop: dt.date | str) -> DataFrame:
    """Half-open date range ``[start, stop)``, pushed to the scan as literals."""
    return date_range(df, as_date(start), as_date(stop), hi_inclusive=False)


# --------------------------------------------------------------------------
# Latest dates and month anchors
# --------------------------------------------------------------------------


def latest_date(df: DataFrame, account: str | None = None) -> dt.date | None:
    """Table-wide (or one account's) latest date: one scalar action."""
    if account is not None:
        df = df.where(F.col("account") == F.lit(account))
    if PARTITION_COLUMN in df.columns:
        # Newest month first (partition values only), then one partition's dates.
        top = df.agg(F.max(PARTITION_COLUMN)).first()[0]
        if top is None:
            return None
        df = df.where(F.col(PARTITION_COLUMN) == F.lit(top))
    row = df.agg(F.max(P.last_day() if P.is_prefixes(df) else "date").alias("latest_date")).first()
    return None if row is None else row["latest_date"]


def latest_loaded(df: DataFrame) -> DataFrame:
    """Latest date and month per account."""
    day = F.max(P.last_day() if P.is_prefixes(df) else "date")
    return df.groupBy("account").agg(day.alias("latest_date"), month_start(day).alias("latest_month"))


def accounts_between(df: DataFrame, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    """Distinct accounts with a row on the days ``lo`` to ``hi``, no NULL among them."""
    if P.is_prefixes(df):
        rows = df if lo is None else df.where((F.col(P.MONTH) >= F.lit(py_month_start(lo))) & (P.last_day() >= F.lit(lo)))
        if hi is not None:
            last = F.col(P.MONTH) == F.lit(py_month_start(hi))
            rows = rows.where((F.col(P.MONTH) < F.lit(py_month_start(hi))) | (last & (F.get(P.ROWS, F.lit(hi.day - 1)) > 0)))
            first = F.col(P.MONTH) == F.lit(py_month_start(lo)) if lo is not None else F.lit(False)
            if lo is not None and lo.day > 1:  # in the first month there must be a row from lo on, and up to hi
                most = F.when(last, F.get(P.ROWS, F.lit(hi.day - 1))).otherwise(F.get(P.ROWS, F.lit(P.DAYS - 1)))
                rows = rows.where(~first | (most > F.get(P.ROWS, F.lit(lo.day - 2))))
    else:
        rows = date_range(df, lo, hi)
    return report_accounts(rows.select("account")).distinct()


def _months_between(prefixes: DataFrame, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    """Month rows between two days, which must be a month's first and last (the bounds reach the partitions)."""
    month = F.col(P.MONTH)
    if lo is not None:
        if lo.day != 1:
            raise ValueError(f"month prefixes hold whole months, not those from {lo}")
        prefixes = prefixes.where(month >= F.lit(lo))
    if hi is not None:
        prefixes = prefixes.where(month <= F.lit(py_month_start(hi)))
    return prefixes


def month_anchors(
    df: DataFrame, ordered: bool = True, lo: dt.date | None = None, hi: dt.date | None = None
) -> DataFrame:
    """Per account and month: the latest day with a row (the month's anchor),
    over the days ``lo`` to ``hi`` where given (they prune the scan).

    Rows with a NULL account, month or anchor are dropped. Ordered by
    account, then newest month first (``ordered=False`` when the rows feed
    another job, to spare a global sort).
    """
    if P.is_prefixes(df):
        days = _months_between(df, lo, hi).select("account", F.col(P.MONTH).alias("month_start"), P.last_day().alias("date"))
    else:
        days = date_range(df, lo, hi).select("account", month_start("date").alias("month_start"), "date")
    out = (
        days.where(F.col("date").isNotNull())
        .groupBy("account", "month_start")
        .agg(F.max("date").alias("anchor_date"))
        .where(F.col("account").isNotNull())
    )
    return out.orderBy(F.col("account").asc(), F.col("month_start").desc()) if ordered else out


def period_options(anchors: DataFrame) -> DataFrame:
    """Report periods per account: ``current``, then each month before the
    account's latest month, newest first, each with its anchor date."""
    w = Window.partitionBy("account")
    latest = anchors.withColumn("_latest", F.max("month_start").over(w))
    current = latest.where(F.col("month_start") == F.col("_latest")).select(
        "account",
        F.lit("current").alias("option"),
        F.col("month_start"),
        F.col("anchor_date"),
        F.lit(0).cast("bigint").alias("position"),
    )
    earlier = latest.where(F.col("month_start") < F.col("_latest"))
    rank = F.row_number().over(Window.partitionBy("account").orderBy(F.col("month_start").desc()))
    earlier = earlier.select(
        "account",
        F.concat(F.lit("month:"), F.date_format("month_start", "yyyy-MM-dd")).alias("option"),
        "month_start",
        "anchor_date",
        rank.cast("bigint").alias("position"),
    )
    return current.unionByName(earlier)


# --------------------------------------------------------------------------
# Period metrics
# --------------------------------------------------------------------------


def _q(name: str) -> str:
    return f"`{name}`"


def _sum_sql(expr: str, money_scale: int | None) -> str:
    """SQL text of :func:`sum_money` over ``expr``."""
    if money_scale is None:
        return f"sum(CAST({expr} AS DOUBLE))"
    return f"sum(CAST({expr} AS DECIMAL(28,{money_scale})))"


def _value_exprs() -> dict[str, str]:
    """SQL for the value columns from the 13 per-month sums ``_s0.._s12``.

    Earlier periods come from joins in the reference, where NULL keys never
    match: they are NULL for a group with a NULL account or service. The
    averages are the mean over the months that have rows only.
    """
    keys_ok = "(account IS NOT NULL AND service IS NOT NULL)"
    values = {"mtd": "CAST(_s0 AS DOUBLE)"}
    for i, name in enumerate(MONTH_COLUMNS[1:], start=1):
        values[name] = f"CASE WHEN {keys_ok} THEN CAST(_s{i} AS DOUBLE) END"
    for name, months in AVG_COLUMNS:
        total = " + ".join(f"coalesce(_s{i}, 0)" for i in range(1, months + 1))
        present = " + ".join(f"CAST(_s{i} IS NOT NULL AS INT)" for i in range(1, months + 1))
        values[name] = (
            f"CASE WHEN {keys_ok} AND ({present}) > 0 "
            f"THEN try_divide(CAST({total} AS DOUBLE), {present}) END"
        )
    return values


def _delta_exprs() -> list[str]:
    """``a - b AS delta`` and ``try_divide(a - b, b) AS pct`` for every pair."""
    out = []
    for d, _, a, b in DELTA_PAIRS:
        out.append(f"{a} - {b} AS {d}")
    for _, p, a, b in DELTA_PAIRS:
        out.append(f"try_divide({a} - {b}, {b}) AS {p}")
    return out


def _aggregate_periods(df: DataFrame, group_cols: Sequence[str], money_scale: int | None) -> DataFrame:
    """One aggregation: 13 conditional month sums per (group, account, service).

    ``df`` carries ``_k`` (months before the anchor month, 0..12) and rows
    already cut to the window. A group exists only if it has a row in the
    current period (k = 0), even when its amounts are NULL.
    """
    aggs = [F.expr("max(_k = 0)").alias("_has_current")]
    aggs += [
        F.expr(_sum_sql(f"CASE WHEN _k = {i} THEN amount END", money_scale)).alias(f"_s{i}")
        for i in range(HISTORY_MONTHS + 1)
    ]
    grouped = df.groupBy(*group_cols, "account", "service").agg(*aggs).where("_has_current")
    keys = [_q(c) for c in (*group_cols, "account", "service")]
    values = grouped.selectExpr(*keys, *[f"{e} AS {n}" for n, e in _value_exprs().items()])
    return values.selectExpr(*keys, *VALUE_COLUMNS, *_delta_exprs())


def _ordered_if(ordered: bool, df: DataFrame, lead: Sequence[str] = ()) -> DataFrame:
    """Sorted for a reader; rows that feed another job are left as they come."""
    return _order(df, lead) if ordered else df


def _order(df: DataFrame, lead: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in (*lead, "account", "service")])


def period_metrics(
    facts: DataFrame,
    anchor_date: dt.date | str | None = None,
    money_scale: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Month-to-date metrics at an anchor date (the table's latest date if None).

    Columns: account, service, mtd, prev_mtd..prev5_mtd (same days of the
    earlier months, capped at each month's end), avg6/avg12 (mean of capped
    month sums over the months with rows), deltas and ratios.
    """
    anchor = as_date(anchor_date) if anchor_date is not None else latest_date(facts)
    if anchor is None:
        none = P.upto_day(facts, F.lit(1)) if P.is_prefixes(facts) else facts
        return _aggregate_periods(none.withColumn("_k", F.lit(0)).limit(0), (), money_scale)
    m0 = py_month_start(anchor)
    lo = py_shift_month_start(m0, -HISTORY_MONTHS)
    if P.is_prefixes(facts):
        k = F.lit(m0.year * 12 + m0.month - 1) - month_index(P.MONTH)
        window = P.upto_day(_months_between(facts, lo, m0), F.lit(anchor.day)).withColumn("_k", k)
        return _ordered_if(ordered, _aggregate_periods(window, (), money_scale))
    k = F.lit(m0.year * 12 + m0.month - 1) - month_index("date")
    window = (
        date_range(facts, lo, anchor)
        .withColumn("_k", k)
        .where((F.col("_k") == 0) | (F.dayofmonth("date") <= F.lit(anchor.day)))
    )
    return _ordered_if(ordered, _aggregate_periods(window, (), money_scale))


def period_metrics_for_month(
    facts: DataFrame, month: dt.date | str, money_scale: int | None = None, ordered: bool = True
) -> DataFrame:
    """Metrics on whole calendar months for the month starting at ``month``."""
    m0 = py_month_start(as_date(month))
    lo = py_shift_month_start(m0, -HISTORY_MONTHS)
    hi = py_shift_month_start(m0, 1)
    if P.is_prefixes(facts):
        k = F.lit(m0.year * 12 + m0.month - 1) - month_index(P.MONTH)
        window = P.upto_day(_months_between(facts, lo, m0), F.lit(P.DAYS)).withColumn("_k", k)
        return _ordered_if(ordered, _aggregate_periods(window, (), money_scale))
    k = F.lit(m0.year * 12 + m0.month - 1) - month_index("date")
    window = date_range(facts, lo, hi, hi_inclusive=False).withColumn("_k", k)
    return _ordered_if(ordered, _aggregate_periods(window, (), money_scale))


def period_metrics_for_anchors(
    facts: DataFrame,
    anchors: DataFrame,
    full_month: bool = False,
    money_scale: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Metrics for many (account, anchor) pairs in one job.

    ``anchors`` has ``account`` and ``anchor_date`` (capped mode) or
    ``month_start`` (full months). Each anchor is exploded to its 13 months,
    so facts meet anchors on an equi-join of (account, month). Facts are
    reduced to one row per (account, service, month) first (monthly sums, or
    per-day sums for capped windows), so the join fans out monthly rows. Spark
    picks the join by the sides' sizes; facts are first cut to the anchors' overall
    date span with literal bounds so the scan is pruned.
    """
    anchor_col = "month_start" if full_month else "anchor_date"
    a = anchors.select("account", F.col(anchor_col).try_cast("date").alias(anchor_col)).where(
        F.col("account").isNotNull() & F.col(anchor_col).isNotNull()
    ).distinct()
    a = a.select(
        "account",
        anchor_col,
        month_start(anchor_col).alias("_m0"),
        F.dayofmonth(anchor_col).alias("_dom"),
        F.explode(F.sequence(F.lit(0), F.lit(HISTORY_MONTHS))).alias("_k"),
    ).withColumn("_month", F.add_months("_m0", -F.col("_k")))
    a = a.withColumnRenamed("account", "_a_account")

    bounds = a.agg(F.min("_month").alias("lo"), F.max(anchor_col).alias("hi")).first()
    prefixes = P.is_prefixes(facts)
    if bounds is None or bounds["lo"] is None:
        empty = P.upto_day(facts, F.lit(1)) if prefixes else facts
        empty = empty.limit(0).withColumn("_k", F.lit(0)).withColumn(anchor_col, F.col(P.MONTH if prefixes else "date"))
        return _aggregate_periods(empty, (anchor_col,), money_scale)
    if prefixes:
        months = _months_between(facts, bounds["lo"], bounds["hi"])
        joined = months.join(a, (F.col("account") == F.col("_a_account")) & (F.col(P.MONTH) == F.col("_month")))
        cut = P.upto_day(joined, F.lit(P.DAYS) if full_month else F.col("_dom"))
        return _ordered_if(ordered, _aggregate_periods(cut, (anchor_col,), money_scale), (anchor_col,))
    hi = py_shift_month_start(bounds["hi"], 1) if full_month else bounds["hi"]
    f = date_range(facts, bounds["lo"], hi, hi_inclusive=not full_month)
    # Facts are first reduced (map-side partial aggregation) to one row per
    # (account, service, month), so each anchor month meets one row instead
    # of every daily fact row.
    if full_month:
        f = f.groupBy("account", "service", month_start("date").alias("_fmonth")).agg(
            sum_money("amount", money_scale).alias("amount")
        )
        joined = f.join(a, (F.col("account") == F.col("_a_account")) & (F.col("_fmonth") == F.col("_month")))
        return _ordered_if(ordered, _aggregate_periods(joined, (anchor_col,), money_scale), (anchor_col,))
    # Capped: every window is "month k, days 1..dom" (k = 0 included, as the
    # anchor lies in month 0), so per-day sums and row counts of the month
    # are kept and each anchor reads the prefix up to its day.
    day = F.dayofmonth("date")
    amount_type = f"DECIMAL(38,{money_scale})" if money_scale is not None else "DOUBLE"
    per_day_sum = [F.expr(_sum_sql(f"CASE WHEN day(date) = {d} THEN amount END", money_scale)) for d in range(1, 32)]
    per_day_rows = [F.count(F.when(day == d, F.lit(1))) for d in range(1, 32)]
    monthly = f.groupBy("account", "service", month_start("date").alias("_fmonth")).agg(
        F.array(*[c.cast(amount_type) for c in per_day_sum]).alias("_day_sums"),
        F.array(*per_day_rows).alias("_day_rows"),
    )
    joined = monthly.join(a, (F.col("account") == F.col("_a_account")) & (F.col("_fmonth") == F.col("_month")))
    capped = joined.select(
        anchor_col,
        "account",
        "service",
        "_k",
        F.expr(
            f"aggregate(slice(_day_sums, 1, _dom), CAST(NULL AS {amount_type}), "
            f"(acc, x) -> CASE WHEN x IS NULL THEN acc ELSE CAST(coalesce(acc, 0) + x AS {amount_type}) END)"
        ).alias("amount"),
        F.expr("aggregate(slice(_day_rows, 1, _dom), 0L, (acc, x) -> acc + x)").alias("_rows"),
    ).where(F.col("_rows") > 0)
    return _ordered_if(ordered, _aggregate_periods(capped, (anchor_col,), money_scale), (anchor_col,))


# --------------------------------------------------------------------------
# Totals, order, report matrix
# --------------------------------------------------------------------------

# Day-level report columns and how their totals are recomputed.
DAY_LEVEL_DELTAS = (
    ("delta_day", "cost", "prev_day"),
    ("delta_week", "cost", "prev_week"),
    ("delta_7d", "cost", "avg7"),
    ("delta_30d", "cost", "avg30"),
)
DAY_LEVEL_PCTS = (("pct_7d", "cost", "avg7"), ("pct_week", "cost", "prev_week"))


def metric_columns(df: DataFrame) -> list[str]:
    """Every column but the keys (date, account, service) is a metric."""
    return [c for c in df.columns if c not in {"date", "account", "service"}]


def service_totals(
    df: DataFrame,
    group_cols: Sequence[str] = ("account",),
    money_scale: int | None = None,
) -> DataFrame:
    """Total line per group: column sums over services (an empty sum is 0),
    with deltas and ratios recomputed from the sums (ratio of sums)."""
    metrics = [c for c in metric_columns(df) if c not in group_cols]
    exact = set(MONTH_COLUMNS) | {"cost", "prev_day", "prev_week"}
    sums = []
    for c in metrics:
        if money_scale is not None and c in exact:
            sums.append(F.expr(f"coalesce(CAST({_sum_sql(_q(c), money_scale)} AS DOUBLE), 0.0)").alias(c))
        elif money_scale is not None:
            # Averages have no last decimal: at four more than the money has, their
            # sum is exact and does not depend on the order of tasks either.
            sums.append(F.expr(f"coalesce(CAST(sum(CAST({_q(c)} AS DECIMAL(28,{money_scale + 4}))) AS DOUBLE), 0.0)").alias(c))
        else:
            sums.append(F.expr(f"coalesce(sum(CAST({_q(c)} AS DOUBLE)), 0.0)").alias(c))
    totals = df.groupBy(*group_cols).agg(*sums)
    present = set(metrics)
    recomputed: dict[str, str] = {}
    for d, p, a, b in DELTA_PAIRS:
        if a in present and b in present:
            recomputed[d] = f"{a} - {b}"
            recomputed[p] = f"try_divide({a} - {b}, {b})"
    for d, a, b in DAY_LEVEL_DELTAS:
        if a in present and b in present:
            recomputed[d] = f"{a} - {b}"
    for p, a, b in DAY_LEVEL_PCTS:
        if a in present and b in present:
            recomputed[p] = f"try_divide({a} - {b}, {b})"
    return totals.selectExpr(
        *[_q(c) for c in group_cols], *[f"{recomputed.get(c, _q(c))} AS {_q(c)}" for c in metrics]
    )


def collapse_duplicate_services(df: DataFrame, group_cols: Sequence[str] = ("account",), order_col: str | None = None) -> DataFrame:
    """One row per (group, service): the first known value of every metric in
    the order of ``order_col``. Without one nothing says which is first, so two
    different known values fail. Period metrics are unique per key already;
    this guards report inputs assembled from elsewhere."""
    metrics = [c for c in df.columns if c not in (*group_cols, "service", order_col)]

    def one(c: str) -> Column:
        if order_col is not None:
            return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col)))
        twice = F.raise_error(F.lit(f"two values of {c} for one service; name an order_col")).cast(df.schema[c].dataType)
        return F.when(F.min(c) != F.max(c), twice).otherwise(F.max(c))

    return df.groupBy(*group_cols, "service").agg(*[one(c).alias(c) for c in metrics])


def report_accounts(df: DataFrame) -> DataFrame:
    """Rows of accounts that get a report: the account list holds no NULL."""
    return df.where(F.col("account").isNotNull())


def service_order(df: DataFrame, group_cols: Sequence[str] = ("account",)) -> DataFrame:
    """Rank services per group by current amount, largest first, NULL last;
    ties by name. Without an ``mtd`` column, by name only, and a NULL service
    has no name to be listed by. One account's services meet in one task: as
    many rows as it has services."""
    order = [F.col("service").asc_nulls_last()]
    if "mtd" in df.columns:
        order = [F.col("mtd").desc_nulls_last()] + order
    else:
        df = df.where(F.col("service").isNotNull())
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))


# Report rows (value column, delta column, ratio column) in order.
REPORT_ROWS = (
    ("mtd", "delta_prev", "pct_prev"),
    ("prev_mtd", "delta_prev2", "pct_prev2"),
    ("prev2_mtd", "delta_prev3", "pct_prev3"),
    ("prev3_mtd", "delta_prev4", "pct_prev4"),
    ("prev4_mtd", "delta_prev5", "pct_prev5"),
    ("avg6", "delta_avg6", "pct_avg6"),
    ("avg12", "delta_avg12", "pct_avg12"),
)


def _stack_rows() -> str:
    """``stack`` generator: one row per report row with (metric, position,
    value, delta, pct)."""
    parts = ", ".join(
        f"'{v}', CAST({pos} AS BIGINT), CAST({v} AS DOUBLE), CAST({d} AS DOUBLE), CAST({p} AS DOUBLE)"
        for pos, (v, d, p) in enumerate(REPORT_ROWS, start=1)
    )
    return f"stack({len(REPORT_ROWS)}, {parts}) AS (metric, row_position, value, delta, pct)"


def service_report(
    metrics: DataFrame,
    group_cols: Sequence[str] = ("account",),
    money_scale: int | None = None,
) -> DataFrame:
    """Long form of the per-account report matrix.

    One row per (account, metric row, column): column ``Total`` (position 0)
    from :func:`service_totals`, then services in :func:`service_order`.
    Pivot on export only. Reports exist per account of the account list,
    which has no NULL account. The metrics frame (accounts x services) feeds
    both the service cells and the totals; pass it without an order.
    """
    keys = [_q(c) for c in group_cols]
    metrics = report_accounts(metrics)
    ranked = service_order(metrics, group_cols)
    cells = ranked.selectExpr(*keys, "service", "rank AS col_position", _stack_rows())
    totals = service_totals(metrics, group_cols, money_scale)
    total_cells = totals.selectExpr(
        *keys, "'Total' AS service", "CAST(0 AS BIGINT) AS col_position", _stack_rows()
    )
    return cells.unionByName(total_cells)


def accounts(df: DataFrame) -> DataFrame:
    """Distinct non-NULL accounts, sorted."""
    return df.select("account").where(F.col("account").isNotNull()).distinct().orderBy("account")


def anchors_for_month(anchors: DataFrame, month: dt.date | str) -> DataFrame:
    """Each account's anchor for one month (from :func:`month_anchors`)."""
    return anchors.where(F.col("month_start") == F.lit(py_month_start(as_date(month)))).select(
        "account", "anchor_date"
    )


def load_windows(
    existing: DataFrame,
    account_list: Iterable[str] | DataFrame,
    today: dt.date | str,
    backfill_months: int = 12,
) -> DataFrame:
    """Per-account load window ``[start, stop)`` for an incremental cost load.

    start = min(latest loaded date - 1 day, first of this month), or the
    first of the month ``backfill_months`` back when nothing is loaded;
    stop = tomorrow. The open month is thus always re-read.

    The latest date per account is looked up in the current and previous
    month first (pruned to those partitions). Accounts without rows there
    are joined to the older rows; when there are none, Spark finds that side
    empty while it runs and skips the scan of the history. No account list
    passes through the driver.
    """
    spark = existing.sparkSession
    today_d = as_date(today)
    m0 = py_month_start(today_d)
    backfill = py_shift_month_start(m0, -backfill_months)
    if isinstance(account_list, DataFrame):
        acc = account_list.select("account").distinct()
    else:
        acc = spark.createDataFrame([(a,) for a in account_list], "account string").distinct()
    since = py_shift_month_start(m0, -1)
    recent = date_range(existing, since, None).groupBy("account").agg(F.max("date").alias("_latest"))
    missing = acc.join(recent, "account", "left_anti")
    older = (
        date_range(existing, None, since, hi_inclusive=False)
        .join(missing, "account", "left_semi")
        .groupBy("account")
        .agg(F.max("date").alias("_latest"))
    )
    latest = recent.unionByName(older)
    start_candidate = F.coalesce(F.date_sub("_latest", 1), F.lit(backfill))
    return acc.join(latest, "account", "left").select(
        "account",
        F.least(start_candidate, F.lit(m0)).alias("start"),
        F.lit(today_d + dt.timedelta(days=1)).alias("stop"),
    )


def select_load_window(source: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``source`` inside each account's window: one join to the small
    window frame (one row per account) instead of a loop over accounts. The
    overall span is applied first as literal bounds for pruning."""
    w = windows
    bounds = w.agg(F.min("start").alias("lo"), F.max("stop").alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return source.limit(0)
    src = date_range(source, bounds["lo"], bounds["hi"], hi_inclusive=False)
    win = w.select(F.col("account").alias("_w_account"), "start", "stop")
    joined = src.join(
        win,
        (F.col("account") == F.col("_w_account"))
        & (F.col("date") >= F.col("start"))
        & (F.col("date") < F.col("stop")),
    )
    return joined.select(*source.columns)


def load_summary(df: DataFrame) -> DataFrame:
    """Rows, first and last day of a loaded table."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def loaded_totals(loaded: DataFrame, money_scale: int | None = None) -> DataFrame:
    """Per account of one load run: rows, amount, first and last day."""
    return loaded.groupBy("account").agg(
        F.count(F.lit(1)).alias("rows"),
        money_value(sum_money("amount", money_scale)).alias("amount"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def month_shift(df: DataFrame) -> DataFrame:
    """Calendar columns of each distinct date: month start, previous and
    next month start, month end, day of month, and the same day capped to
    the previous month's length."""
    d = df.select("date").where(F.col("date").isNotNull()).distinct()
    ms = month_start("date")
    prev = F.add_months(ms, -1)
    return d.select(
        "date",
        ms.alias("month_start"),
        prev.alias("prev_month_start"),
        F.add_months(ms, 1).alias("next_month_start"),
        F.last_day("date").alias("month_end"),
        F.dayofmonth("date").cast("bigint").alias("dom"),
        F.least(F.last_day(prev), F.date_add(prev, F.dayofmonth("date") - 1)).alias("prev_month_capped"),
    )


def service_share(df: DataFrame, numerator: str, denominator: str, money_scale: int | None = None) -> DataFrame:
    """Per (account, month): amount of one service over another's, NULL when
    the denominator is 0 or missing."""
    amt = F.col("amount")
    g = df.groupBy("account", month_start("date").alias("month_start")).agg(
        money_value(sum_money(F.when(F.col("service") == numerator, amt), money_scale)).alias("numerator_amount"),
        money_value(sum_money(F.when(F.col("service") == denominator, amt), money_scale)).alias("denominator_amount"),
    )
    return g.select("*", safe_ratio("numerator_amount", "denominator_amount").alias("ratio"))
