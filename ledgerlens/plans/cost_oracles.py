"""DuckDB oracles for the cost queries."""

from __future__ import annotations

from .oracle_sql import (
    AVERAGES,
    FIXTURE_CTES,
    MONTH_VALUES,
    comparisons_sql,
    metrics_cte,
    period_metrics_sql,
    sql_fmt,
    sql_month_label,
    with_ctes,
)

MTD_NO_TAX = "pmt AS (SELECT * FROM pm WHERE service IS DISTINCT FROM 'Tax' AND account IS NOT NULL)"


def _exact_sum(c: str) -> str:
    """Sum of averages at six decimals; 0 when there are none."""
    return f"COALESCE(CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE), 0.0)"


def _totals_sql(src: str) -> str:
    sums = [f"COALESCE(CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS {c}" for c in MONTH_VALUES]
    sums += [f"{_exact_sum(c)} AS {c}" for c, _ in AVERAGES]
    return f"SELECT *, {comparisons_sql()} FROM (SELECT account, {', '.join(sums)} FROM {src} GROUP BY account) s"


def _report_rows(src: str, service_expr: str, pos_expr: str) -> str:
    # The report's rows (value, delta, ratio).
    rows = (
        ("mtd", "delta_prev", "pct_prev"),
        ("prev_mtd", "delta_prev2", "pct_prev2"),
        ("prev2_mtd", "delta_prev3", "pct_prev3"),
        ("prev3_mtd", "delta_prev4", "pct_prev4"),
        ("prev4_mtd", "delta_prev5", "pct_prev5"),
        ("avg6", "delta_avg6", "pct_avg6"),
        ("avg12", "delta_avg12", "pct_avg12"),
    )
    parts = []
    for i, (v, d, p) in enumerate(rows, start=1):
        parts.append(
            f"SELECT account, {service_expr} AS service, {pos_expr} AS col_position, '{v}' AS metric, "
            f"CAST({i} AS BIGINT) AS row_position, {v} AS value, {d} AS delta, {p} AS pct FROM {src}"
        )
    return " UNION ALL ".join(parts)


ORDER_CTE = (
    "ord AS (SELECT *, CAST(row_number() OVER (PARTITION BY account ORDER BY mtd DESC NULLS LAST, "
    "service ASC NULLS LAST) AS BIGINT) AS rnk FROM pmt)"
)

ANCHORS_CTE = (
    "anc AS (SELECT account, CAST(date_trunc('month', date) AS DATE) AS month_start, MAX(date) AS anchor_date "
    "FROM costs WHERE account IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)"
)

DAY_LEVEL_CTE = """
dl AS (
    SELECT account, service,
        CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date = DATE '2000-03-31') AS DOUBLE) AS cost,
        CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date = DATE '2000-03-30') AS DOUBLE) AS prev_day,
        CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date = DATE '2000-03-24') AS DOUBLE) AS prev_week,
        CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date BETWEEN DATE '2000-03-24' AND DATE '2000-03-30'), 0) AS DOUBLE) / 7 AS avg7,
        CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-03-30'), 0) AS DOUBLE) / 30 AS avg30
    FROM cost_fact WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31'
    GROUP BY account, service
)"""


#: The stand-in's facts after an upsert of two batches.
UPSERTED_CTES = (
    "ex AS (SELECT * FROM cost_fact_n WHERE date < DATE '2001-07-01')",
    "b1 AS (SELECT date, account, service, amount * 2 AS amount FROM cost_fact_n WHERE date >= DATE '2001-06-15')",
    "b2 AS (SELECT date, account, service, amount + 1 AS amount FROM cost_fact_n WHERE date >= DATE '2001-07-15')",
    "allr AS (SELECT *, 0 AS b FROM ex UNION ALL SELECT *, 1 FROM b1 UNION ALL SELECT *, 2 FROM b2)",
    "nn AS (SELECT * FROM allr WHERE date IS NOT NULL AND account IS NOT NULL AND service IS NOT NULL)",
    "ups AS (SELECT date, account, service, amount FROM nn n WHERE NOT EXISTS (SELECT 1 FROM nn m "
    "WHERE m.date = n.date AND m.account = n.account AND m.service = n.service AND m.b > n.b) "
    "UNION ALL SELECT date, account, service, amount FROM allr "
    "WHERE date IS NULL OR account IS NULL OR service IS NULL)",
)


def oracles() -> dict[str, str]:
    q = {}
    q["distinct_accounts"] = with_ctes(
        FIXTURE_CTES, body="SELECT DISTINCT account FROM costs WHERE account IS NOT NULL ORDER BY account"
    )
    q["daily_cost_rollup"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT date, account, service, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount "
        "FROM cost_lines GROUP BY date, account, service",
    )
    q["linked_account_exclusion"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT date, account, service, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount "
        "FROM cost_lines l WHERE NOT COALESCE(l.account = 'BUILDING' AND l.linked_account IN ("
        "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'), FALSE) "
        "GROUP BY date, account, service",
    )
    q["service_label"] = with_ctes(FIXTURE_CTES, body="SELECT date, account, service, amount FROM costs")
    q["tax_filter"] = with_ctes(
        FIXTURE_CTES, body="SELECT date, account, service, amount FROM costs WHERE service IS DISTINCT FROM 'Tax'"
    )
    q["table_projection"] = with_ctes(FIXTURE_CTES, body="SELECT date, account, amount FROM cost_fact")
    q["period_metrics_mtd"] = period_metrics_sql("DATE '2000-03-31'")
    q["period_metrics_full"] = period_metrics_sql("DATE '2000-03-01'", full=True)
    q["period_metrics_latest"] = period_metrics_sql("(SELECT MAX(date) FROM costs)")
    q["period_metrics_per_account"] = with_ctes(
        FIXTURE_CTES,
        ANCHORS_CTE,
        "pa AS (SELECT account, anchor_date FROM anc WHERE month_start = DATE '2001-03-01')",
        metrics_cte("pm", "pa", per="anchor_date"),
        body="SELECT * FROM pm",
    )
    q["period_metrics_all_anchors"] = with_ctes(
        FIXTURE_CTES,
        ANCHORS_CTE,
        "pa AS (SELECT account, anchor_date FROM anc)",
        metrics_cte("pm", "pa", per="anchor_date"),
        body="SELECT * FROM pm",
    )
    q["period_metrics_all_months"] = with_ctes(
        FIXTURE_CTES,
        ANCHORS_CTE,
        "pa AS (SELECT account, month_start FROM anc)",
        metrics_cte("pm", "pa", full=True, per="month_start"),
        body="SELECT * FROM pm",
    )
    q["month_anchors"] = with_ctes(FIXTURE_CTES, ANCHORS_CTE, body="SELECT account, month_start, anchor_date FROM anc")
    q["latest_loaded"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT account, MAX(date) AS latest_date, CAST(date_trunc('month', MAX(date)) AS DATE) AS latest_month "
        "FROM cost_fact_n GROUP BY account",
    )
    q["period_options"] = with_ctes(
        FIXTURE_CTES,
        ANCHORS_CTE,
        "lm AS (SELECT account, MAX(month_start) AS latest FROM anc GROUP BY account)",
        body="SELECT a.account, 'current' AS option, a.month_start, a.anchor_date, CAST(0 AS BIGINT) AS position "
        "FROM anc a JOIN lm ON a.account = lm.account AND a.month_start = lm.latest "
        "UNION ALL SELECT a.account, 'month:' || strftime(a.month_start, '%Y-%m-%d'), a.month_start, a.anchor_date, "
        "CAST(row_number() OVER (PARTITION BY a.account ORDER BY a.month_start DESC) AS BIGINT) "
        "FROM anc a JOIN lm ON a.account = lm.account AND a.month_start < lm.latest",
    )
    mtd = metrics_cte("pm", "DATE '2000-03-31'")
    q["service_totals"] = with_ctes(FIXTURE_CTES, mtd, MTD_NO_TAX, body=_totals_sql("pmt"))
    q["day_level_totals"] = with_ctes(
        FIXTURE_CTES,
        DAY_LEVEL_CTE,
        body="SELECT account, cost, prev_day, prev_week, avg7, avg30, "
        "cost - prev_day AS delta_day, cost - prev_week AS delta_week, cost - avg7 AS delta_7d, "
        "cost - avg30 AS delta_30d, (cost - avg7) / NULLIF(avg7, 0) AS pct_7d, "
        "(cost - prev_week) / NULLIF(prev_week, 0) AS pct_week FROM ("
        "SELECT account, "
        "COALESCE(CAST(SUM(CAST(cost AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS cost, "
        "COALESCE(CAST(SUM(CAST(prev_day AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS prev_day, "
        "COALESCE(CAST(SUM(CAST(prev_week AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS prev_week, "
        f"{_exact_sum('avg7')} AS avg7, {_exact_sum('avg30')} AS avg30 FROM dl GROUP BY account) s",
    )
    q["service_order"] = with_ctes(
        FIXTURE_CTES, mtd, MTD_NO_TAX, ORDER_CTE, body="SELECT account, service, mtd, rnk AS rank FROM ord"
    )
    q["service_report"] = with_ctes(
        FIXTURE_CTES,
        mtd,
        MTD_NO_TAX,
        ORDER_CTE,
        f"tot AS ({_totals_sql('pmt')})",
        body=_report_rows("ord", "service", "rnk") + " UNION ALL " + _report_rows("tot", "'Total'", "CAST(0 AS BIGINT)"),
    )
    incr = (
        "ex AS (SELECT * FROM cost_fact WHERE date < DATE '2001-07-01' AND account <> 'MACHINERY')",
        "acc AS (SELECT DISTINCT account FROM cost_lines)",
        "win AS (SELECT a.account, LEAST(COALESCE(CAST(l.latest - INTERVAL 1 DAY AS DATE), DATE '2000-08-01'), "
        "DATE '2001-08-01') AS start_d, DATE '2001-08-02' AS stop_d FROM acc a LEFT JOIN "
        "(SELECT account, MAX(date) AS latest FROM ex GROUP BY account) l ON l.account = a.account)",
        "incr AS (SELECT f.date, f.account, f.service, f.amount FROM cost_fact f JOIN win w "
        "ON f.account = w.account AND f.date >= w.start_d AND f.date < w.stop_d)",
    )
    q["incremental_window"] = with_ctes(FIXTURE_CTES, *incr, body="SELECT * FROM incr")
    q["loaded_totals"] = with_ctes(
        FIXTURE_CTES,
        *incr,
        body="SELECT account, COUNT(*) AS rows, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, "
        "MIN(date) AS min_date, MAX(date) AS max_date FROM incr GROUP BY account",
    )
    ups = UPSERTED_CTES
    q["cost_upsert"] = with_ctes(FIXTURE_CTES, *ups, body="SELECT * FROM ups")
    q["load_summary"] = with_ctes(
        FIXTURE_CTES, *ups, body="SELECT COUNT(*) AS total_rows, MIN(date) AS min_date, MAX(date) AS max_date FROM ups"
    )
    q["safe_ratio"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT account, month_start, numerator_amount, denominator_amount, "
        "numerator_amount / NULLIF(denominator_amount, 0) AS ratio FROM ("
        "SELECT account, CAST(date_trunc('month', date) AS DATE) AS month_start, "
        "CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE service = 'Tax') AS DOUBLE) AS numerator_amount, "
        "CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE service = 'Urgent') AS DOUBLE) AS denominator_amount "
        "FROM costs GROUP BY 1, 2) s",
    )
    q["month_shift"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT date, CAST(date_trunc('month', date) AS DATE) AS month_start, "
        "CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS prev_month_start, "
        "CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS next_month_start, "
        "CAST(last_day(date) AS DATE) AS month_end, CAST(day(date) AS BIGINT) AS dom, "
        "LEAST(CAST(last_day(date_trunc('month', date) - INTERVAL 1 MONTH) AS DATE), "
        "CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) + CAST(day(date) - 1 AS INTEGER)) AS prev_month_capped "
        "FROM (SELECT DISTINCT date FROM cost_fact WHERE date IS NOT NULL) d",
    )
    cell = (
        "CASE WHEN value IS NULL THEN '' WHEN pct IS NULL THEN " + sql_fmt("value", 2)
        + " ELSE " + sql_fmt("value", 2) + " || chr(10) || " + sql_fmt("pct * 100", 1, sign=True) + " || '%' END"
    )
    q["report_text"] = with_ctes(
        FIXTURE_CTES,
        mtd,
        MTD_NO_TAX,
        ORDER_CTE,
        f"tot AS ({_totals_sql('pmt')})",
        "rep AS (" + _report_rows("ord", "service", "rnk") + " UNION ALL "
        + _report_rows("tot", "'Total'", "CAST(0 AS BIGINT)") + ")",
        body=f"SELECT account, service, metric, {cell} AS cell_text, "
        "CASE WHEN pct IS NULL THEN '' WHEN pct < 0 THEN 'neg' ELSE 'pos' END AS pct_class FROM rep",
    )
    def period_report(metrics: str, own: str, month: str, tax: bool) -> str:
        """Report rows of the listed accounts that are in ``own``, labelled back from ``month``."""
        labels = " ".join(
            f"WHEN '{m}' THEN " + sql_month_label(f"CAST({month} - INTERVAL {k} MONTH AS DATE)") for k, m in enumerate(MONTH_VALUES[:5])
        )
        return with_ctes(
            FIXTURE_CTES,
            ANCHORS_CTE,
            "newest AS (SELECT MAX(date) AS day, CAST(date_trunc('month', MAX(date)) AS DATE) AS month FROM costs)",
            "listed AS (SELECT DISTINCT account FROM costs, newest WHERE account IS NOT NULL AND date BETWEEN month AND day)",
            f"own AS (SELECT * FROM anc WHERE month_start = {own})",
            metrics,
            "pmt AS (SELECT * FROM pm WHERE account IN (SELECT account FROM listed) AND account IN (SELECT account FROM own)"
            + ("" if tax else " AND service IS DISTINCT FROM 'Tax'") + ")",
            ORDER_CTE,
            f"tot AS ({_totals_sql('pmt')})",
            "rep AS (" + _report_rows("ord", "service", "rnk") + " UNION ALL "
            + _report_rows("tot", "'Total'", "CAST(0 AS BIGINT)") + ")",
            body=f"SELECT *, CASE metric {labels} WHEN 'avg6' THEN 'Media 6M' WHEN 'avg12' THEN 'Media 12M' END AS row_label, "
            f"{cell} AS cell_text, CASE WHEN pct IS NULL THEN '' WHEN pct < 0 THEN 'neg' ELSE 'pos' END AS pct_class FROM rep",
        )

    newest = "(SELECT month FROM newest)"
    march = "DATE '2000-03-01'"
    q["report_for_past_month"] = period_report(metrics_cte("pm", march, full=True), march, march, tax=True)
    q["report_past_month_mtd"] = period_report(metrics_cte("pm", "own", per="anchor_date"), march, march, tax=True)
    q["report_current"] = period_report(metrics_cte("pm", "(SELECT day FROM newest)"), newest, newest, tax=False)
    q["report_current_whole_month"] = period_report(metrics_cte("pm", "own", full=True, per="month_start"), newest, newest, tax=False)
    cells = ", ".join(
        f"COALESCE(MAX(cell_text) FILTER (WHERE service = '{c}'), '') AS \"{c}\"" for c in ("Total", "Urgent", "High", "Tax", "5-LOW")
    )
    q["cost_report_wide"] = (
        f"SELECT row_label AS \"Metric\", {cells} FROM ({q['report_for_past_month']}) r "
        "WHERE account = 'HOUSEHOLD' GROUP BY row_label, row_position"
    )
    q["collapse_duplicate_services"] = with_ctes(FIXTURE_CTES, mtd, MTD_NO_TAX, body="SELECT account, service, mtd, avg12 FROM pmt")
    rows = [("mtd", 0), ("prev_mtd", 1), ("prev2_mtd", 2), ("prev3_mtd", 3), ("prev4_mtd", 4)]
    label_cols = ", ".join(
        sql_month_label(f"CAST(month_start - INTERVAL {k} MONTH AS DATE)") + f" AS label_{m}" for m, k in rows
    )
    q["period_labels"] = with_ctes(
        FIXTURE_CTES,
        ANCHORS_CTE,
        "lm AS (SELECT account, MAX(month_start) AS latest FROM anc GROUP BY account)",
        "opts AS (SELECT a.account, 'current' AS option, a.month_start FROM anc a JOIN lm ON a.account = lm.account "
        "AND a.month_start = lm.latest UNION ALL SELECT a.account, 'month:' || strftime(a.month_start, '%Y-%m-%d'), "
        "a.month_start FROM anc a JOIN lm ON a.account = lm.account AND a.month_start < lm.latest)",
        body="SELECT account, option, CASE WHEN option = 'current' THEN 'Stato attuale' ELSE "
        + sql_month_label("month_start") + f" END AS period_label, {label_cols}, "
        "'Media 6M' AS label_avg6, 'Media 12M' AS label_avg12 FROM opts",
    )
    return q
