"""Independent DuckDB SQL for every registered query.

Period metrics come from a calendar of months joined to the costs, trends from
window functions: other forms than those of the Spark jobs, so the two check
each other.
Tables ``orders customer nation region events lineitem`` are views.
"""

from __future__ import annotations

# Stand-in domain tables, as SQL (see FIXTURES.md).
FIXTURE_CTES = """
cost_lines AS (
    SELECT CAST(o.o_orderdate AS DATE) AS date, c.c_mktsegment AS account,
           n.n_name AS linked_account, o.o_orderpriority AS service,
           o.o_totalprice AS amount, o.o_orderstatus AS status, c.c_acctbal AS acctbal
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
cost_fact AS (
    SELECT date, account, service,
           CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM cost_lines GROUP BY date, account, service
),
cost_fact_n AS (
    SELECT date, account, service, amount FROM cost_fact
    UNION ALL
    SELECT date, CAST(NULL AS VARCHAR), service,
           CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)
    FROM cost_lines WHERE acctbal < 0 GROUP BY date, service
    UNION ALL
    SELECT date, account, CAST(NULL AS VARCHAR),
           CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)
    FROM cost_lines WHERE status = 'P' AND service = '1-URGENT' GROUP BY date, account
),
service_map(raw, label) AS (
    VALUES ('1-URGENT', 'Urgent'), ('2-HIGH', 'High'), ('3-MEDIUM', 'High'),
           ('4-NOT SPECIFIED', 'Tax')
),
costs AS (
    SELECT f.date, f.account, COALESCE(m.label, f.service) AS service, f.amount
    FROM cost_fact_n f LEFT JOIN service_map m ON m.raw = f.service
)"""

SNAPSHOT_CTES = """
region_day AS (
    SELECT CAST(o.o_orderdate AS DATE) AS date, r.r_name AS tenant, r.r_regionkey AS rk,
           COUNT(*) AS n, COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS f
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY 1, 2, 3
),
events_day AS (
    SELECT CAST(ts AS DATE) AS date, event_type AS tenant,
           COUNT(*) AS n, COUNT(*) FILTER (WHERE value >= 50.0) AS f
    FROM events GROUP BY 1, 2
),
region_snap AS (
    SELECT date, tenant,
           CASE WHEN rk % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source_backend,
           CAST(SUM(n) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pods,
           CAST(SUM(f) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS onboarded
    FROM region_day
),
events_snap AS (
    SELECT date, tenant, 'gamma' AS source_backend,
           CAST(SUM(n) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pods,
           CAST(SUM(f) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS onboarded
    FROM events_day
),
snapshot AS (
    SELECT * FROM region_snap UNION ALL SELECT * FROM events_snap
)"""


def with_ctes(*blocks: str, body: str) -> str:
    parts = ",".join(b.strip().rstrip(",") for b in blocks if b.strip())
    return f"WITH {parts}\n{body}"


# The report's value columns by months back, its averages by months
# averaged, and (delta, ratio, value, value before) of its comparisons.
MONTH_VALUES = ("mtd", "prev_mtd", "prev2_mtd", "prev3_mtd", "prev4_mtd", "prev5_mtd")
AVERAGES = (("avg6", 6), ("avg12", 12))
COMPARISONS = (
    ("delta_prev", "pct_prev", "mtd", "prev_mtd"),
    ("delta_prev2", "pct_prev2", "prev_mtd", "prev2_mtd"),
    ("delta_prev3", "pct_prev3", "prev2_mtd", "prev3_mtd"),
    ("delta_prev4", "pct_prev4", "prev3_mtd", "prev4_mtd"),
    ("delta_prev5", "pct_prev5", "prev4_mtd", "prev5_mtd"),
    ("delta_avg6", "pct_avg6", "mtd", "avg6"),
    ("delta_avg12", "pct_avg12", "mtd", "avg12"),
)


def comparisons_sql() -> str:
    parts = []
    for delta, ratio, now, before in COMPARISONS:
        parts += [f"{now} - {before} AS {delta}", f"({now} - {before}) / NULLIF({before}, 0) AS {ratio}"]
    return ", ".join(parts)


def metrics_cte(name: str, anchor: str, full: bool = False, per: str | None = None) -> str:
    """CTEs that end in ``name``, the metrics rows.

    ``anchor`` is a date expression, or with ``per`` (the anchor's column) a
    relation (account, ``per``). A calendar of the anchor's month and the twelve
    before, each with its first and last day that count, meets the costs once.
    """
    who = "account, " if per else ""
    source = f"SELECT account, {per} AS anchor FROM {anchor}" if per else f"SELECT CAST({anchor} AS DATE) AS anchor"
    final = "last_day(m)" if full else "least(last_day(m), CAST(m + CAST(day(anchor) - 1 AS INTEGER) AS DATE))"
    same = " AND c.account = d.account" if per else ""
    values = [f"CAST(MAX(s) FILTER (WHERE k = {k}) AS DOUBLE) AS {c}" for k, c in enumerate(MONTH_VALUES)]
    values += [f"CAST(SUM(s) FILTER (WHERE k BETWEEN 1 AND {n}) AS DOUBLE) / COUNT(s) FILTER (WHERE k BETWEEN 1 AND {n}) AS {c}" for c, n in AVERAGES]
    # What came before is joined by account and service in the reports, so it is unknown where one of them is.
    past = [c for c in (*MONTH_VALUES[1:], *(c for c, _ in AVERAGES))]
    known = ", ".join(f"CASE WHEN account IS NOT NULL AND service IS NOT NULL THEN {c} END AS {c}" for c in past)
    anchored = f"anchor AS {per}, " if per else ""
    return f"""
{name}_days AS (
    SELECT {who}anchor, k, m AS first_day, CAST({final} AS DATE) AS final_day
    FROM (SELECT {who}anchor, k, CAST(date_trunc('month', anchor) - to_months(CAST(k AS INTEGER)) AS DATE) AS m
          FROM ({source}) a, generate_series(0, 12) AS g(k)) x
),
{name}_sums AS (
    SELECT c.account, d.anchor, c.service, d.k, SUM(CAST(c.amount AS DECIMAL(18,2))) AS s
    FROM costs c JOIN {name}_days d ON c.date BETWEEN d.first_day AND d.final_day{same}
    GROUP BY ALL
),
{name}_values AS (
    SELECT account, anchor, service, {', '.join(values)}
    FROM {name}_sums GROUP BY account, anchor, service HAVING COUNT(*) FILTER (WHERE k = 0) > 0
),
{name} AS (
    SELECT *, {comparisons_sql()} FROM (SELECT account, {anchored}service, mtd, {known} FROM {name}_values) v
)"""


def period_metrics_sql(anchor_sql: str, full: bool = False) -> str:
    return with_ctes(FIXTURE_CTES, metrics_cte("pm", anchor_sql, full), body="SELECT * FROM pm")


def sql_fmt(x: str, decimals: int, sign: bool = False) -> str:
    """Italian number text in DuckDB: printf grouping, then swap , and ."""
    body = f"translate(printf('%,.{decimals}f', CAST({x} AS DOUBLE)), ',.', '.,')"
    if sign:
        body = f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {body})"
    return f"COALESCE({body}, '')"


def sql_count_fmt(x: str, decimals: int = 0, sign: bool = False) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '' WHEN round_even(CAST({x} AS DOUBLE), {decimals}) = 0 THEN '0' ELSE {sql_fmt(x, decimals, sign)} END)"


MONTH_NAMES_SQL = (
    "['Gennaio', 'Febbraio', 'Marzo', 'Aprile', 'Maggio', 'Giugno', 'Luglio', 'Agosto', "
    "'Settembre', 'Ottobre', 'Novembre', 'Dicembre']"
)


def sql_month_label(d: str) -> str:
    return f"(list_extract({MONTH_NAMES_SQL}, month({d})) || ' ' || CAST(year({d}) AS VARCHAR))"
