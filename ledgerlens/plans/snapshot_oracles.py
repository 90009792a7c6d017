"""DuckDB oracles for the snapshot and trend queries."""

from __future__ import annotations

from .oracle_sql import SNAPSHOT_CTES, sql_count_fmt, with_ctes

LINEITEM_CTE = """
li_day AS (
    SELECT CAST(l.l_shipdate AS DATE) AS date, r.r_name AS tenant,
           COUNT(*) AS n, COUNT(*) FILTER (WHERE l.l_returnflag = 'R') AS f
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY 1, 2
),
li_snap AS (
    SELECT date, tenant, 'delta' AS source_backend,
           CAST(SUM(n) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pods,
           CAST(SUM(f) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS onboarded
    FROM li_day
),
both_snap AS (SELECT * FROM region_snap UNION ALL SELECT * FROM li_snap)"""

# Daily rows: previous row of the tenant, 0 before the first.
DAILY_CTE = """
daily AS (
    SELECT date, tenant, source_backend,
           pods - COALESCE(LAG(pods) OVER (PARTITION BY tenant ORDER BY date), 0) AS daily_delta,
           pods AS total_pods,
           onboarded - COALESCE(LAG(onboarded) OVER (PARTITION BY tenant ORDER BY date), 0) AS daily_onboarded_delta,
           onboarded AS onboarded_pods
    FROM region_snap
)"""

MONTH_END_CTE = """
month_end AS (
    SELECT month_start, tenant, source_backend, pods, onboarded, date FROM (
        SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, *,
               row_number() OVER (PARTITION BY tenant, date_trunc('month', date) ORDER BY date DESC) AS rn
        FROM region_snap) t
    WHERE rn = 1
)"""

MONTHLY_CTE = """
monthly AS (
    SELECT month_start, tenant, source_backend,
           pods - COALESCE(LAG(pods) OVER (PARTITION BY tenant ORDER BY month_start), 0) AS monthly_delta,
           pods AS total_pods,
           onboarded - COALESCE(LAG(onboarded) OVER (PARTITION BY tenant ORDER BY month_start), 0) AS monthly_onboarded_delta,
           onboarded AS onboarded_pods
    FROM month_end
)"""

SEED_CTES = """
dseed AS (SELECT tenant, total_pods, onboarded_pods FROM daily WHERE date = DATE '2000-12-31'),
mseed AS (SELECT tenant, total_pods, onboarded_pods FROM monthly WHERE month_start = DATE '2000-12-01'),
daily_2001 AS (
    SELECT s.date, s.tenant, s.source_backend,
           s.pods - COALESCE(LAG(s.pods) OVER w, d.total_pods, 0) AS daily_delta,
           s.pods AS total_pods,
           s.onboarded - COALESCE(LAG(s.onboarded) OVER w, d.onboarded_pods, 0) AS daily_onboarded_delta,
           s.onboarded AS onboarded_pods
    FROM region_snap s LEFT JOIN dseed d ON d.tenant = s.tenant
    WHERE s.date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'
    WINDOW w AS (PARTITION BY s.tenant ORDER BY s.date)
),
me_2001 AS (
    SELECT month_start, tenant, source_backend, pods, onboarded FROM (
        SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, *,
               row_number() OVER (PARTITION BY tenant, date_trunc('month', date) ORDER BY date DESC) AS rn
        FROM region_snap WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31') t
    WHERE rn = 1
),
monthly_2001 AS (
    SELECT s.month_start, s.tenant, s.source_backend,
           s.pods - COALESCE(LAG(s.pods) OVER w, m.total_pods, 0) AS monthly_delta,
           s.pods AS total_pods,
           s.onboarded - COALESCE(LAG(s.onboarded) OVER w, m.onboarded_pods, 0) AS monthly_onboarded_delta,
           s.onboarded AS onboarded_pods
    FROM me_2001 s LEFT JOIN mseed m ON m.tenant = s.tenant
    WINDOW w AS (PARTITION BY s.tenant ORDER BY s.month_start)
)"""

WINDOW_CTES = """
mw AS (SELECT * FROM monthly WHERE month_start >= DATE '2000-09-01'),
dw AS (SELECT * FROM daily WHERE date >= DATE '2001-06-03'),
ten AS (SELECT tenant FROM mw UNION SELECT tenant FROM dw)"""


def _matrix_ctes(value_col: str) -> str:
    return f"""
tm AS (
    SELECT month_start, tenant, MAX(CAST({value_col} AS DOUBLE)) AS v, MAX(CAST(total_pods AS DOUBLE)) AS r
    FROM mw WHERE {value_col} IS NOT NULL AND total_pods IS NOT NULL GROUP BY 1, 2
),
axis AS (
    SELECT CAST(lm.m - to_months(CAST(i AS INTEGER)) AS DATE) AS month_start
    FROM (SELECT MAX(month_start) AS m FROM tm) lm, range(0, 12) t(i)
),
grid AS (
    SELECT a.month_start, t.tenant, tm.v, tm.r
    FROM axis a CROSS JOIN ten t LEFT JOIN tm ON tm.month_start = a.month_start AND tm.tenant = t.tenant
),
filled AS (
    SELECT month_start, tenant,
           LAST_VALUE(v IGNORE NULLS) OVER w AS value,
           LAST_VALUE(r IGNORE NULLS) OVER w AS reference_value
    FROM grid
    WINDOW w AS (PARTITION BY tenant ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
matrix AS (
    SELECT month_start, tenant, value, reference_value,
           value - LAG(value) OVER (PARTITION BY tenant ORDER BY month_start) AS delta,
           (value - LAG(value) OVER (PARTITION BY tenant ORDER BY month_start))
             / NULLIF(LAG(value) OVER (PARTITION BY tenant ORDER BY month_start), 0) AS pct
    FROM filled
)"""


def _last_days_ctes(daily: str, tenants: str, value_col: str) -> str:
    return f"""
td AS (
    SELECT date, tenant, MAX(CAST({value_col} AS DOUBLE)) AS v, MAX(CAST(total_pods AS DOUBLE)) AS r
    FROM {daily} WHERE {value_col} IS NOT NULL AND total_pods IS NOT NULL GROUP BY 1, 2
),
ld AS (SELECT MAX(date) AS d FROM td),
cur AS (
    SELECT tenant, v, r FROM (
        SELECT tenant, v, r, row_number() OVER (PARTITION BY tenant ORDER BY date DESC) AS rn FROM td) x
    WHERE rn = 1
),
base AS (
    SELECT tenant, v FROM (
        SELECT tenant, v, row_number() OVER (PARTITION BY tenant ORDER BY date DESC) AS rn
        FROM td, ld WHERE td.date <= ld.d - 30) x
    WHERE rn = 1
),
l30 AS (
    SELECT t.tenant, COALESCE(cur.v, 0.0) AS value, COALESCE(cur.r, 0.0) AS reference_value,
           COALESCE(base.v, 0.0) AS baseline_value,
           COALESCE(cur.v, 0.0) - COALESCE(base.v, 0.0) AS delta,
           (COALESCE(cur.v, 0.0) - COALESCE(base.v, 0.0)) / NULLIF(COALESCE(base.v, 0.0), 0) AS pct
    FROM {tenants} t LEFT JOIN cur ON cur.tenant = t.tenant LEFT JOIN base ON base.tenant = t.tenant
)"""


TREND_BASE = (SNAPSHOT_CTES, DAILY_CTE, MONTH_END_CTE, MONTHLY_CTE)


def oracles() -> dict[str, str]:
    q = {}
    # The forms are those of fixtures.dirty_snapshots: 23:30 at five hours behind UTC is the next day,
    # rows without a date, tenant, source or number go, and the total's whole part bounds onboarded.
    q["snapshot_normalize"] = with_ctes(
        SNAPSHOT_CTES,
        "dirty AS (SELECT *, (pods + day(date)) % 29 AS k FROM snapshot)",
        body="SELECT CASE WHEN k % 5 = 0 THEN CAST(date + 1 AS DATE) ELSE date END AS date, tenant, source_backend, pods, "
        "LEAST(CASE WHEN k > 20 THEN onboarded + pods ELSE onboarded END, pods) AS onboarded "
        "FROM dirty WHERE k NOT IN (3, 7, 8, 9, 11, 12, 14)",
    )
    reasons = (
        "bad_date", "year_mismatch", "not_a_list", "not_an_object", "no_tenant", "no_total", "no_onboarded",
        "total_not_numeric", "total_negative", "total_not_whole",
        "onboarded_not_numeric", "onboarded_negative", "onboarded_not_whole",
    )
    q["snapshot_validate"] = with_ctes(
        SNAPSHOT_CTES,
        "kinds AS (SELECT *, (pods + day(date)) % 40 AS k FROM snapshot)",
        "marked AS (SELECT *, CASE k " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(reasons)) + " END AS reason, "
        "CASE WHEN k = 15 THEN 1000 ELSE pods END AS total FROM kinds)",
        body="SELECT CASE WHEN reason IS NULL THEN date END AS date, CASE WHEN reason IS NULL THEN tenant END AS tenant, "
        "source_backend, CASE WHEN reason IS NULL THEN total END AS pods, "
        "CASE WHEN reason IS NULL THEN LEAST(onboarded, total) END AS onboarded, reason FROM marked",
    )
    q["snapshot_conflicts"] = with_ctes(
        SNAPSHOT_CTES,
        LINEITEM_CTE,
        body="SELECT date, tenant, COUNT(DISTINCT pods) AS distinct_pods, COUNT(DISTINCT onboarded) AS distinct_onboarded "
        "FROM both_snap GROUP BY date, tenant "
        "HAVING COUNT(DISTINCT pods) > 1 OR COUNT(DISTINCT onboarded) > 1",
    )
    q["snapshot_duplicates"] = with_ctes(
        SNAPSHOT_CTES,
        LINEITEM_CTE,
        body="SELECT date, tenant, COUNT(*) AS count_rows FROM both_snap GROUP BY date, tenant HAVING COUNT(*) > 1",
    )
    q["snapshot_load_summary"] = with_ctes(
        SNAPSHOT_CTES,
        body="SELECT source_backend, COUNT(DISTINCT year(date)) AS files, COUNT(*) AS rows, "
        "MIN(date) AS min_date, MAX(date) AS max_date FROM snapshot GROUP BY source_backend",
    )
    q["leading_gap_check"] = with_ctes(
        SNAPSHOT_CTES,
        "exp AS (SELECT s.source_backend, CAST(y.year AS INTEGER) AS year FROM "
        "(VALUES ('alpha'), ('beta'), ('gamma')) s(source_backend), range(1994, 2003) y(year))",
        "fnd AS (SELECT DISTINCT source_backend, CAST(year(date) AS INTEGER) AS year FROM snapshot)",
        "first_year AS (SELECT source_backend, MIN(year) AS fy FROM fnd GROUP BY source_backend)",
        body="SELECT e.source_backend, e.year, (f.year IS NOT NULL) AS found, "
        "CASE WHEN f.year IS NOT NULL THEN 'loaded' "
        "WHEN fy.fy IS NULL OR e.year < fy.fy THEN 'skipped_leading' ELSE 'gap' END AS status "
        "FROM exp e LEFT JOIN fnd f ON f.source_backend = e.source_backend AND f.year = e.year "
        "LEFT JOIN first_year fy ON fy.source_backend = e.source_backend",
    )
    q["daily_delta"] = with_ctes(*TREND_BASE, body="SELECT * FROM daily")
    q["month_end_snapshot"] = with_ctes(*TREND_BASE, body="SELECT * FROM month_end")
    q["monthly_delta"] = with_ctes(*TREND_BASE, body="SELECT * FROM monthly")
    q["seed_values"] = with_ctes(
        *TREND_BASE,
        SEED_CTES,
        body="SELECT 'daily' AS kind, * FROM dseed UNION ALL SELECT 'monthly', * FROM mseed",
    )
    q["daily_delta_seeded"] = with_ctes(*TREND_BASE, SEED_CTES, body="SELECT * FROM daily_2001")
    q["monthly_delta_seeded"] = with_ctes(*TREND_BASE, SEED_CTES, body="SELECT * FROM monthly_2001")
    q["replace_range"] = with_ctes(
        *TREND_BASE,
        SEED_CTES,
        "again AS (SELECT date, tenant, source_backend, pods + day(date) AS pods, onboarded + 2 AS onboarded "
        "FROM region_snap WHERE year(date) = 2001 AND day(date) % 9 <> 4)",
        "again_all AS (SELECT * FROM again UNION ALL SELECT date, 'OCEANIA', source_backend, pods, onboarded "
        "FROM again WHERE tenant = 'ASIA')",
        "again_daily AS (SELECT s.date, s.tenant, s.source_backend, "
        "s.pods - COALESCE(LAG(s.pods) OVER w, d.total_pods, 0) AS daily_delta, s.pods AS total_pods, "
        "s.onboarded - COALESCE(LAG(s.onboarded) OVER w, d.onboarded_pods, 0) AS daily_onboarded_delta, "
        "s.onboarded AS onboarded_pods FROM again_all s LEFT JOIN dseed d ON d.tenant = s.tenant "
        "WINDOW w AS (PARTITION BY s.tenant ORDER BY s.date))",
        body="SELECT * FROM daily WHERE year(date) <> 2001 UNION ALL SELECT * FROM again_daily",
    )
    q["monthly_trend_window"] = with_ctes(*TREND_BASE, WINDOW_CTES, body="SELECT * FROM mw")
    q["daily_trend_window"] = with_ctes(*TREND_BASE, WINDOW_CTES, body="SELECT * FROM dw")
    q["trend_matrix_total"] = with_ctes(*TREND_BASE, WINDOW_CTES, _matrix_ctes("total_pods"), body="SELECT * FROM matrix")
    q["trend_matrix_onboarded"] = with_ctes(
        *TREND_BASE, WINDOW_CTES, _matrix_ctes("onboarded_pods"), body="SELECT * FROM matrix"
    )
    q["trend_totals"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("total_pods"),
        "tt AS (SELECT month_start, COALESCE(SUM(value), 0.0) AS value, "
        "COALESCE(SUM(reference_value), 0.0) AS reference_value FROM matrix GROUP BY month_start)",
        body="SELECT t.month_start, t.value, t.reference_value, t.value - p.value AS delta, "
        "(t.value - p.value) / NULLIF(p.value, 0) AS pct FROM tt t "
        "LEFT JOIN tt p ON p.month_start = CAST(t.month_start - INTERVAL 1 MONTH AS DATE)",
    )
    q["trend_pivot"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("total_pods"),
        body="SELECT month_start, "
        + ", ".join(f"MAX(value) FILTER (WHERE tenant = '{t}') AS \"{t}\"" for t in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
        + " FROM matrix GROUP BY month_start",
    )
    def wide(value: str) -> str:
        names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
        return f"SUM({value}) AS \"Total\", " + ", ".join(f"MAX({value}) FILTER (WHERE tenant = '{t}') AS \"{t}\"" for t in names)

    q["pod_report_wide"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("total_pods"),
        _last_days_ctes("dw", "ten", "total_pods"),
        body=f"SELECT strftime(month_start, '%Y-%m-%d') AS period, {wide('value')} FROM matrix GROUP BY month_start "
        f"UNION ALL SELECT 'last_days', {wide('delta')} FROM l30",
    )
    q["last_30_days"] = with_ctes(
        *TREND_BASE, WINDOW_CTES, _last_days_ctes("dw", "ten", "total_pods"), body="SELECT * FROM l30"
    )
    q["last_30_days_every_day"] = with_ctes(
        *TREND_BASE,
        "obs AS (SELECT DISTINCT date FROM daily)",
        "cal AS (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS as_of FROM obs)",
        "known AS (SELECT c.as_of, o.date AS latest_date FROM cal c ASOF JOIN obs o ON c.as_of >= o.date)",
        "shown AS (SELECT DISTINCT k.as_of, d.tenant, k.latest_date FROM known k JOIN daily d ON d.date BETWEEN k.as_of - 59 AND k.as_of)",
        "now AS (SELECT s.*, CASE WHEN d.date >= s.as_of - 59 THEN d.total_pods END AS v FROM shown s "
        "ASOF LEFT JOIN daily d ON s.tenant = d.tenant AND s.latest_date >= d.date)",
        "then_ AS (SELECT n.*, n.latest_date - 30 AS base_date FROM now n)",
        "pair_ AS (SELECT t.*, CASE WHEN d.date >= t.as_of - 59 THEN d.total_pods END AS b FROM then_ t "
        "ASOF LEFT JOIN daily d ON t.tenant = d.tenant AND t.base_date >= d.date)",
        "vals AS (SELECT as_of, tenant, latest_date, COALESCE(CAST(v AS DOUBLE), 0.0) AS value, COALESCE(CAST(b AS DOUBLE), 0.0) AS baseline_value FROM pair_)",
        body="SELECT *, value - baseline_value AS delta, (value - baseline_value) / NULLIF(baseline_value, 0) AS pct FROM vals",
    )
    q["last_30_days_total"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _last_days_ctes("dw", "ten", "total_pods"),
        body="SELECT value, reference_value, baseline_value, value - baseline_value AS delta, "
        "(value - baseline_value) / NULLIF(baseline_value, 0) AS pct FROM ("
        "SELECT COALESCE(SUM(value), 0.0) AS value, COALESCE(SUM(reference_value), 0.0) AS reference_value, "
        "COALESCE(SUM(baseline_value), 0.0) AS baseline_value FROM l30) s",
    )
    q["last_30_days_events"] = with_ctes(
        SNAPSHOT_CTES,
        "edaily AS (SELECT date, tenant, source_backend, pods AS total_pods, onboarded AS onboarded_pods "
        "FROM events_snap WHERE date >= DATE '2023-12-02')",
        "emonthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, tenant, "
        "arg_max(pods, date) AS total_pods, arg_max(onboarded, date) AS onboarded_pods FROM events_snap "
        "GROUP BY 1, 2 HAVING CAST(date_trunc('month', date) AS DATE) >= DATE '2023-02-01')",
        "eten AS (SELECT tenant FROM emonthly UNION SELECT tenant FROM edaily)",
        _last_days_ctes("edaily", "eten", "onboarded_pods"),
        body="SELECT * FROM l30",
    )
    q["onboarded_share"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("onboarded_pods"),
        body="SELECT month_start, tenant, value, reference_value, "
        "CASE WHEN reference_value > 0 THEN value / reference_value END AS share, "
        "CASE WHEN reference_value IS NULL OR reference_value <= 0 OR value IS NULL THEN 'neutral' "
        "WHEN value / reference_value >= 0.75 THEN 'pos' WHEN value / reference_value >= 0.30 THEN 'warn' "
        "ELSE 'neg' END AS share_class FROM matrix",
    )
    q["latest_monthly_rows"] = with_ctes(
        *TREND_BASE, body="SELECT * FROM monthly ORDER BY month_start DESC, tenant LIMIT 20"
    )
    q["latest_daily_rows"] = with_ctes(*TREND_BASE, body="SELECT * FROM daily ORDER BY date DESC, tenant LIMIT 20")
    q["tenant_order"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("total_pods"),
        _last_days_ctes("dw", "ten", "total_pods"),
        "cm AS (SELECT tenant, reference_value AS current_value FROM matrix "
        "WHERE month_start = (SELECT MAX(month_start) FROM matrix))",
        body="SELECT cm.tenant, cm.current_value, COALESCE(l30.delta, 0.0) AS last_days_delta, "
        "CAST(row_number() OVER (ORDER BY cm.current_value DESC NULLS LAST, COALESCE(l30.delta, 0.0) DESC, "
        "lower(cm.tenant), cm.tenant) AS BIGINT) AS rank FROM cm LEFT JOIN l30 ON l30.tenant = cm.tenant",
    )
    q["distinct_keys"] = with_ctes(*TREND_BASE, WINDOW_CTES, body="SELECT tenant FROM ten")
    q["trend_class"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("total_pods"),
        body="SELECT month_start, tenant, CASE WHEN delta > 0 THEN 'pos' WHEN delta < 0 THEN 'neg' "
        "WHEN delta = 0 THEN 'neutral' WHEN pct > 0 THEN 'pos' WHEN pct < 0 THEN 'neg' "
        "WHEN pct = 0 THEN 'neutral' ELSE '' END AS trend_class FROM matrix",
    )
    pct_d = "(pct * 100)"
    share_d = "(value / reference_value * 100)"
    q["pod_report_text"] = with_ctes(
        *TREND_BASE,
        WINDOW_CTES,
        _matrix_ctes("onboarded_pods"),
        body="SELECT month_start, tenant, "
        f"{sql_count_fmt('value')} AS value_text, {sql_count_fmt('delta', 0, True)} AS delta_text, "
        f"CASE WHEN pct IS NULL THEN '' ELSE (CASE WHEN abs({pct_d}) >= 1 THEN {sql_count_fmt(pct_d, 0, True)} "
        f"ELSE {sql_count_fmt(pct_d, 1, True)} END) || '%' END AS pct_text, "
        f"CASE WHEN value IS NULL OR reference_value IS NULL OR reference_value <= 0 THEN '' ELSE "
        f"(CASE WHEN abs({share_d}) >= 1 THEN {sql_count_fmt(share_d, 0)} ELSE {sql_count_fmt(share_d, 1)} END) || '%' END "
        "AS share_text, "
        "CASE WHEN value IS NULL OR reference_value IS NULL OR reference_value <= 0 THEN 'neutral' "
        "WHEN value / reference_value >= 0.75 THEN 'pos' WHEN value / reference_value >= 0.30 THEN 'warn' "
        "ELSE 'neg' END AS share_class FROM matrix",
    )
    return q
