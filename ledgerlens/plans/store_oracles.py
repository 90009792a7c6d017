"""DuckDB oracles for the queries that go through files: what the tables say they must give back."""

from __future__ import annotations

from ..sources.service_map import DEFAULT_SERVICE_MAP
from .cost_oracles import ANCHORS_CTE, UPSERTED_CTES
from .cost_oracles import oracles as cost_oracles
from .oracle_sql import FIXTURE_CTES, SNAPSHOT_CTES, metrics_cte, with_ctes
from .snapshot_oracles import SEED_CTES, TREND_BASE


def _over(sql: str, relation: str) -> str:
    """The same SQL with another relation in place of the costs view."""
    return sql.replace("FROM costs", f"FROM {relation}")


#: The labelled view of the table after its upsert.
LOADED_CTE = "loaded AS (SELECT f.date, f.account, COALESCE(m.label, f.service) AS service, f.amount FROM ups f LEFT JOIN service_map m ON m.raw = f.service)"

YEARS_CTE = (
    "y AS (SELECT *, year(date) AS y FROM cost_fact)",
    "spans AS (SELECT account, MIN(y) AS lo, MAX(y) AS hi FROM y GROUP BY account)",
)


def _csv(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '[\",\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE COALESCE({x}, '') END)"


def oracles() -> dict[str, str]:
    costs = cost_oracles()
    q = {}
    q["upserted_table"] = costs["cost_upsert"]
    q["stored_summary"] = costs["load_summary"]
    q["prefix_metrics_latest"] = with_ctes(
        FIXTURE_CTES, *UPSERTED_CTES, LOADED_CTE, _over(metrics_cte("pm", "(SELECT MAX(date) FROM loaded)"), "loaded"), body="SELECT * FROM pm"
    )
    q["prefix_metrics_all_anchors"] = with_ctes(
        FIXTURE_CTES, *UPSERTED_CTES, LOADED_CTE, _over(ANCHORS_CTE, "loaded"), "pa AS (SELECT account, anchor_date FROM anc)",
        _over(metrics_cte("pm", "pa", per="anchor_date"), "loaded"), body="SELECT * FROM pm",
    )
    q["prefix_report_for_past_month"] = costs["report_for_past_month"]  # the upsert changes later months only
    seed = ", ".join(f"({n}, '{label}')" for n, (_, label) in enumerate(sorted(DEFAULT_SERVICE_MAP)))
    q["service_map_seed"] = (
        f"SELECT CAST(o_orderdate AS DATE) AS date, 'one' AS account, COALESCE(label, 'other ' || CAST(o_custkey % 50 AS VARCHAR)) AS service, "
        f"CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders LEFT JOIN (VALUES {seed}) s(n, label) ON o_custkey % 50 = n GROUP BY 1, 2, 3"
    )
    q["named_table"] = "SELECT n_nationkey, n_name FROM nation"
    q["replaced_table"] = with_ctes(FIXTURE_CTES, body="SELECT date, account, service, amount * 2 AS amount FROM cost_fact WHERE account <> 'BUILDING'")
    q["published_pair"] = with_ctes(
        FIXTURE_CTES,
        body="SELECT account, CAST(date_trunc('month', date) AS DATE) AS month_start, MAX(date) AS anchor_date, MAX(date) AS latest, COUNT(*) AS rows FROM cost_fact GROUP BY 1, 2",
    )
    q["cost_pages_loaded"] = with_ctes(
        FIXTURE_CTES,
        *YEARS_CTE,
        "ends AS (SELECT account, y, MAX(date) AS last_day FROM y GROUP BY account, y)",
        body="SELECT date, y.account, service, CASE WHEN date = last_day AND EXISTS (SELECT 1 FROM ends n WHERE n.account = y.account AND n.y = y.y + 1) "
        "THEN CAST(CAST(amount + 1 AS DECIMAL(18,2)) AS DOUBLE) ELSE amount END AS amount FROM y JOIN ends e ON e.account = y.account AND e.y = y.y",
    )
    token = lambda e: f"'t' || CAST({e} AS VARCHAR)"
    faults = (
        ("BUILDING", "missing_page", token("lo + 2")), ("BUILDING", "unasked_page", token("lo + 3")),
        ("FURNITURE", "no_first", "CAST(NULL AS VARCHAR)"), ("FURNITURE", "unasked_page", token("lo + 1")),
        ("HOUSEHOLD", "missing_page", token("hi")), ("HOUSEHOLD", "no_end", "CAST(NULL AS VARCHAR)"),
        ("MACHINERY", "doubled_page", token("lo + 1")),
    )
    q["cost_page_faults"] = with_ctes(
        FIXTURE_CTES, *YEARS_CTE,
        body=" UNION ALL ".join(f"SELECT account, '{f}' AS fault, {d} AS detail FROM spans WHERE account = '{a}'" for a, f, d in faults),
    )
    q["snapshot_documents"] = with_ctes(
        SNAPSHOT_CTES, body="SELECT date, tenant, source_backend, pods, LEAST(onboarded, pods) AS onboarded, CAST(NULL AS VARCHAR) AS reason FROM snapshot"
    )
    q["snapshot_discovery"] = with_ctes(
        SNAPSHOT_CTES,
        "wanted AS (SELECT s AS source_backend, CAST(y AS INTEGER) AS year FROM (VALUES ('alpha'), ('beta'), ('gamma')) v(s), range(1994, 2026) r(y))",
        "there AS (SELECT DISTINCT source_backend, CAST(year(date) AS INTEGER) AS year FROM snapshot)",
        "firsts AS (SELECT source_backend, MIN(year) AS lo FROM there GROUP BY source_backend)",
        body="SELECT w.source_backend, w.year, t.year IS NOT NULL AS found, CASE WHEN t.year IS NOT NULL THEN 'loaded' "
        "WHEN lo IS NULL OR w.year < lo THEN 'skipped_leading' ELSE 'gap' END AS status "
        "FROM wanted w LEFT JOIN there t USING (source_backend, year) LEFT JOIN firsts USING (source_backend)",
    )
    q["snapshot_refresh_table"] = with_ctes(*TREND_BASE, SEED_CTES, body="SELECT * FROM daily WHERE year(date) < 2001 UNION ALL SELECT * FROM daily_2001")
    q["cost_report_exports"] = (
        f"WITH r AS ({costs['report_for_past_month']}), "
        f"l AS (SELECT account, 0 AS p, 'Metric,' || string_agg({_csv('service')}, ',' ORDER BY col_position) AS line FROM r WHERE row_position = 1 GROUP BY account "
        f"UNION ALL SELECT account, row_position, {_csv('row_label')} || ',' || string_agg({_csv('cell_text')}, ',' ORDER BY col_position) FROM r GROUP BY account, row_position, row_label) "
        "SELECT account, string_agg(line || chr(10), '' ORDER BY p) AS csv FROM l GROUP BY account"
    )
    return q
