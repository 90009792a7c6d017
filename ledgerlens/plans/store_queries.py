"""Registered queries that go through files: rows of the stand-in tables are
written to the shared folder as a job's input, the job loads, keeps or exports
them, and what it left there is read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costs as C
from ..operators import snapshots as S
from ..operators import trends as T
from ..session import work_folder
from ..sinks import versions
from ..sinks.tables import merge_latest, publish_tables, read_published, read_replaced, read_upserted, replace_all, stored_summary
from ..sources import cost_pages as CP
from ..sources import fixtures as fx
from ..sources import snapshot_files as SF
from ..sources import snapshot_stream as ST
from ..sources.service_map import DEFAULT_SERVICE_MAP, service_map_frame
from ..sources.tables import read_parquet, read_table
from .cost_queries import FULL_MONTH, LOADED_BEFORE, UPSERT_FROM_1, UPSERT_FROM_2, q_report_for_past_month
from .jobs import cost_report_for_period, export_cost_reports, read_prefixes, snapshot_refresh, upsert_costs
from .snapshot_queries import REFRESH_YEAR

SCALE = fx.MONEY_SCALE
#: The span of the months that the reports of one past month read.
HISTORY_FROM = dt.date(1999, 3, 1)


# --------------------------------------------------------------------------
# Cost tables
# --------------------------------------------------------------------------


def _two_loads(spark: SparkSession, sf_dir: str, since: dt.date | None = None) -> str:
    """A cost table after a first load and an upsert of two batches."""
    path = work_folder(spark, "costs")
    f = C.date_range(fx.cost_fact_with_nulls(spark, sf_dir), since, None)
    # Rows with a NULL key part are many for one key here; they pass an upsert one by one.
    upsert_costs(spark, path, [f.where(F.col("date") < F.lit(LOADED_BEFORE))], SCALE)
    b1 = f.where(F.col("date") >= F.lit(UPSERT_FROM_1)).withColumn("amount", F.col("amount") * 2)
    b2 = f.where(F.col("date") >= F.lit(UPSERT_FROM_2)).withColumn("amount", F.col("amount") + 1)
    upsert_costs(spark, path, [b1, b2], SCALE)
    return path


def _labelled_prefixes(spark, path):
    return C.label_services(read_prefixes(spark, path), fx.fixture_service_map(spark))


def q_upserted_table(spark, sf_dir):
    """The table's rows after two loads, as stored."""
    return read_upserted(spark, _two_loads(spark, sf_dir)).select("date", "account", "service", "amount")


def q_stored_summary(spark, sf_dir):
    """The loaded table's rows and span, from the footers of its files."""
    return stored_summary(spark, _two_loads(spark, sf_dir))


def q_prefix_metrics_latest(spark, sf_dir):
    """Month-to-date metrics at the latest date, from the month prefixes alone."""
    return C.period_metrics(_labelled_prefixes(spark, _two_loads(spark, sf_dir)), None, money_scale=SCALE)


def q_prefix_metrics_all_anchors(spark, sf_dir):
    """Month-to-date metrics of every account and month anchor, from the month prefixes alone."""
    p = _labelled_prefixes(spark, _two_loads(spark, sf_dir))
    return C.period_metrics_for_anchors(p, C.month_anchors(p, ordered=False), money_scale=SCALE)


def q_prefix_report_for_past_month(spark, sf_dir):
    """A past month's report of the current accounts, from the month prefixes alone."""
    p = _labelled_prefixes(spark, _two_loads(spark, sf_dir, HISTORY_FROM))
    return cost_report_for_period(p, f"month:{FULL_MONTH}", money_scale=SCALE)


def q_service_map_seed(spark, sf_dir):
    """Daily cost by the label of the seed's raw names, dealt to the customers; five numbers in fifty have none."""
    names = spark.createDataFrame([(raw, n) for n, (raw, _) in enumerate(sorted(DEFAULT_SERVICE_MAP))], "_raw string, _n bigint")
    o = read_parquet(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 50).alias("_n"), F.col("o_totalprice").alias("amount"))
    lines = o.join(names, "_n", "left").select("date", F.lit("one").alias("account"), F.coalesce("_raw", F.concat(F.lit("other "), F.col("_n"))).alias("service"), "amount")
    return C.daily_cost_rollup(C.label_services(lines, service_map_frame(spark)), SCALE)


def q_named_table(spark, sf_dir):
    """A catalog table by its checked name, with a column list."""
    read_parquet(spark, sf_dir, "nation").createOrReplaceTempView("ledger_nations")
    return read_table(spark, "ledger_nations", ["n_nationkey", "n_name"])


def q_replaced_table(spark, sf_dir):
    """A table whose rows were replaced twice, partitioned, as its pointer names it."""
    path = work_folder(spark, "replaced")
    f = fx.cost_fact(spark, sf_dir).withColumn("year", F.year("date"))
    replace_all(f, path, ["year"])
    replace_all(f.where(F.col("account") != "BUILDING").withColumn("amount", F.col("amount") * 2), path, ["year"])
    return read_replaced(spark, path).select("date", "account", "service", "amount")


def q_published_pair(spark, sf_dir):
    """Two tables published together, read from the one state a reader has seen while another is published."""
    base = work_folder(spark, "pair")
    f = fx.cost_fact(spark, sf_dir)
    publish_tables({"days": f, "months": C.month_anchors(f, ordered=False)}, base)
    seen = versions.latest(spark, base)
    later = f.where(F.col("date") < F.lit(LOADED_BEFORE))
    publish_tables({"days": later, "months": C.month_anchors(later, ordered=False)}, base)
    days, months = (read_published(spark, base, t, seen) for t in ("days", "months"))
    of = days.groupBy("account", F.trunc("date", "MM").alias("month_start")).agg(F.count("*").alias("rows"), F.max("date").alias("latest"))
    return months.join(of, ["account", "month_start"]).select("account", "month_start", "anchor_date", "latest", "rows")


# --------------------------------------------------------------------------
# Cost pages
# --------------------------------------------------------------------------


def _written_pages(spark, sf_dir, keep=None, doubled=None) -> str:
    """A landing folder: per account one request, a page for each year; every page
    but the first begins with a correction of the last day of the page before."""
    f = fx.cost_fact(spark, sf_dir).where(F.col("service").isNotNull()).withColumn("year", F.year("date"))
    ends = f.groupBy("account", "year").agg(F.max("date").alias("date"))
    later = f.select("account", F.col("year").alias("_y")).distinct()
    again = f.join(ends, ["account", "year", "date"]).select("date", "account", "service", (F.col("amount") + 1).alias("amount"), (F.col("year") + 1).alias("year"))
    again = again.join(later, (F.col("year") == F.col("_y")) & again["account"].eqNullSafe(later["account"]), "left_semi")
    group = F.struct(F.array("service").alias("Keys"), F.struct(F.struct(F.col("amount").cast("decimal(18,2)").cast("string").alias("Amount")).alias("UnblendedCost")).alias("Metrics"))
    days = f.unionByName(again).groupBy("account", "year", "date").agg(F.sort_array(F.collect_list(group)).alias("Groups"))
    day = F.struct(F.struct(F.date_format("date", "yyyy-MM-dd").alias("Start")).alias("TimePeriod"), "Groups")
    pages = days.groupBy("account", "year").agg(F.sort_array(F.collect_list(day)).alias("ResultsByTime"))
    span = f.groupBy("account").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    token = lambda y: F.concat(F.lit("t"), y.cast("string"))
    pages = pages.join(span, "account").select(
        "account", F.lit("r1").alias("request"), "year", "lo", "hi", "ResultsByTime",
        F.when(F.col("year") > F.col("lo"), token(F.col("year"))).alias("PageToken"),
        F.when(F.col("year") < F.col("hi"), token(F.col("year") + 1)).alias("NextPageToken"),
    )
    if keep is not None:
        pages = pages.where(keep)
    if doubled is not None:
        pages = pages.withColumn("copy", F.explode(F.when(doubled, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    else:
        pages = pages.withColumn("copy", F.lit(0))
    folder = work_folder(spark, "pages")
    # One page is one file: each has a folder of its own.
    out = pages.select("account", "request", F.col("year").alias("page"), "copy", "ResultsByTime", "PageToken", "NextPageToken")
    out.repartition("account", "page", "copy").write.partitionBy("account", "request", "page", "copy").json(folder)
    return folder


def q_cost_pages_loaded(spark, sf_dir):
    """Whole chains of pages, read and merged: of a key in two pages the later page counts."""
    rows = CP.read_cost_pages(spark, _written_pages(spark, sf_dir))
    return merge_latest(None, [rows], C.FACT_KEYS, CP.SEQ)


def q_cost_page_faults(spark, sf_dir):
    """What is wrong with five requests: whole; a middle page lost; the first; the last; a page twice."""
    a, y = F.col("account"), F.col("year")
    lost = ((a == "BUILDING") & (y == F.col("lo") + 2)) | ((a == "FURNITURE") & (y == F.col("lo"))) | ((a == "HOUSEHOLD") & (y == F.col("hi")))
    folder = _written_pages(spark, sf_dir, ~lost, (a == "MACHINERY") & (y == F.col("lo") + 1))
    faults = CP.chain_faults(CP.read_pages(spark, folder))
    return faults.select(F.regexp_extract("request", "account=([^/]+)/", 1).alias("account"), "fault", "detail")


# --------------------------------------------------------------------------
# Snapshot documents
# --------------------------------------------------------------------------


def _written_documents(spark, snaps: DataFrame, folder: str, gzip: bool) -> None:
    """A document for each source and year at ``<folder>/<source>/year=<year>/snap.json``."""
    item = F.struct("tenant", F.col("pods").alias("total"), "onboarded")
    days = snaps.groupBy("source_backend", F.year("date").alias("year"), F.date_format("date", "yyyy-MM-dd").alias("d")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    docs = days.groupBy("source_backend", "year").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "rows"))))).alias("value"))
    writer = docs.select("source_backend", "year", "value").repartition("source_backend", "year").write.partitionBy("source_backend", "year").mode("append")
    (writer.option("compression", "gzip") if gzip else writer).text(f"{folder}/raw")
    # The job finds its files by a template, so each gets its name; a few renames.
    files = versions.Folder(spark, folder)
    for source in [n for n in files.names("raw") if n.startswith("source_backend=")]:
        for year in files.names(f"raw/{source}"):
            for part in [n for n in files.names(f"raw/{source}/{year}") if n.startswith("part-")]:
                files.move(f"raw/{source}/{year}/{part}", f"{source.removeprefix('source_backend=')}/{year}/snap.json")


def _documents(spark, sf_dir) -> str:
    """Plain and gzip documents of the three sources; the names do not tell which."""
    folder = work_folder(spark, "snapshots")
    s = fx.snapshot(spark, sf_dir)
    _written_documents(spark, s.where(F.col("source_backend") == fx.SOURCE_EVEN), folder, gzip=False)
    _written_documents(spark, s.where(F.col("source_backend") != fx.SOURCE_EVEN), folder, gzip=True)
    return folder


def _templates(folder: str) -> dict[str, str]:
    return {s: f"{folder}/{s}/year={{year}}/snap.json" for s in (fx.SOURCE_EVEN, fx.SOURCE_ODD, fx.SOURCE_EVENTS)}


def _all_years(folder: str) -> dict[str, list[tuple[int, str]]]:
    years = range(1994, 2026)
    return {s: list(zip(years, paths, strict=True)) for s, paths in SF.build_input_paths(_templates(folder), years).items()}


def q_snapshot_documents(spark, sf_dir):
    """The rows of all documents, found by a listing job, walked piece by piece and validated."""
    folder = _documents(spark, sf_dir)
    found = ST.discover(spark, _all_years(folder)).where("found").select("source_backend", "path").collect()
    paths = {s: sorted(r.path for r in found if r.source_backend == s) for s in {r.source_backend for r in found}}
    return S.validate_rows(SF.rows_of_items(ST.read_items(spark, paths)))


def q_snapshot_discovery(spark, sf_dir):
    """Which (source, year) documents there are: coverage with skipped leading years and gaps."""
    folder = _documents(spark, sf_dir)
    wanted = _all_years(folder)
    found = ST.discover(spark, wanted).where("found").withColumn("year", S.path_year(F.col("path")))
    return SF.year_coverage(spark, list(wanted), range(1994, 2026), found)


def q_snapshot_refresh_table(spark, sf_dir):
    """The daily table after a bootstrap up to the year before and a refresh of the last year."""
    folder = work_folder(spark, "snapshots")
    _written_documents(spark, fx.region_snapshot(spark, sf_dir).where(F.year("date") <= REFRESH_YEAR), folder, gzip=True)
    templates = {s: p for s, p in _templates(folder).items() if s != fx.SOURCE_EVENTS}
    base = work_folder(spark, "trends")
    for year in (REFRESH_YEAR - 1, REFRESH_YEAR):
        snapshot_refresh(spark, templates, base, year, 1990)
    return read_published(spark, base, "daily").select(*T.DAILY_COLUMNS)


# --------------------------------------------------------------------------
# Exports
# --------------------------------------------------------------------------


def q_cost_report_exports(spark, sf_dir):
    """Every account's exported report, as the text of its file."""
    folder = export_cost_reports(q_report_for_past_month(spark, sf_dir), work_folder(spark, "exports"))
    files = spark.read.schema("value string, account string").text(folder, wholetext=True)
    return files.select("account", F.col("value").alias("csv"))


QUERIES = {
    "upserted_table": q_upserted_table,
    "stored_summary": q_stored_summary,
    "prefix_metrics_latest": q_prefix_metrics_latest,
    "prefix_metrics_all_anchors": q_prefix_metrics_all_anchors,
    "prefix_report_for_past_month": q_prefix_report_for_past_month,
    "service_map_seed": q_service_map_seed,
    "named_table": q_named_table,
    "replaced_table": q_replaced_table,
    "published_pair": q_published_pair,
    "cost_pages_loaded": q_cost_pages_loaded,
    "cost_page_faults": q_cost_page_faults,
    "snapshot_documents": q_snapshot_documents,
    "snapshot_discovery": q_snapshot_discovery,
    "snapshot_refresh_table": q_snapshot_refresh_table,
    "cost_report_exports": q_cost_report_exports,
}
