"""Stand-ins: domain frames built from the supplied test tables.

These only give rows in the schemas the jobs expect (see FIXTURES.md); none
of the jobs' own work happens here. Cost lines come from orders x customer,
snapshots from orders x customer x nation x region (and events as a second
source covering 30 days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ratio import money_value, sum_money
from ..operators.costs import daily_cost_rollup
from .tables import read_parquet

# Stand-in service map over order priorities. Two raw names share
# one label, one label is the tax service, and 5-LOW stays unmapped.
FIXTURE_SERVICE_MAP = (
    ("1-URGENT", "Urgent"),
    ("2-HIGH", "High"),
    ("3-MEDIUM", "High"),
    ("4-NOT SPECIFIED", "Tax"),
)
# The account whose lines of one region's linked accounts are left out.
EXCLUDED_ACCOUNT = "BUILDING"
EXCLUDED_REGION = "EUROPE"
MONEY_SCALE = 2

# Snapshot sources of the stand-in (region parity, and events).
SOURCE_EVEN = "alpha"
SOURCE_ODD = "beta"
SOURCE_EVENTS = "gamma"
EVENTS_ONBOARDED_MIN_VALUE = 50.0


def raw_cost_lines(spark: SparkSession, sf_dir: str, with_linked: bool = True) -> DataFrame:
    o = read_parquet(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus"
    )
    c = read_parquet(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"
    )
    lines = o.join(c, o["o_custkey"] == c["c_custkey"])
    linked = F.lit(None).cast("string")
    if with_linked:
        n = read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        lines = lines.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        linked = F.col("n_name")
    return lines.select(
        F.to_date("o_orderdate").alias("date"),
        F.col("c_mktsegment").alias("account"),
        linked.alias("linked_account"),
        F.col("o_orderpriority").alias("service"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("_status"),
        F.col("c_acctbal").alias("_acctbal"),
    )


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, account, linked_account, service, amount) per order."""
    return raw_cost_lines(spark, sf_dir).select(
        "date", "account", "linked_account", "service", "amount"
    )


def linked_account_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, linked_account) pairs to leave out: the nations of one region."""
    n = read_parquet(spark, sf_dir, "nation")
    r = read_parquet(spark, sf_dir, "region").where(F.col("r_name") == EXCLUDED_REGION)
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.lit(EXCLUDED_ACCOUNT).alias("account"), F.col("n_name").alias("linked_account")
    )


def cost_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_cost_lines(spark, sf_dir, with_linked=False).select("date", "account", "service", "amount")
    return daily_cost_rollup(lines, MONEY_SCALE)


def cost_fact_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cost_fact plus a slice with NULL account (customers with a negative
    balance) and a slice with NULL service (urgent orders in status P).

    Built in one pass: every line goes to the slices it belongs to and one
    grouped sum runs per (slice, date, account, service); groups of different
    slices never merge, so the rows equal the union of three rollups."""
    raw = raw_cost_lines(spark, sf_dir, with_linked=False)
    null_str = F.lit(None).cast("string")
    slices = F.array(
        F.struct(F.lit(0).alias("s"), F.col("account").alias("a"), F.col("service").alias("v")),
        F.when(F.col("_acctbal") < 0, F.struct(F.lit(1).alias("s"), null_str.alias("a"), F.col("service").alias("v"))),
        F.when(
            (F.col("_status") == "P") & (F.col("service") == "1-URGENT"),
            F.struct(F.lit(2).alias("s"), F.col("account").alias("a"), null_str.alias("v")),
        ),
    )
    tagged = raw.select("date", "amount", F.explode(F.filter(slices, lambda x: x.isNotNull())).alias("_x"))
    tagged = tagged.select("date", F.col("_x.s").alias("_slice"), F.col("_x.a").alias("account"),
                           F.col("_x.v").alias("service"), "amount")
    return (
        tagged.groupBy("_slice", "date", "account", "service")
        .agg(money_value(sum_money("amount", MONEY_SCALE)).alias("amount"))
        .select("date", "account", "service", "amount")
    )


def fixture_service_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXTURE_SERVICE_MAP), "raw string, label string")


def region_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters per region: running count of orders (pods) and of
    finished orders (onboarded); a row only on days with orders."""
    o = read_parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    c = read_parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_parquet(spark, sf_dir, "region").select("r_regionkey", "r_name")
    day = (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("r_name").alias("tenant"), "r_regionkey")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("_f"),
        )
    )
    w = Window.partitionBy("tenant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select(
        "date",
        "tenant",
        F.when(F.col("r_regionkey") % 2 == 0, F.lit(SOURCE_EVEN)).otherwise(F.lit(SOURCE_ODD)).alias("source_backend"),
        F.sum("_n").over(w).cast("bigint").alias("pods"),
        F.sum("_f").over(w).cast("bigint").alias("onboarded"),
    )


def events_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters per event type: running count of events (pods) and of
    events with value >= 50 (onboarded)."""
    e = read_parquet(spark, sf_dir, "events").select("ts", "event_type", "value")
    day = e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("tenant")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("value") >= EVENTS_ONBOARDED_MIN_VALUE, 1)).alias("_f"),
    )
    w = Window.partitionBy("tenant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select(
        "date",
        "tenant",
        F.lit(SOURCE_EVENTS).alias("source_backend"),
        F.sum("_n").over(w).cast("bigint").alias("pods"),
        F.sum("_f").over(w).cast("bigint").alias("onboarded"),
    )


def lineitem_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading of the regions from lineitem ship dates (running
    count of lines, and of lines with return flag R): same (date, tenant)
    keys as :func:`region_snapshot` with other values, so duplicates and
    conflicts appear."""
    li = read_parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    o = read_parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_parquet(spark, sf_dir, "region").select("r_regionkey", "r_name")
    day = (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.to_date("l_shipdate").alias("date"), F.col("r_name").alias("tenant"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("_f"),
        )
    )
    w = Window.partitionBy("tenant").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.select(
        "date",
        "tenant",
        F.lit("delta").alias("source_backend"),
        F.sum("_n").over(w).cast("bigint").alias("pods"),
        F.sum("_f").over(w).cast("bigint").alias("onboarded"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshot sources of the stand-in (regions and events)."""
    return region_snapshot(spark, sf_dir).unionByName(events_snapshot(spark, sf_dir))


def _kind(parts: int) -> Column:
    """A number that spreads the stand-in's rows over ``parts`` forms."""
    return (F.col("pods") + F.dayofmonth("date")) % parts


def raw_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows as they leave a JSON file: every field is text, the row
    object is a map (key presence kept) and the date is the file's key. One row
    in forty each has one of thirteen faults, and one in forty each another
    good form (``pods`` for ``total``, a padded tenant, an exponent)."""
    s = snapshot(spark, sf_dir).withColumn("_k", _kind(40))

    def at(k: int, value: Column, other: Column) -> Column:
        return F.when(F.col("_k") == k, value).otherwise(other)

    year = at(1, F.lit("1901"), F.year("date").cast("string"))
    pods, onboarded = F.col("pods").cast("string"), F.col("onboarded").cast("string")
    total = (
        F.when(F.col("_k") == 5, F.lit(None).cast("string"))
        .when(F.col("_k") == 7, "many")
        .when(F.col("_k") == 8, F.concat(F.lit("-"), pods))
        .when(F.col("_k") == 9, F.concat(pods, F.lit(".5")))
        .when(F.col("_k") == 15, "1e3")
        .otherwise(pods)
    )
    done = (
        F.when(F.col("_k") == 6, F.lit(None).cast("string"))
        .when(F.col("_k") == 10, "x")
        .when(F.col("_k") == 11, "-1")
        .when(F.col("_k") == 12, "0.25")
        .otherwise(onboarded)
    )
    tenant = F.when(F.col("_k") == 4, " ").when(F.col("_k") == 14, F.concat(F.lit(" "), "tenant", F.lit("\t"))).otherwise(F.col("tenant"))
    fields = [F.lit("tenant"), tenant, F.lit("onboarded"), done]
    row = at(
        13,
        F.create_map(*fields, F.lit("pods"), pods),
        F.create_map(*fields, F.lit("total"), total, F.lit("pods"), pods),
    )
    return s.select(
        at(0, F.lit("not-a-date"), F.date_format("date", "yyyy-MM-dd")).alias("date_text"),
        "source_backend",
        F.concat(F.col("source_backend"), F.lit("/year="), year, F.lit("/snap.json")).alias("path"),
        (F.col("_k") != 2).alias("value_is_list"),
        (F.col("_k") != 3).alias("row_is_object"),
        row.alias("row"),
    )


def dirty_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as text in many forms: dates with offsets, compact and with
    slashes; padded and blank tenants; missing, non-numeric and decimal
    counters; onboarded above the total."""
    s = snapshot(spark, sf_dir).withColumn("_k", _kind(29))
    k, pods = F.col("_k"), F.col("pods").cast("string")
    return s.select(
        F.when(k % 5 == 0, F.date_format("date", "yyyy-MM-dd'T'23:30:00-05:00"))
        .when(k % 5 == 1, F.date_format("date", "yyyyMMdd"))
        .when(k % 5 == 2, F.date_format("date", "yyyy/M/d"))
        .when(k == 3, "soon")
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
        .alias("date"),
        F.when(k == 7, " \t").when(k == 8, F.lit(None).cast("string")).otherwise(F.concat(F.lit("  "), "tenant", F.lit("\t"))).alias("tenant"),
        F.when(k == 9, "").otherwise(F.concat("source_backend", F.lit(" "))).alias("source_backend"),
        F.when(k == 11, F.lit(None).cast("string")).when(k == 12, "many").when(k == 13, F.concat(pods, F.lit(".75"))).otherwise(pods).alias("pods"),
        F.when(k == 14, F.lit(None).cast("string")).when(k > 20, (F.col("onboarded") + F.col("pods")).cast("string")).otherwise(F.col("onboarded").cast("string")).alias("onboarded"),
    )


def changed_snapshot(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """A second delivery of one year: other values, some days left out, and a
    tenant that the first one did not have."""
    s = region_snapshot(spark, sf_dir).where((F.year("date") == year) & (F.dayofmonth("date") % 9 != 4))
    s = s.withColumn("pods", F.col("pods") + F.dayofmonth("date")).withColumn("onboarded", F.col("onboarded") + 2)
    return s.unionByName(s.where(F.col("tenant") == "ASIA").withColumn("tenant", F.lit("OCEANIA")))


def day_level_costs(spark: SparkSession, sf_dir: str, anchor: str) -> DataFrame:
    """Day-level cost columns per (account, service) at one anchor day:
    cost (the day), prev_day, prev_week (7 days before), avg7 / avg30 (mean
    daily cost over the 7 / 30 days before). Input for day-level totals."""
    f = cost_fact(spark, sf_dir)
    a = F.to_date(F.lit(anchor))
    back = F.datediff(a, F.col("date"))
    w = f.where((F.col("date") <= a) & (F.col("date") >= F.date_sub(a, 30)))
    amt = F.col("amount").cast(f"decimal(18,{MONEY_SCALE})")
    base = w.groupBy("account", "service").agg(
        F.sum(F.when(back == 0, amt)).cast("double").alias("cost"),
        F.sum(F.when(back == 1, amt)).cast("double").alias("prev_day"),
        F.sum(F.when(back == 7, amt)).cast("double").alias("prev_week"),
        (F.coalesce(F.sum(F.when((back >= 1) & (back <= 7), amt)), F.lit(0)).cast("double") / 7).alias("avg7"),
        (F.coalesce(F.sum(F.when((back >= 1) & (back <= 30), amt)), F.lit(0)).cast("double") / 30).alias("avg30"),
    )
    return base.select(
        "*",
        (F.col("cost") - F.col("prev_day")).alias("delta_day"),
        (F.col("cost") - F.col("prev_week")).alias("delta_week"),
        (F.col("cost") - F.col("avg7")).alias("delta_7d"),
        (F.col("cost") - F.col("avg30")).alias("delta_30d"),
        F.try_divide(F.col("cost") - F.col("avg7"), F.col("avg7")).alias("pct_7d"),
        F.try_divide(F.col("cost") - F.col("prev_week"), F.col("prev_week")).alias("pct_week"),
    )
