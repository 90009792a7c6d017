"""Text/label functions against Python's own formatting, metric properties,
and plan shape (one fact scan, pushed date filters, no Python in the plan)."""

import datetime as dt
import re
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import costs as C

SCHEMA = "date date, account string, service string, amount double"


def _written_out(number, places, sign=False):
    """Number text built digit group by digit group from the exact binary value."""
    exact = Decimal(number).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
    whole, _, rest = f"{abs(exact):f}".partition(".")
    lead = len(whole) % 3 or 3
    groups = [whole[:lead], *(whole[i : i + 3] for i in range(lead, len(whole), 3))]
    mark = "-" if exact.is_signed() else "+" if sign else ""
    return f"{mark}{'.'.join(groups)},{rest}"


def test_number_text(spark):
    expected = {
        0.0: ("0,00", "+0,0"),
        1.005: ("1,00", "+1,0"),
        2.675: ("2,67", "+2,7"),
        1234567.125: ("1.234.567,12", "+1.234.567,1"),
        -9876.5: ("-9.876,50", "-9.876,5"),
        0.125: ("0,12", "+0,1"),
        1e9 + 0.5: ("1.000.000.000,50", "+1.000.000.000,5"),
        12.25: ("12,25", "+12,2"),
    }
    df = spark.createDataFrame([(v,) for v in expected], "x double")
    got = df.select(
        "x",
        X.format_number_it("x", 2).alias("a"),
        X.format_number_it("x", 1, sign=True).alias("b"),
        X.format_number_it(F.lit(None).cast("double"), 2).alias("c"),
    ).collect()
    assert {r["x"]: (r["a"], r["b"]) for r in got} == expected
    assert {r["c"] for r in got} == {""}


def test_cell_text_and_classes(spark):
    df = spark.createDataFrame([(1234.5, 0.1234), (10.0, None), (None, 0.5), (-3.0, -0.5)], "v double, p double")
    rows = df.select(X.cost_cell_text("v", "p").alias("t"), X.cost_pct_class("p").alias("c")).collect()
    assert [r["t"] for r in rows] == ["1.234,50\n+12,3%", "10,00", "", "-3,00\n-50,0%"]
    assert [r["c"] for r in rows] == ["pos", "", "pos", "neg"]
    t = spark.createDataFrame([(1.0, None), (0.0, 5.0), (None, -0.1), (None, None)], "d double, p double")
    assert [r[0] for r in t.select(X.trend_class("d", "p")).collect()] == ["pos", "neutral", "neg", ""]


def test_pod_texts(spark):
    df = spark.createDataFrame([(0.004, 80.0, 100.0), (0.5, 1.0, 400.0), (None, None, 0.0)], "p double, v double, t double")
    rows = df.select(
        X.pct_text("p").alias("p"), X.share_pct_text("v", "t").alias("s"), X.share_class("v", "t").alias("c")
    ).collect()
    assert [r["p"] for r in rows] == ["+0,4%", "+50%", ""]
    assert [r["s"] for r in rows] == ["80%", "0,2%", ""]
    assert [r["c"] for r in rows] == ["pos", "neg", "neutral"]
    z = spark.createDataFrame([(0.4,), (-0.4,), (1234.0,)], "x double")
    assert [r[0] for r in z.select(X.format_count_it("x", 0, sign=True)).collect()] == ["0", "0", "+1.234"]


def test_labels(spark):
    df = spark.createDataFrame([("current", dt.date(2024, 3, 31)), ("month:2024-01-01", dt.date(2024, 1, 1)), ("x", None)],
                               "o string, a date")
    rows = df.select(X.period_label("o").alias("l"), *X.row_label_columns("a")).collect()
    assert [r["l"] for r in rows] == ["Stato attuale", "Gennaio 2024", "x"]
    assert rows[0]["label_mtd"] == "Marzo 2024" and rows[0]["label_prev4_mtd"] == "Novembre 2023"
    assert rows[0]["label_avg6"] == "Media 6M"
    assert rows[2]["label_prev_mtd"] == "Mese precedente"


def _facts(spark):
    rows = []
    for m in range(1, 13):
        for day in (1, 15, 28):
            rows.append((dt.date(2023, m, day), "acc", "svc", float(m * 10 + day)))
            rows.append((dt.date(2023, m, day), "acc", "other", 1.0))
    rows.append((dt.date(2023, 12, 5), None, "svc", 7.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_full_month_equals_capped_at_month_end(spark):
    f = _facts(spark)
    capped = {(r["account"], r["service"]): r for r in C.period_metrics(f, "2023-12-31").collect()}
    full = {(r["account"], r["service"]): r for r in C.period_metrics_for_month(f, "2023-12-01").collect()}
    assert capped.keys() == full.keys()
    for k in capped:
        for col in C.METRIC_COLUMNS:
            assert capped[k][col] == full[k][col], (k, col)
    # NULL-key row: current value shown, earlier periods NULL.
    assert capped[(None, "svc")]["mtd"] == 7.0 and capped[(None, "svc")]["prev_mtd"] is None


def test_per_account_anchors_match_single_anchor(spark):
    f = _facts(spark)
    anchors = spark.createDataFrame([("acc", dt.date(2023, 11, 15))], "account string, anchor_date date")
    many = {r["service"]: r for r in C.period_metrics_for_anchors(f, anchors).collect()}
    one = {r["service"]: r for r in C.period_metrics(f, "2023-11-15").where("account = 'acc'").collect()}
    assert many.keys() == one.keys()
    for s in one:
        for col in C.METRIC_COLUMNS:
            assert many[s][col] == one[s][col]


def test_totals_are_sums_of_services(spark):
    m = C.period_metrics(_facts(spark), "2023-12-28").where("account IS NOT NULL")
    t = C.service_totals(m).first()
    rows = m.collect()
    assert t["mtd"] == sum(r["mtd"] for r in rows)
    assert abs(t["pct_prev"] - (t["mtd"] - t["prev_mtd"]) / t["prev_mtd"]) < 1e-12


def test_period_metrics_plan_has_one_pruned_scan(spark, scratch):
    path = f"{scratch}/facts"
    _facts(spark).withColumn("month", F.trunc("date", "MM")).write.partitionBy("month").parquet(path)
    facts = spark.read.parquet(path)
    df = C.period_metrics(facts, "2023-06-15", money_scale=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert len(re.findall(r"^\(\d+\) Scan parquet", formatted, re.M)) == 1
    assert "GreaterThanOrEqual(date,2022-06-01), LessThanOrEqual(date,2023-06-15)" in formatted
    assert re.search(r"PartitionFilters: \[.*month#\d+ >= 2022-06-01.*month#\d+ <= 2023-06-01", formatted)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert df.count() == 2


def test_number_text_random_values_match_python(spark):
    import random

    rng = random.Random(5)
    vals = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(700)]
    vals += [round(rng.uniform(-100, 100), 3) for _ in range(700)]  # many half-way cases
    vals += [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 9) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select(
        "x", X.format_number_it("x", 2).alias("a"), X.format_number_it("x", 1, sign=True).alias("b")
    ).collect()
    for r in rows:
        assert r["a"] == _written_out(r["x"], 2), r
        assert r["b"] == _written_out(r["x"], 1, sign=True), r


def test_hot_account_is_reduced_before_the_shuffle(spark):
    # One account holds most rows: the plan must aggregate partially
    # (map side) and shuffle once, on (account, service).
    rows = [(dt.date(2024, 3, 1) + dt.timedelta(days=i % 28), "hot", f"s{i % 3}", 1.0) for i in range(3000)]
    rows += [(dt.date(2024, 3, 2), "cold", "s0", 2.0)]
    df = C.period_metrics(spark.createDataFrame(rows, SCHEMA), "2024-03-28", money_scale=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "partial_sum" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(account#\d+, service#\d+", plan)) == 1
    got = {r["account"]: r["mtd"] for r in df.where("service = 's0'").collect()}
    assert got == {"hot": 1000.0, "cold": 2.0}


def test_metric_choice_and_month_names(spark):
    import pytest

    from ledgerlens.operators import trends as T

    assert T.resolve_metric("total") == "total_pods" and T.resolve_metric("onboarded") == "onboarded_pods"
    with pytest.raises(ValueError):
        T.resolve_metric("pods")
    names = ("january", "february", "march", "april", "may", "june", "july", "august",
             "september", "october", "november", "december")
    row = spark.createDataFrame([(dt.date(2001, 3, 9),)], "d date").select(
        X.month_label("d").alias("it"), X.month_label("d", names).alias("en")
    ).first()
    assert (row["it"], row["en"]) == ("Marzo 2001", "March 2001")
