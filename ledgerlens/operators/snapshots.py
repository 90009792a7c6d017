"""Snapshot rows: validation, normalisation and the uniqueness checks.

A snapshot row is (date, tenant, source_backend, pods, onboarded). Raw rows
come from JSON files (see ``sources.snapshot_files``) with every field as
text and the row object kept as ``map<string,string>`` so that key presence
survives (``"total": null`` differs from a missing ``total``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_COLUMNS = ("date", "tenant", "source_backend", "pods", "onboarded")

# Date patterns tried after ISO forms: compact, day-month-name, month-first
# and year-first slashes.
DATE_PATTERNS = ("yyyyMMdd", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d")

# Rejection reasons, in the order the checks run.
REASONS = (
    "bad_date",
    "year_mismatch",
    "not_a_list",
    "not_an_object",
    "no_tenant",
    "no_total",
    "no_onboarded",
    "total_not_numeric",
    "total_negative",
    "total_not_whole",
    "onboarded_not_numeric",
    "onboarded_negative",
    "onboarded_not_whole",
)


def strip_text(col: Column) -> Column:
    """Trim all leading/trailing whitespace (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", "")


def parse_utc_day(col: Column, dtype: T.DataType | None = None) -> Column:
    """Day in UTC of a date, timestamp or text value; NULL when unparseable.

    Text forms taken: ISO date, ISO timestamp with or without offset (shifted
    to its UTC day), and the date patterns below (month first for slashes).
    """
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    s = F.trim(col.cast("string"))
    return F.coalesce(
        F.to_date(F.try_to_timestamp(s)),
        *[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in DATE_PATTERNS],
    )


def path_year(path: Column) -> Column:
    """The year named by a ``year=YYYY`` part of a path, the first one if several; else NULL."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike("^year=[0-9]{4}$"))
    return F.substring(F.get(parts, F.lit(0)), 6, 4).try_cast("int")


def _count(col: Column) -> Column:
    """A counter as BIGINT: whole-number text exactly (a double holds only 53 bits), other numbers by their whole part."""
    text = col.cast("string")
    return F.coalesce(F.trim(text).try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def normalize_snapshots(raw: DataFrame) -> DataFrame:
    """UTC day, trimmed text, numeric coercion, drop incomplete or blank rows,
    whole counters as BIGINT and onboarded cut to pods."""
    missing = [c for c in SNAPSHOT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"snapshot columns missing: {', '.join(missing)}")
    dtypes = {f.name: f.dataType for f in raw.schema.fields}
    df = raw.select(
        parse_utc_day(F.col("date"), dtypes["date"]).alias("date"),
        strip_text(F.col("tenant")).alias("tenant"),
        strip_text(F.col("source_backend")).alias("source_backend"),
        _count(F.col("pods")).alias("pods"),
        _count(F.col("onboarded")).alias("onboarded"),
    )
    df = df.dropna(subset=list(SNAPSHOT_COLUMNS)).where(
        (F.col("tenant") != "") & (F.col("source_backend") != "")
    )
    # Both sides are non-NULL here, so least() cannot skip a NULL.
    return df.select("date", "tenant", "source_backend", "pods", F.least("onboarded", "pods").alias("onboarded"))


def snapshot_conflicts(df: DataFrame) -> DataFrame:
    """(date, tenant) keys carrying more than one distinct pods or onboarded."""
    return (
        df.groupBy("date", "tenant")
        .agg(
            F.countDistinct("pods").alias("distinct_pods"),
            F.countDistinct("onboarded").alias("distinct_onboarded"),
        )
        .where((F.col("distinct_pods") > 1) | (F.col("distinct_onboarded") > 1))
    )


def snapshot_duplicates(df: DataFrame) -> DataFrame:
    """(date, tenant) keys with more than one row, even identical or from two sources."""
    return (
        df.groupBy("date", "tenant")
        .agg(F.count(F.lit(1)).alias("count_rows"))
        .where(F.col("count_rows") > 1)
    )


def check_unique(df: DataFrame) -> None:
    """Fail on conflicting, then on duplicated (date, tenant) keys."""
    conflict = snapshot_conflicts(df).first()
    if conflict is not None:
        raise ValueError(
            "snapshots with different values for one date/tenant: "
            f"date={conflict['date']} tenant={conflict['tenant']}"
        )
    dup = snapshot_duplicates(df).first()
    if dup is not None:
        raise ValueError(
            f"several snapshots for one date/tenant: date={dup['date']} tenant={dup['tenant']}"
        )


def one_per_key(df: DataFrame) -> DataFrame:
    """One row per (date, tenant), with ``n`` (its rows) and ``conflict`` (their
    counters differ): the uniqueness checks as part of an aggregation."""
    differ = (F.min("pods") != F.max("pods")) | (F.min("onboarded") != F.max("onboarded"))
    row = F.max(F.struct("source_backend", "pods", "onboarded"))
    found = df.groupBy("date", "tenant").agg(row.alias("_r"), F.count(F.lit(1)).alias("n"), differ.alias("conflict"))
    return found.select("date", "tenant", "_r.source_backend", "_r.pods", "_r.onboarded", "n", "conflict")


class LoadGate:
    """The checks of a snapshot load, observed while its rows are written.

    Wrap each step's frame, write the last one, then ask :meth:`check`: it
    fails with the first broken rule (a document that is no object, invalid
    rows by reason, conflicting keys, doubled keys), as the single checks do,
    and else gives the load's figures. No frame is read twice and no check is a
    job of its own. Counts are of the tasks that ran: a task repeated after a
    lost executor can count its rows twice, which changes no verdict.
    """

    def __init__(self, sources: Sequence[str]):
        self.sources = list(sources)
        self._files, self._rows, self._keys = Observation(), Observation(), Observation()

    def files(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._files, F.min(F.when(~F.col("top_is_object"), F.col("path"))).alias("broken"))

    def rows(self, validated: DataFrame) -> DataFrame:
        reasons = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
        per = [F.count_if(F.col("reason").isNull() & (F.col("source_backend") == s)).alias(f"rows of {s}") for s in self.sources]
        return validated.observe(self._rows, *reasons, *per)

    def keys(self, unique: DataFrame) -> DataFrame:
        key = F.struct(F.col("date").cast("string"), "tenant")
        first = [F.min(F.when(c, key)).alias(n) for n, c in (("conflict", F.col("conflict")), ("twice", F.col("n") > 1))]
        return unique.observe(self._keys, *first, F.min("date").alias("min_date"), F.max("date").alias("max_date"))

    def check(self) -> dict:
        broken = self._files.get["broken"]
        if broken is not None:
            raise ValueError(f"file {broken} must hold a JSON object at the top level")
        seen = self._rows.get
        bad = ", ".join(f"{r}={seen[r]}" for r in sorted(REASONS) if seen[r])
        if bad:
            raise ValueError(f"invalid snapshot rows: {bad}")
        keys = self._keys.get
        for name, what in (("conflict", "snapshots with different values for one date/tenant"), ("twice", "several snapshots for one date/tenant")):
            if keys[name] is not None:
                raise ValueError(f"{what}: date={keys[name][0]} tenant={keys[name][1]}")
        rows = {s: seen[f"rows of {s}"] for s in self.sources}
        return {"rows": rows, "min_date": keys["min_date"], "max_date": keys["max_date"]}


def _is_number_text(s: Column) -> Column:
    return s.try_cast("double").isNotNull() & ~F.lower(F.trim(s)).isin("nan", "inf", "-inf", "infinity", "-infinity", "+inf")


def validate_rows(rows: DataFrame) -> DataFrame:
    """Add a ``reason`` column (NULL for a good row) and the parsed fields.

    ``rows`` has ``date_text``, ``value_is_list`` (optional), ``row_is_object``
    (optional), ``row`` (map<string,string>) and optionally ``path``. The
    total is ``total`` when the key is present (even with a null value,
    which is then an error), else ``pods``.
    """
    cols = set(rows.columns)
    row = F.col("row")
    date = parse_utc_day(F.col("date_text"))
    year = path_year(F.col("path")) if "path" in cols else F.lit(None).cast("int")
    is_list = F.col("value_is_list") if "value_is_list" in cols else F.lit(True)
    is_object = F.col("row_is_object") if "row_is_object" in cols else row.isNotNull()
    tenant = strip_text(row["tenant"])
    total = F.when(F.map_contains_key(row, "total"), row["total"]).otherwise(row["pods"])
    onboarded = row["onboarded"]
    total_n = total.try_cast("double")
    onb_n = onboarded.try_cast("double")
    reason = (
        F.when(date.isNull(), "bad_date")
        .when(year.isNotNull() & (F.year(date) != year), "year_mismatch")
        .when(~is_list, "not_a_list")
        .when(~is_object, "not_an_object")
        .when(tenant.isNull() | (tenant == ""), "no_tenant")
        .when(total.isNull(), "no_total")
        .when(onboarded.isNull(), "no_onboarded")
        .when(~_is_number_text(total), "total_not_numeric")
        .when(total_n < 0, "total_negative")
        .when(total_n != F.floor(total_n), "total_not_whole")
        .when(~_is_number_text(onboarded), "onboarded_not_numeric")
        .when(onb_n < 0, "onboarded_negative")
        .when(onb_n != F.floor(onb_n), "onboarded_not_whole")
    )
    good = reason.isNull()
    pods = F.when(good, _count(total))
    return rows.select(
        F.when(good, date).alias("date"),
        F.when(good, tenant).alias("tenant"),
        F.col("source_backend"),
        pods.alias("pods"),
        F.when(good, F.least(_count(onboarded), pods)).alias("onboarded"),
        reason.alias("reason"),
    )


def require_valid(validated: DataFrame) -> DataFrame:
    """Fail listing reasons and counts if any row is bad; else the good rows."""
    bad = validated.where(F.col("reason").isNotNull()).groupBy("reason").count().collect()
    if bad:
        detail = ", ".join(f"{r['reason']}={r['count']}" for r in sorted(bad, key=lambda r: r["reason"]))
        raise ValueError(f"invalid snapshot rows: {detail}")
    return validated.select(*SNAPSHOT_COLUMNS)


def snapshot_load_summary(df: DataFrame) -> DataFrame:
    """Per source: files (distinct years), rows, first and last day."""
    return df.groupBy("source_backend").agg(
        F.countDistinct(F.year("date")).alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
