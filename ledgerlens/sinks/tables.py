"""Keyed upserts, range replacement, whole-table replacement and staged
publishing, as DataFrame merges and writes of new folders. Live files are never
overwritten: a write becomes visible by its pointer (see ``versions``)."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

#: The name of the only table of a folder.
_ROWS = "rows"

_BATCH = "_ll_batch"
_SEQ = "_ll_seq"


def _any_null(keys: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond


def _tagged(existing: DataFrame | None, batches: Sequence[DataFrame], columns: Sequence[str], seq_col: str | None) -> DataFrame:
    """All rows with their batch number (0: existing) and their place in it."""
    seq = F.col(seq_col) if seq_col else F.lit(0).cast("bigint")
    out = None
    for i, b in enumerate(batches, start=1):
        part = b.select(*columns, F.lit(i).alias(_BATCH), seq.alias(_SEQ))
        out = part if out is None else out.unionByName(part)
    if existing is not None:
        none = F.lit(None).cast(out.schema[_SEQ].dataType)
        out = existing.select(*columns, F.lit(0).alias(_BATCH), none.alias(_SEQ)).unionByName(out)
    return out


def _winners(tagged: DataFrame, columns: Sequence[str], key_cols: Sequence[str], batches: int, ordered: bool) -> DataFrame:
    own_group = F.when(_any_null(key_cols), F.struct(F.col(_BATCH), F.monotonically_increasing_id()))
    others = [c for c in columns if c not in key_cols]
    counts = [] if ordered else [F.count_if(F.col(_BATCH) == i).alias(f"_n{i}") for i in range(1, batches + 1)]
    found = tagged.withColumn("_ll_own", own_group).groupBy(*key_cols, "_ll_own").agg(F.max_by(F.struct(*others), F.struct(_BATCH, _SEQ)).alias("_w"), *counts)
    row = F.col("_w")
    if counts:
        twice = F.greatest(*[F.col(f"_n{i}") for i in range(1, batches + 1)], F.lit(0).cast("bigint")) > 1
        row = F.when(twice, F.raise_error(F.lit("a batch holds a key twice; name its seq_col")).cast(found.schema["_w"].dataType)).otherwise(row)
        found = found.withColumn("_w", row)
    return found.select(*key_cols, *[F.col(f"_w.{c}").alias(c) for c in others]).select(*columns)


def merge_latest(
    existing: DataFrame | None,
    batches: Sequence[DataFrame],
    key_cols: Sequence[str],
    seq_col: str | None = None,
) -> DataFrame:
    """Upsert by key: the last row in arrival order wins.

    Arrival order is (batch number, then ``seq_col`` within a batch). A batch
    without a ``seq_col`` holds each key once; if it does not, the query fails,
    as nothing says which row came last. Existing rows that no batch touches
    are kept. Rows with a NULL key part never collide with anything (as with
    a SQL UNIQUE constraint) and all pass through. Columns follow the
    existing table's order.

    One pass and one aggregation: winners are picked with ``max_by`` over
    (batch, seq), a partial aggregation, so many duplicates of one key are
    reduced map-side; a row with a NULL key part gets its own group through
    a per-row id, so it passes through the same aggregation.
    """
    columns = list(existing.columns if existing is not None else [c for c in batches[0].columns if c != seq_col])
    return _winners(_tagged(existing, batches, columns, seq_col), columns, key_cols, len(batches), seq_col is not None)


def replace_range(
    existing: DataFrame,
    new_rows: DataFrame,
    column: str,
    lo: dt.date,
    hi: dt.date,
    key_cols: Sequence[str],
) -> DataFrame:
    """Delete rows with ``lo <= column <= hi``, then upsert ``new_rows``.

    Empty ``new_rows`` still deletes the range; new rows outside the range
    are written too (they replace by key).
    """
    c = F.col(column)
    kept = existing.where((c < F.lit(lo)) | (c > F.lit(hi)) | c.isNull())
    return merge_latest(kept, [new_rows], key_cols)


def replace_all(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> int:
    """Replace every row of a table: a new version is written and the table's
    pointer moves to it (:func:`read_replaced`). A failure leaves the rows as
    they were. Returns the version's number."""
    return publish_tables({_ROWS: df}, path, partition_cols=partition_cols)


def read_replaced(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that :func:`replace_all` wrote last; None if there are none yet."""
    return read_published(spark, path, _ROWS)


#: A derived table: of the merged rows of some partitions, rows that keep the partition column.
Derive = Callable[[DataFrame], DataFrame]


def upsert_table(
    spark: SparkSession,
    path: str,
    batches: Sequence[DataFrame],
    key_cols: Sequence[str],
    partition_col: str = "month",
    partition_expr: Column | None = None,
    seq_col: str | None = None,
    derived: Mapping[str, Derive] | None = None,
    attempts: int = 3,
) -> DataFrame:
    """Upsert batches into a Parquet table partitioned by ``partition_col``.

    The batches are worked out once, into a staging folder laid out by
    partition; its folder names are the touched partitions (a NULL partition
    is one of them). Their live rows are read, merged and written to the
    folder of a new version, and the pointer that names the live version of
    each partition moves last. A failure leaves the table as it was; a replay
    gives the same rows. Returns the merged rows of the touched partitions.

    ``derived`` names tables kept beside the rows (:func:`read_derived`): of
    the touched partitions, and of those that have none yet, they are worked
    out from the merged rows and move with the same pointer.

    The pointer moves only from the state that the merge has read. If another
    job has published meanwhile, the commit goes on top of its state where it
    touched none of these partitions; else the staged batches are merged again,
    ``attempts`` times at most.
    """
    part = partition_expr if partition_expr is not None else F.trunc("date", "MM")
    folder = versions.Folder(spark, path)
    columns = [c for c in batches[0].columns if c not in (partition_col, seq_col)]
    tagged = _tagged(None, [b.withColumn(partition_col, part) for b in batches], [*columns, partition_col], seq_col)
    staging = f"_staging/{uuid.uuid4().hex}"  # a folder that no stopped job has begun
    tagged.write.partitionBy(partition_col).parquet(f"{path}/{staging}")
    touched = [n for n in folder.names(staging) if n.startswith(f"{partition_col}=")]
    row_schema = T.StructType([f for f in tagged.schema.fields if f.name not in (_BATCH, _SEQ)])
    if not touched:
        folder.remove(staging)
        return spark.createDataFrame([], row_schema)
    try:
        for _ in range(attempts):
            seen = versions.latest(spark, path)
            parts = seen.state["parts"] if seen.state else {}
            version = f"{seen.number:012d}-{uuid.uuid4().hex[:12]}"
            staged = spark.read.schema(tagged.schema).parquet(f"{path}/{staging}")
            live = [f"{path}/v={parts[n]}/{n}" for n in touched if n in parts]
            if live:
                existing = _read_parts(spark, path, live, row_schema)
                none = F.lit(None).cast(tagged.schema[_SEQ].dataType)
                staged = existing.select(*columns, partition_col, F.lit(0).alias(_BATCH), none.alias(_SEQ)).unionByName(staged)
            merged = _winners(staged, [*columns, partition_col], key_cols, len(batches), seq_col is not None)
            merged.write.partitionBy(partition_col).mode("errorifexists").parquet(f"{path}/v={version}")
            written = [n for n in folder.names(f"v={version}") if n.startswith(f"{partition_col}=")]
            if written != touched:
                raise RuntimeError(f"{path}: version {version} holds {written}, not {touched}")
            now = {n: f"{path}/v={version}/{n}" for n in touched}
            kept = {n: f"{path}/v={v}/{n}" for n, v in parts.items() if n not in now}
            known = (seen.state or {}).get("derived", {})
            more = {}
            for name, derive in (derived or {}).items():
                old = known.get(name, {"parts": {}})["parts"]
                work = {**now, **{n: at for n, at in kept.items() if n not in old}}
                more[name] = _write_derived(spark, path, name, version, derive(_read_parts(spark, path, sorted(work.values()), row_schema)), partition_col, list(work))
            if _commit_parts(spark, path, seen, touched, version, json.loads(row_schema.json()), more):
                return _read_parts(spark, path, list(now.values()), row_schema)
            for name in (f"v={version}", *(f"d={d}/v={version}" for d in more)):
                folder.remove(name)
        raise versions.Conflict(f"{path}: other jobs published the same partitions {attempts} times meanwhile")
    finally:
        folder.remove(staging)


def _write_derived(spark: SparkSession, path: str, name: str, version: str, rows: DataFrame, partition_col: str, of: Sequence[str]) -> dict:
    """Where the derived rows of each partition are (None: it has none), and their schema."""
    place = f"d={name}/v={version}"
    rows.write.partitionBy(partition_col).mode("errorifexists").parquet(f"{path}/{place}")
    there = set(versions.Folder(spark, path).names(place))
    return {"parts": {n: version if n in there else None for n in of}, "schema": json.loads(rows.schema.json())}


def _commit_parts(spark: SparkSession, path: str, seen: versions.Head, touched: Sequence[str], version: str, schema: dict, derived: Mapping[str, dict]) -> bool:
    """Moves the pointer for the touched partitions; False if another job has changed one of them since ``seen``."""
    read = seen.state["parts"] if seen.state else {}
    at = seen
    while True:
        state = at.state or {"parts": {}}
        tables = {}
        for name in {*state.get("derived", {}), *derived}:
            before = state.get("derived", {}).get(name, {"parts": {}})
            # What this write did not derive is no longer there for its partitions.
            parts = {n: v for n, v in before["parts"].items() if n not in touched} | derived.get(name, {"parts": {}})["parts"]
            tables[name] = {"parts": parts, "schema": derived.get(name, before)["schema"]}
        new = {"parts": state["parts"] | {n: version for n in touched}, "schema": schema, "derived": tables}
        try:
            versions.commit(spark, path, at.number, new)
            return True
        except versions.Conflict:
            at = versions.latest(spark, path)
            theirs = at.state["parts"] if at.state else {}
            used = {*touched, *(n for d in derived.values() for n in d["parts"])}
            if any(theirs.get(n) != read.get(n) for n in used):
                return False


def _read_parts(spark: SparkSession, path: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of partition folders of several versions, with partition pruning."""
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("v")


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of a table written by ``upsert_table``; None if there is none yet."""
    state = versions.head(spark, path)
    if state is None:
        return None
    return _read_parts(spark, path, [f"{path}/v={v}/{n}" for n, v in sorted(state["parts"].items())], T.StructType.fromJson(state["schema"]))


def read_derived(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of a derived table of ``upsert_table``; None if nothing is loaded yet.

    Fails where a partition was loaded without it."""
    state = versions.head(spark, path)
    if state is None:
        return None
    table = state.get("derived", {}).get(name)
    lacking = sorted(n for n in state["parts"] if table is None or n not in table["parts"])
    if lacking:
        raise RuntimeError(f"{path}: {name} lacks {', '.join(lacking)}; load with derived to work them out")
    schema = T.StructType.fromJson(table["schema"])
    places = [f"{path}/d={name}/v={v}/{n}" for n, v in sorted(table["parts"].items()) if v is not None]
    if not places:
        return spark.createDataFrame([], schema)
    return _read_parts(spark, f"{path}/d={name}", places, schema)


_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Formats that are read by the older source interface, which knows no aggregates.
_OLDER = "spark.sql.sources.useV1SourceList"


def _footer_frame(spark: SparkSession, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows that are only counted, or asked for the least and greatest of a
    date or number: Spark takes those from the footers and reads no row group."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    older = spark.conf.get(_OLDER)
    spark.conf.set(_OLDER, ",".join(f for f in older.split(",") if f != "parquet"))
    try:
        return spark.read.schema(schema).parquet(*folders)
    finally:
        spark.conf.set(_OLDER, older)


def stored_summary(spark: SparkSession, path: str, column: str = "date") -> DataFrame | None:
    """total_rows, min_date and max_date of a table written by ``upsert_table``,
    from the footers of its files; None if there is no table yet."""
    state = versions.head(spark, path)
    if state is None:
        return None
    schema = T.StructType([T.StructField(column, T.StructType.fromJson(state["schema"])[column].dataType)])
    # Files whose dates are all NULL have no extremes in their footers; they are in the NULL partition.
    dated = [f"{path}/v={v}/{n}" for n, v in sorted(state["parts"].items()) if not n.endswith(f"={_NULL_PARTITION}")]
    undated = [f"{path}/v={v}/{n}" for n, v in state["parts"].items() if n.endswith(f"={_NULL_PARTITION}")]
    parts = []
    if dated:
        parts.append(_footer_frame(spark, dated, schema).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")))
    if undated:
        none = F.lit(None).cast(schema[column].dataType)
        parts.append(_footer_frame(spark, undated, schema).agg(F.count("*").alias("n")).select("n", none.alias("lo"), none.alias("hi")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.agg(F.sum("n").alias("total_rows"), F.min("lo").alias("min_date"), F.max("hi").alias("max_date"))


def latest_published(spark: SparkSession, base: str, name: str, column: str, seen: versions.Head | None = None) -> object | None:
    """The greatest value of a date or number column of a published table, from the
    footers of its files; None without a table or a value."""
    state = (seen or versions.latest(spark, base)).state
    if state is None or name not in state["tables"]:
        return None
    folder = f"{base}/{state['tables'][name]}"
    schema = T.StructType([spark.read.parquet(folder).schema[column]])
    try:
        return _footer_frame(spark, [folder], schema).agg(F.max(column)).first()[0]
    except Exception as e:
        if "No min/max found" not in str(e):
            raise
        return spark.read.parquet(folder).agg(F.max(column)).first()[0]  # a file with NULLs alone


def publish_tables(frames: Mapping[str, DataFrame], base: str, seen: versions.Head | None = None, partition_cols: Sequence[str] = ()) -> int:
    """Staged publish of tables that belong together: each is written to the
    folder of a new version and read back, then one pointer moves for all.
    A failure in between leaves all live tables untouched. ``seen`` is the
    state from which the frames were worked out: if another job has published
    since, Conflict is raised and its tables stay. Returns the version's number."""
    spark = next(iter(frames.values())).sparkSession
    number = (seen or versions.latest(spark, base)).number
    tables = {}
    for name, df in frames.items():
        tables[name] = f"v{number:08d}-{uuid.uuid4().hex}/{name}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(f"{base}/{tables[name]}")
        if sorted(spark.read.parquet(f"{base}/{tables[name]}").columns) != sorted(df.columns):
            raise RuntimeError(f"published schema differs in {base}/{tables[name]}")
    versions.commit(spark, base, number, {"tables": tables})
    return number


def read_published(spark: SparkSession, base: str, name: str, seen: versions.Head | None = None) -> DataFrame | None:
    """A published table; None if it was never published. A job that reads
    several tables passes the state it has ``seen`` (``versions.latest``), so
    that all are of one version."""
    state = (seen or versions.latest(spark, base)).state
    if state is None or name not in state["tables"]:
        return None
    return spark.read.parquet(f"{base}/{state['tables'][name]}")


def publish_export(write: Callable[[str], None], spark: SparkSession, path: str) -> str:
    """Files written (``write(folder)``) to the folder of a new version, which the pointer then names."""
    number = versions.latest(spark, path).number
    place = f"v{number:08d}-{uuid.uuid4().hex}/csv"
    write(f"{path}/{place}")
    versions.commit(spark, path, number, {"export": place})
    return f"{path}/{place}"


def export_csv(df: DataFrame, path: str) -> str:
    """Report export as CSV with a header row, published by pointer. Returns the folder (also :func:`exported`)."""
    return publish_export(df.write.mode("errorifexists").option("header", True).csv, df.sparkSession, path)


def exported(spark: SparkSession, path: str) -> str | None:
    """The folder of the export that was published last; None if there is none."""
    state = versions.head(spark, path)
    return None if state is None else f"{path}/{state['export']}"
