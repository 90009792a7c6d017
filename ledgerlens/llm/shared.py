"""The shared folder of the session, and files in it that executors write and read."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows in an Arrow batch: texts are long, and a batch is held whole by a task.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, as a URI."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs, as pyarrow knows them)."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + urlsplit(uri).path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to spark.checkpoint.dir and read from there, so that a lost executor costs nothing above it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` different rows of ``docs`` (all that differ, if there are fewer), checkpointed.

    Rows are chosen by a hash of what they hold, so the sample does not depend
    on how the table is laid out; rows that repeat count once.
    """
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64(F.lit(1), *docs.columns), F.lit(n)) < rows) if n > rows else docs
    return checkpoint(chosen.distinct())


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, however it spells its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k, free = 0, f"_{name}"
        while free.lower() in taken:
            k += 1
            free = f"_{name}_{k}"
        taken.add(free.lower())
        out.append(free)
    return out
