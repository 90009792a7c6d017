"""Table reads and name checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def is_valid_table_name(name: str) -> bool:
    """Whether a name may stand in SQL text and paths: an ASCII identifier."""
    return isinstance(name, str) and name.isascii() and name.isidentifier()


def read_parquet(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    if not is_valid_table_name(name):
        raise ValueError(f"invalid table name: {name!r}")
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """A catalog table with an optional column list (pruned at the scan)."""
    if not is_valid_table_name(name):
        raise ValueError(f"invalid table name: {name!r}")
    df = spark.table(name)
    return df.select(*columns) if columns else df
