"""A rank over all rows without one task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order`` (sort expressions).

    The rows are dealt by ranges of the order and written once, so that the
    ranges can't change; each range counts and numbers its rows, and the counts
    of the ranges before (one number each, on the driver) are added. Rows that
    are equal in all of ``order`` meet in one range.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, total = [0] * (max(counts, default=0) + 1), 0
    for k in range(len(before)):
        before[k], total = total, total + counts.get(k, 0)
    offset = F.get(F.split(F.lit(" ".join(map(str, before))), " ").cast("array<bigint>"), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, place.cast("bigint") + offset).drop("_range")
