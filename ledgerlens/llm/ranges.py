"""Ranges of rows whose limits follow from the rows alone.

Spark's own range partitioning samples its limits anew in every run and for
every layout. Here the limits are keys of the table, chosen by a hash of the key,
so the same rows are cut at the same places whatever their partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most limits, about, that the driver holds.
MOST = 1 << 15

Key = tuple[int, int, int]


def limits(keys: DataFrame, rows: int, ranges: int) -> list[Key]:
    """About ``ranges`` limits from ``keys`` (has, id, h: longs) of a table of ``rows`` rows, in order."""
    ranges = min(ranges, MOST)
    if rows == 0 or ranges < 2:
        return []
    every = max(1, rows // ranges)
    chosen = keys.where(F.pmod(F.xxhash64("has", "id", "h", F.lit(3)), F.lit(every)) == 0).distinct().collect()
    return sorted((r.has, r.id, r.h) for r in chosen)


def range_of(cuts: list[Key], key: tuple[Column, Column, Column]) -> Column:
    """The number of limits that are not above the key, by binary search."""
    if not cuts:
        return F.lit(0)
    column = [F.split(F.lit(" ".join(str(c[j]) for c in cuts)), " ").cast("array<bigint>") for j in range(3)]

    def reached(at: Column) -> Column:
        a, b, c = (F.get(x, at) for x in column)
        return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))

    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda t, s: F.when(F.coalesce(reached(t + s - 1), F.lit(False)), t + s).otherwise(t))
