"""Month prefixes: an aggregate kept beside the cost facts, from which reports read.

One row per (account, service, month), with for each day d of the month the
sum of the amounts and the number of rows of days 1..d. Every window of a cost
report is "a month, up to a day", so it reads one place of each row, and no
report scans the facts. An upsert works out the rows of the months it touches
(``sinks.tables.upsert_table(derived=...)``) and publishes both by one pointer.

A frame with these columns can be given to the report functions of
``operators.costs`` in place of facts, also after ``label_services``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start

SUMS, ROWS, MONTH = "prefix_sums", "prefix_rows", "month"
DAYS = 31


def month_prefixes(facts: DataFrame, money_scale: int | None = None) -> DataFrame:
    """Facts (date, account, service, amount) -> account, service, month, prefix_sums, prefix_rows.

    A sum is NULL where no day up to it has a known amount. With
    ``money_scale`` sums are exact decimals, otherwise doubles. Rows without a
    date lie in no window and are left out. A hot key is collapsed map-side.
    """
    kind = f"DECIMAL(28,{money_scale})" if money_scale is not None else "DOUBLE"
    upto = [f"sum(CAST(CASE WHEN day(date) <= {d} THEN amount END AS {kind}))" for d in range(1, DAYS + 1)]
    kept = f"DECIMAL(38,{money_scale})" if money_scale is not None else "DOUBLE"
    return (
        facts.where(F.col("date").isNotNull())
        .groupBy("account", "service", month_start("date").alias(MONTH))
        .agg(
            F.array(*[F.expr(e).cast(kept) for e in upto]).alias(SUMS),
            F.array(*[F.count_if(F.dayofmonth("date") <= d) for d in range(1, DAYS + 1)]).alias(ROWS),
        )
    )


def is_prefixes(df: DataFrame) -> bool:
    return SUMS in df.columns and ROWS in df.columns


def upto_day(df: DataFrame, day: Column) -> DataFrame:
    """The rows with a fact on days 1..day of their month, and the sum of those as ``amount``."""
    at = (day - 1).cast("int")
    return df.where(F.get(ROWS, at) > 0).withColumn("amount", F.get(SUMS, at))


def last_day() -> Column:
    """The last date with a fact: the first day whose count is the month's."""
    return F.date_add(MONTH, (F.array_position(ROWS, F.get(ROWS, F.lit(DAYS - 1))) - 1).cast("int"))
