"""As-of joins: for every request the last row of its key at or before its time.

Rows and requests of a key are merged in time order, but a key is not one task:
time is cut into blocks (months), each (key, block) is merged by itself, and
what a block takes over from earlier ones is one row per (key, block), found in
a window over the blocks. So a key that holds most rows is spread over as many
tasks as it has months, and no row meets more than the requests of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.ratio import safe_ratio


def asof_join(
    requests: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: Sequence[str],
    block: Callable[[str], Column] = month_start,
) -> DataFrame:
    """``requests`` with the columns ``payload`` of the last of ``rows`` with the
    same ``keys`` (none: all rows) and a ``time`` not after the request's; NULL
    where there is none. NULL keys match each other; a NULL time matches nothing.
    Of several rows at one time the one with the greatest payload counts.
    ``block`` cuts time into parts that follow each other.
    """
    taken = F.struct(*[F.col(c) for c in payload])
    latest = rows.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(taken).alias("_taken"))
    extra = [c for c in requests.columns if c not in (*keys, time)]
    asked = requests.select(*keys, time, F.struct(F.lit(True).alias("is"), *extra).alias("_asked"))
    both = asked.unionByName(latest, allowMissingColumns=True).withColumn("_block", block(time))
    order = Window.partitionBy(*keys, "_block").orderBy(F.col(time), F.col("_asked").isNotNull())
    within = both.withColumn("_within", F.last("_taken", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The last row of every block, and the blocks in which something is asked.
    ends = latest.withColumn("_block", block(time)).groupBy(*keys, "_block").agg(F.max_by("_taken", time).alias("_end"))
    blocks = ends.unionByName(asked.select(*keys, block(time).alias("_block")).distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy(*keys, "_block").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = F.col("_block").eqNullSafe(F.col("_k_block"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = F.when(F.col(time).isNotNull(), F.coalesce("_within", "_carried"))
    joined = within.where(F.col("_asked").isNotNull()).join(carried, same, "left").withColumn("_found", found)
    return joined.select(*keys, time, *[F.col(f"_asked.{c}").alias(c) for c in extra], *[F.col(f"_found.{c}").alias(c) for c in payload])


def last_days_rows(daily: DataFrame, value_col: str = "total_pods", window_days: int = 30, days: int = 60) -> DataFrame:
    """The 30-day row of every tenant as of every day, in one job.

    As of a day, the report looks at the ``days`` days up to it. Its latest
    observed day (of any tenant) is compared with ``window_days`` earlier: the
    value is the tenant's last one at or before the day, 0 if it has none in the
    window. Columns: as_of, tenant, latest_date, value, baseline_value, delta,
    pct; a row for each tenant with a value in the window, for every calendar day
    from the first to the last.
    """
    d = daily.select("date", "tenant", F.col("total_pods").try_cast("double").alias("_total"), F.col(value_col).try_cast("double").alias("value"))
    d = d.dropna(subset=["date", "tenant", "_total", "value"]).groupBy("date", "tenant").agg(F.max("value").alias("value"))
    observed = d.select("date").distinct()
    span = observed.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    latest = asof_join(calendar, observed.withColumn("latest_date", F.col("date")), [], "date", ["latest_date"])
    # A tenant is in the report of a day from each of its rows to days - 1 later: its runs of such days.
    w = Window.partitionBy("tenant").orderBy("date")
    until = F.least(F.date_add("date", days - 1), F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.date_add("date", days - 1)))
    shown = d.select("tenant", F.sequence("date", until).alias("_days")).select("tenant", F.explode("_days").alias("as_of"))
    asked = shown.join(latest.select(F.col("date").alias("as_of"), "latest_date"), "as_of")
    kept = d.withColumn("at", F.col("date"))
    first = F.date_sub("as_of", days - 1)

    def value_at(frame: DataFrame, time: Column, name: str) -> DataFrame:
        out = asof_join(frame.withColumn("date", time), kept, ["tenant"], "date", ["value", "at"])
        known = F.when(F.col("at") >= first, F.col("value"))
        return out.withColumn(name, F.coalesce(known, F.lit(0.0))).drop("date", "value", "at")

    out = value_at(asked, F.col("latest_date"), "_now")
    out = value_at(out, F.date_sub("latest_date", window_days), "baseline_value")
    change = F.col("_now") - F.col("baseline_value")
    return out.select("as_of", "tenant", "latest_date", F.col("_now").alias("value"), "baseline_value", change.alias("delta"), safe_ratio(change, "baseline_value").alias("pct"))
