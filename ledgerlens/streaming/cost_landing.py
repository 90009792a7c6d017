"""Incremental cost load as a Structured Streaming job.

New page files in the landing folder are picked up once (the file source
keeps the list of files it has taken in its checkpoint), flattened, and
upserted by (date, account, service) into the month-partitioned cost table
inside ``foreachBatch``. With ``trigger(availableNow=True)`` a daily run
takes everything new and stops; a re-run after a failure resumes from the
checkpoint, and the keyed upsert makes a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import upsert_table
from ..sources.cost_pages import SEQ, flatten_pages, page_columns, page_reader

KEYS = ("date", "account", "service")


def cost_page_stream(spark: SparkSession, landing: str, account: str | None = None) -> DataFrame:
    pages = page_reader(spark.readStream).json(landing).select(*page_columns())
    return flatten_pages(pages, account)


def start_cost_load(
    spark: SparkSession,
    landing: str,
    table_path: str,
    checkpoint: str,
    account: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the load; ``checkpoint`` must be a shared folder on a cluster."""

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch can hold a key several times: the page that came last wins.
        upsert_table(batch.sparkSession, table_path, [batch], KEYS, seq_col=SEQ)

    writer = cost_page_stream(spark, landing, account).writeStream.foreachBatch(upsert_batch).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
