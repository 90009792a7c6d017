"""A training corpus from raw documents: known languages, no near duplicates, no benchmark text, no secrets, packed.

Each stage is one operator of ``ledgerlens.llm`` over all rows of its input; all
but the last return the columns of ``documents``. ``run`` writes every stage's
rows as Parquet in the shared folder and reads them again, so a lost executor
never repeats an earlier stage.

Stages: ``language`` learns from the input's own labelled rows and drops texts
without a letter and texts whose known share is less than ``LEAST_KNOWN`` of the
median share of the texts labelled with their language. ``near_dedup`` keeps the document with the
least doc_id of each class. ``decontamination`` drops documents that are
contaminated by 5 % of their words or more. ``secrets`` keeps every document and
replaces the spans found; n_chars follows the text. ``packing`` gives the pieces
and their places in sequences of at most 2048 ids.

Nulls, empty and repeated rows, and empty tables are treated as each operator's
module says. Where no row has a text and a language none is learned, and only
texts without a letter are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, near_dedup, packing, secret_scan
from ledgerlens.llm.shared import prepare, shared_folder

#: Least share of a text's trigrams that its language must contain, as a part of that language's median.
LEAST_KNOWN = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = langid.learn(docs)
    return langid.keep_known(docs, model, langid.thresholds(docs, model, LEAST_KNOWN))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    table = secret_scan.learn(*secret_scan.labelled_samples(docs))
    out = secret_scan.redact(docs, table)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}-{name}"
        stage(spark, rows, sf_dir).write.parquet(place)
        rows = spark.read.parquet(place)
    return rows


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
