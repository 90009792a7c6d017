"""Columns that go through an operator keep their names and values, whatever they are."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, near_dedup, periodic, secret_scan, sharding

NAMES = ["_at", "_fp", "_text", "_base", "_runs", "_spans", "_real", "_scan_row", "_row", "_shard", "shard", "key", "_key", "_kept", "_clean_text", "_runs_found", "_has", "_hash", "_bucket", "_copy", "_place"]
TEXT = "the quick brown fox jumps over the lazy dog and then sleeps all day long in the warm sun"
DOCS = [(1, TEXT, "en"), (2, TEXT + " again", "en"), (3, 'token = "abcdef123456789"', "en"), (None, "der schnelle braune fuchs springt", "de"), (5, None, None)]


@pytest.fixture()
def named(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def passed(df, named):
    assert df.columns == named.columns
    rows = df.collect()
    for r in rows:
        assert all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for n in NAMES)
    return {r.doc_id: r.text for r in rows}


def benchmark(spark):
    return spark.createDataFrame([("b1", " ".join(TEXT.split()[:14])), ("b2", "nothing of this stands there")], "item_id string, text string")


def test_dedup(named):
    assert len(passed(near_dedup.dedup(named), named)) == 4


def test_dedup_of_repeated_ids(named):
    assert len(passed(near_dedup.dedup(named.unionByName(named)), named)) == 4


@pytest.mark.parametrize("max_windows", [10, 1_000_000])
@pytest.mark.parametrize("action", ["drop", "cut"])
def test_clean(spark, named, max_windows, action):
    got = passed(decontam.clean(named, benchmark(spark), action, max_windows=max_windows), named)
    assert (1 in got) == (action == "cut") and got[3] == DOCS[2][1]


def test_redact(named):
    table = secret_scan.learn(*secret_scan.labelled_samples(named.select("doc_id", "text")))
    got = passed(secret_scan.redact(named, table), named)
    assert "abcdef" not in got[3] and got[1] == TEXT


@pytest.mark.parametrize("how", [{}, {"slots": 1 << 12, "part_slots": 1 << 10}])
def test_keep_known(named, how):
    got = passed(langid.keep_known(named, langid.learn(named, **how), 0.0), named)
    assert 5 not in got and len(got) == 4


def test_collapse(named):
    assert passed(periodic.collapse(named), named)[1] == TEXT


def test_sharding_write(spark, named, tmp_path):
    sharding.write(named, f"file://{tmp_path}/s", 2)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert {*named.columns} < {*back.columns} and len(back.columns) == len(named.columns) + 1
    passed(back.select(named.columns), named)
