import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerlens.llm import secret_scan
from tests.llm.test_decontam import brute as contamination
from tests.llm.test_near_dedup import brute as near_classes
from tests.llm.test_secret_scan import with_random

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows on the smallest tables and some planted rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    body = docs.orderBy("doc_id").first().text
    planted = [(10**6, body, "en", "s", 1), (10**6 + 1, None, None, "s", 0), (10**6 + 2, "", "en", "s", 0), (10**6 + 3, "123 . 4", "de", "s", 7), (10**6 + 4, "漢字 " * 30, None, "s", 90), (10**6 + 5, "the secret = 'abcdef123' and of the " * 3, "en", "s", 105), (10**6 + 5, "the secret = 'abcdef123' and of the " * 3, "en", "s", 105)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    out, place = [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, rows, SF).write.parquet(f"file://{place}/{k}")
        before, rows = rows, spark.read.parquet(f"file://{place}/{k}")
        out.append((name, before, rows))
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_columns_stay(stages):
    for name in ("language", "near_dedup", "decontamination", "secrets"):
        before, after = stages[name]
        assert before.dtypes == after.dtypes


def test_language(stages):
    before, after = stages["language"]
    kept = {i for i, _ in pairs(after)}
    assert {10**6, 10**6 + 5} <= kept and not {10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4} & kept
    clean = {r.doc_id for r in before.collect() if r.lang and r.text and sum(c.isalpha() for c in r.text) > 0.5 * len(r.text)}
    assert clean <= kept


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    rows = pairs(before)
    keep = {i for i, _, k in near_classes(list(dict.fromkeys(rows))) if k}
    assert pairs(after) == [r for r in dict.fromkeys(rows) if r[0] in keep]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contamination(pairs(before), items) if r[-1]}
    assert pairs(after) == [r for r in pairs(before) if r[0] not in bad]


def test_secrets(stages):
    before, after = stages["secrets"]
    table = secret_scan.learn(*secret_scan.labelled_samples(before))
    want = []
    for i, t in pairs(before):
        done, at = "", 0
        for s, _, e in with_random(t, table):
            if e > at:
                done += t[at:s] + "[SECRET]" if s >= at else ""
                at = e
        want.append((i, done + t[at:]))
    assert pairs(after) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert not any("abcdef123" in t for _, t in pairs(after))


def test_packing(stages):
    before, after = stages["packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in pairs(before):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        want += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after.collect()) == sorted(want)


def test_empty_and_unlabelled_tables(spark, stages):
    none = stages["language"][0].limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).collect() == [], name
    unlabelled = spark.createDataFrame([(1, "a", None, "s", 1), (2, "12", None, "s", 2), (3, None, None, None, None)], none.schema)
    assert [r.doc_id for r in cp.language(spark, unlabelled, SF).collect()] == [1]


def test_registered(spark):
    import __spark_entry__ as e

    got = e.queries()["pipeline"](spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
