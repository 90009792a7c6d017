"""Order MinHash against a scorer written out with another xxHash, and next rows against a sorted list."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import order_minhash as om
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 26) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def brute_signature(text):
    """Every order is laid out in full."""
    w = [x[i : i + 16] for x in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in range(0, len(x), 16)]
    if not w:
        return [0] * 128
    kmers = [xx(w[i], w[i + 1] if i + 1 < len(w) else None) for i in range(max(1, len(w) - 1))]
    seen, elements = Counter(), []
    for i, k in enumerate(kmers):
        elements.append((xx((k >> 26, 8), (seen[k >> 26], 4)) >> 26, i))
        seen[k >> 26] += 1
    out = []
    for seed in range(4):
        ring = sorted((e if seed == 0 else xx((e, 8), (seed, 4)) >> 26, i) for e, i in elements)
        for j in range(32):
            start = j * (1 << 59) - (1 << 63)
            order = sorted(ring, key=lambda x: ((x[0] << 26 | x[1]) < start, x))
            a, b = sorted(x[1] for x in (order + order)[:2])
            out.append(xx((kmers[a], 8), (kmers[b], 8)) & 0xFFFF)
    return out


def texts(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "doc_id long, text string")


def test_signatures_equal_the_orders_laid_out(spark):
    rng = random.Random(1)
    values = [None, "", " \n", "one", "two words", "x" * 50, "a a a a a a", "é ü ö 漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字"]
    values += [" ".join(rng.choice(["ab", "c", "déf", "g"]) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    got = texts(spark, values).select("doc_id", om.signature(F.col("text")).alias("s")).collect()
    assert len(got) == len(values)
    for r in got:
        assert r.s == brute_signature(values[r.doc_id]), values[r.doc_id]


def test_likeness_estimates_the_share_of_common_ordered_pairs(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    few, moved = list(base), base[1000:] + base[:1000]
    for i in range(0, 2000, 40):
        few[i] = "changed"
    shuffled = list(base)
    rng.shuffle(shuffled)
    values = [" ".join(x) for x in (base, few, moved, shuffled)]
    sig = [r.s for r in texts(spark, values).orderBy("doc_id").select(om.signature(F.col("text")).alias("s")).collect()]
    like = [sum(a == b for a, b in zip(sig[0], s, strict=True)) / 128 for s in sig]
    assert like[0] == 1 and like[3] < 0.05
    assert abs(like[1] - (1900 / 2050) ** 2) < 0.15  # 50 words changed: 100 of 1999 pairs of words lost on either side
    assert 0.3 < like[2] < 0.7  # all words common, but half of the pairs of elements stand in the other order


def test_the_registered_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r.doc_id: r for r in QUERIES["op12_order_minhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    hexed = lambda s: "".join(f"{v:04x}" for v in s)
    texts_ = [t or "" for _, t in rows]
    sigs = [brute_signature(t) for t in texts_]
    for k, (i, _) in enumerate(rows):
        t, nxt = texts_[k], texts_[(k + 1) % len(rows)]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        es = brute_signature(e)
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 128
        want = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(sigs[k]), hexed(es), like(sigs[k], es), like(sigs[k], sigs[(k + 1) % len(rows)]))
        assert tuple(got[i]) == want


def next_pairs(spark, rows, **columns):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    out = om.with_next(df, {}, {"text": "next_text"})
    assert out.columns == [*df.columns, "next_text"]
    return sorted(((r.doc_id, r.text, r.next_text) for r in out.collect()), key=str)


def wanted_pairs(rows):
    s = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1]) if r[1] is not None else 42))
    return sorted(((i, t, s[(k + 1) % len(s)][1]) for k, (i, t) in enumerate(s)), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 900])
def test_next_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 5, 5, rng.randrange(-50, 2000)]), f"t{rng.randrange(400)}") for _ in range(n)]
    assert next_pairs(spark, rows, _has="x", _bucket=1, _copy=2, _place=3, _key=4, _hash=5) == wanted_pairs(rows)


def test_a_third_of_the_rows_is_one_row_repeated(spark, monkeypatch):
    """The copies are dealt over many buckets, and every pair is right."""
    monkeypatch.setattr(om, "BUCKET_ROWS", 16)
    rows = [(None, "same")] * 2000 + [(i, f"t{i}") for i in range(1500)] + [(i, f"u{i}") for i in range(500)]
    assert next_pairs(spark, rows) == wanted_pairs(rows)
    cuts = om._cuts(spark.createDataFrame([(0, 0, 7)] * 2000 + [(1, i, 1) for i in range(2000)], "has long, id long, h long"))
    assert cuts[0][:3] == (0, 0, 7) and cuts[0][3] > 5 and all(c[3] == 1 for c in cuts[1:])


def test_no_python_workers(spark):
    plan = om.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
