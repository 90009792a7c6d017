"""Periodic runs against definitions written out, on random words and on the given table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import periodic
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every period is tried at every place."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 60)
    w = [str(rng.randrange(k)) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 6)
        w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return w + w if rng.random() < 0.2 else w


def test_runs_and_collapse_of_random_words():
    rng = random.Random(3)
    for _ in range(800):
        w = some_words(rng)
        want = brute_runs(w)
        assert periodic.runs_of(w) == want
        assert periodic.collapsed(w, want) == brute_kept(w, want)


def test_every_repetition_of_two_periods():
    """The automaton finds all runs, not only those of four periods."""
    rng = random.Random(4)
    for _ in range(500):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        want = {}
        for q in range(1, len(w) // 2 + 1):
            for i in range(len(w)):
                if i and i + q - 1 < len(w) and w[i - 1] == w[i - 1 + q]:
                    continue
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                n = j - i + q
                if j > i and n >= 2 * q and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                    want[i, q] = j + q
        assert periodic.repetitions(w) == want


def test_stretches_leave_no_run_out():
    rng = random.Random(5)
    for _ in range(500):
        w = some_words(rng)
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        at = periodic.stretches(np.array([number[x] for x in w], dtype=np.int64), len(number))
        for s, n, _ in brute_runs(w):
            assert any(a <= s and s + n <= b for a, b in at)


def test_a_long_text_of_one_word_and_one_of_nested_periods():
    assert periodic.runs_of(["x"] * 100_000) == [(0, 100_000, 1)]
    w = (["a"] * 7 + ["b"]) * 500
    got = periodic.runs_of(w)
    assert (0, 4000, 8) in got and got.count((8, 7, 1)) == 1 and len(got) == 501


def test_the_registered_query(spark):


    def want(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        out = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc_id, len(runs), *out, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(brute_kept(w, runs))))

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 20000").fetchall()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) >= len(rows)
    wanted = [want(*r) for r in rows]
    assert sum(w[1] for w in wanted) > 10
    for w in wanted:
        assert got[w[0]] == w


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_texts_without_words(docs_frame, text):
    (r,) = periodic.runs(docs_frame([(None, text)])).collect()
    assert (r.doc_id, r.runs, r.collapsed) == (None, [], "")


def test_repeated_rows_empty_tables_and_clashing_names(spark, docs_frame):
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (None, "x  y")]
    df = docs_frame(rows).selectExpr("*", "'k' AS _runs", "'m' AS _kept")
    out = periodic.collapse(df).collect()
    assert [(r.doc_id, r.text, r["_runs"], r["_kept"]) for r in out] == [(1, "a b c", "k", "m"), (1, "a b c", "k", "m"), (None, "x  y", "k", "m")]
    assert periodic.runs(df.where("false")).collect() == [] == periodic.collapse(df.where("false")).collect()
