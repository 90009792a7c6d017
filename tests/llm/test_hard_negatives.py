"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, a long, k int"


def brute(rows, anchor, positives=5, negatives=10):
    use = []
    for i, label, e in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            use.append((i, label, [math.floor(256 * x) for x in e]))
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for n, (i, label, v) in enumerate(use):
        if i is None or not anchor(i):
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w)), m == label) for k, (j, m, w) in enumerate(use) if k != n]
        for p, s, _ in sorted((r for r in scored if r[2]), key=key)[:positives]:
            hard = sorted((r for r in scored if not r[2] and 30 * s <= 100 * r[1] <= 90 * s), key=key)[:negatives]
            out += [(i, p, rank, q, s, t) for rank, (q, t, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(spark, rows, anchor, parts=3):
    df = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], SCHEMA).repartition(parts)
    out = hn.mine(df, anchor)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=str)


def clustered(rng, n, width, spread=0.3):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        c = centres[label if rng.random() < 0.7 else rng.randrange(4)]
        rows.append((i, label, [x + rng.gauss(0, spread) for x in c]))
    return rows


@pytest.mark.parametrize("width", [1, 2, 5, 16])
def test_equals_all_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(hn, "SHARD_ROWS", 150)
    rows = clustered(random.Random(width), 700, width)
    want = brute(rows, lambda i: i % 20 == 0)
    assert len(want) > 300
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == want


def test_ties_repeated_rows_nulls_and_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40), rng.randrange(3), [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for _ in range(200)]
    rows += [(20, 1, [0.5] * 4)] * 3 + [(None, 1, [1.0] * 4), (None, 2, [0.5] * 4)] * 2
    rows += [(7, None, [1.0] * 4), (8, 1, None), (9, 1, [1.0, None, 1.0, 1.0]), (10, 1, [math.nan] * 4), (11, 2, [math.inf] * 4), (12, 2, []), (40, 0, [1.0]), (60, 0, [1.0] * 6)]
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_large_components_are_scored_exactly(spark):
    rng = random.Random(5)
    for scale in (1e3, 1e6):  # in doubles; in 64-bit whole numbers
        rows = [(i, rng.randrange(2), [rng.uniform(0.5, 1) * scale for _ in range(6)]) for i in range(120)]
        assert mined(spark, rows, F.col("vec_id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_empty_tables(spark):
    none = [(1, None, [1.0])]
    assert mined(spark, none, F.col("vec_id") % 20 == 0) == []
    assert mined(spark, [(1, 2, [1.0, 2.0]), (3, 2, [1.0, 2.0])], F.col("vec_id") % 20 == 0) == []


def test_cells_come_by_falling_bound_and_limit_their_rows():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (900, 10))
    books = (hn.codebook(v[:, :5], 7), hn.codebook(v[:, 5:], 7))
    shard = hn.Shard(np.arange(900), rng.integers(0, 3, 900), v, books)
    assert shard.first[-1] == 900
    for _ in range(20):
        q = rng.integers(-200, 200, 10)
        cells = list(shard.cells(q))
        assert len({c for _, c in cells}) == len(cells) == 49
        assert all(a >= b for (a, _), (b, _) in zip(cells, cells[1:]))
        for bound, c in cells:
            a, b = shard.first[c], shard.first[c + 1]
            assert (shard.vectors[a:b] @ q <= bound).all()


def test_the_search_stops_when_certified(monkeypatch):
    """Tight clusters: most cells are never opened."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-250, 250, (30, 16))
    v = centre[rng.integers(0, 30, 20_000)] + rng.integers(-4, 5, (20_000, 16))
    books = (hn.codebook(v[::10, :8]), hn.codebook(v[::10, 8:]))
    shard = hn.Shard(np.arange(20_000), rng.integers(0, 5, 20_000), v, books)
    seen = []
    real = hn.Shard.cells
    monkeypatch.setattr(hn.Shard, "cells", lambda self, q: (seen.append(c) or c for c in real(self, q)))
    got = shard.same_label(v[0], int(shard.labels[0]), 6)
    assert len(got) == 6 and len(seen) < 30
