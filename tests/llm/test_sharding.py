import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import sharding

DOCS = [(1, None), (2, ""), (3, None), (4, "a"), (4, "a"), (5, "a"), (None, "é"), (7, "long " * 5000)]


def least(sizes, shards):
    """The least capacity by a table over all cuts."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = list(total)
    for _ in range(shards - 1):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(total))]
    return best[-1]


def check(docs, rows, shards=16):
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs) == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    slots, place = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert place.setdefault((r.size, r.text_crc32, r.size == 1 and r.doc_id), r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    return max(sums.values(), default=0)


@pytest.mark.parametrize("shards,segments", [(16, 1 << 16), (3, 4), (5, 16)])
def test_capacity_is_the_least(spark, shards, segments):
    rng = random.Random(shards)
    for _ in range(3):
        keys = sorted({rng.randrange(1 << 63) for _ in range(120)} | {rng.randrange(1 << 20) for _ in range(20)})
        rows = [(k, rng.choice([1, 5, 300, rng.randint(1, 2000)])) for k in keys]
        firsts, capacity = sharding.plan(spark.createDataFrame(rows, "key long, size long"), shards, segments)
        assert capacity == least([s for _, s in rows], shards)
        sums = Counter()
        for k, s in rows:
            sums[sum(k >= f for f in firsts)] += s
        assert max(sums.values()) == capacity and len(firsts) < shards


def test_defined_cases(docs_frame):
    rows = sharding.assign(docs_frame(DOCS)).collect()
    check(DOCS, rows)
    assert sharding.assign(docs_frame(DOCS).limit(0)).collect() == []
    check(DOCS[:1], sharding.assign(docs_frame(DOCS[:1])).collect())


def test_write_keeps_groups_together(spark, docs_frame, tmp_path):
    docs = DOCS + [(i, f"text {i % 90}") for i in range(100, 400)]
    frame = docs_frame(docs)
    sharding.write(frame, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(docs) and set(frame.columns) < set(back.columns)
    assert back.groupBy("text").agg({"_shard": "min", "doc_id": "count"}).count() == len({t for _, t in docs})
    assert back.select("text", "_shard").distinct().count() == len({t for _, t in docs})


def test_query(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    most = check(docs, e.queries()["op9_minimax_sharding"](spark, sf).collect())
    total = sum(len((t or "").encode()) + 1 for _, t in docs)
    assert most <= total / 16 + max(len((t or "").encode()) + 1 for _, t in docs)


def test_the_least_capacity_of_the_given_table(spark):
    """No smaller capacity is feasible: every capacity below fails a greedy filling of the groups in their order."""
    from collections import Counter

    import xxhash

    from ledgerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    groups = Counter()
    for t in docs:
        groups[(xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42) >> 1] += len((t or "").encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]

    def shards(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return 1 << 30
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards(mid) <= 16 else (mid + 1, high)
    held = Counter()
    for r in QUERIES["op9_minimax_sharding"](spark, sf).collect():
        held[r.shard] += r.size
    assert max(held.values()) == low and shards(low - 1) > 16
