"""Sharding by bytes: a minimax contiguous partition of ordered, atomic groups.

Equal texts are one group, which is never split. Groups are ordered by a hash of
their text; a shard is a run of that order. The capacity is the smallest for
which the runs fit: a binary search over capacities, each checked greedily (fill
a shard as far as it goes, then open the next), and the cuts are those of the
least feasible capacity.

The number of groups has no bound, so the driver does not hold them. It holds at
most ``SEGMENTS`` segments of the order, each with its bytes and its largest
group. For a capacity, a cut that falls inside a segment lies between two known
places; that bounds the least capacity from both sides. Segments in which a cut
can still lie are divided again by one Spark job, until the bounds meet and
every cut is at a group.

Defined cases: size is the UTF-8 bytes of the text plus 1 (null: 1), text_crc32
of a null is 0; nulls are one group. Rows that repeat a doc_id each have a slot.
An empty table has no rows. With fewer groups than shards some shards are empty.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, unused

SHARDS = 16
SEGMENTS = 1 << 16
_TOP = 1 << 63


def group_key() -> F.Column:
    """The place of a text's group in the order: 0 to 2**63 - 1. Texts that share it count as one group."""
    return F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 1)


class _Segments:
    """Ordered segments: first and last key, bytes, bytes of the largest group, whether there is only one."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.first, self.last, size, self.largest = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.one = self.first == self.last

    def rows(self, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        return list(zip(self.first[at].tolist(), self.last[at].tolist(), (self.ends - self.starts)[at].tolist(), self.largest[at].tolist(), strict=True))

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Ends of the shards (bytes before them) under a greedy filling: at most, or at least, as far as it really goes."""
        total, place, out = int(self.ends[-1]), 0, []
        for _ in range(shards):
            place += capacity
            if place >= total:
                return [*out, total]
            s = int(np.searchsorted(self.ends, place, side="right"))
            if self.one[s]:
                place = int(self.starts[s])
            elif not hopeful:
                place = max(int(self.starts[s]), place - int(self.largest[s]) + 1)
            out.append(place)
        return out

    def least_capacity(self, shards: int, hopeful: bool) -> int:
        total = int(self.ends[-1])
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hopeful)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def plan(groups: DataFrame, shards: int = SHARDS, segments: int = SEGMENTS) -> tuple[list[int], int]:
    """(first keys of shard 1, 2, ..., least capacity) for ``groups`` (key, size), one row per key."""

    def split(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        parts = max(2, segments // len(ranges))
        spark = groups.sparkSession
        steps = [(i, a, b, -(-(b - a + 1) // parts)) for i, (a, b) in enumerate(ranges)]
        if len(ranges) == 1:
            _, a, b, step = steps[0]
            own = groups.where((F.col("key") >= a) & (F.col("key") <= b)).withColumn("part", F.expr(f"(key - {a}L) div {step}L"))
        else:
            table = F.broadcast(spark.createDataFrame(steps, "range long, a long, b long, step long"))  # at most `segments` rows
            own = groups.join(table, (F.col("key") >= F.col("a")) & (F.col("key") <= F.col("b"))).withColumn("part", F.struct("range", F.expr("(key - a) div step")))
        got = own.groupBy("part").agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size")).drop("part")
        return [tuple(r) for r in got.collect()]

    now = _Segments(split([(0, _TOP - 1)]))
    if not len(now.ends):
        return [], 0
    while True:
        low, high = now.least_capacity(shards, True), now.least_capacity(shards, False)
        near = np.zeros(len(now.ends), dtype=bool)
        for capacity in {low, high}:
            for p, q in zip(now.cuts(capacity, shards, False), now.cuts(capacity, shards, True), strict=False):
                near[np.searchsorted(now.ends, p, side="right") : np.searchsorted(now.ends, max(p, q), side="right") + 1] = True
        near &= ~now.one
        if low == high and now.cuts(low, shards, True) == now.cuts(low, shards, False) and set(now.cuts(low, shards, True)) <= {*now.ends.tolist()}:
            break
        now = _Segments(now.rows(~near) + split([r[:2] for r in now.rows(near)]))
    at = np.searchsorted(now.starts, now.cuts(low, shards, True)[:-1])
    return now.first[at].tolist(), low


def light_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row: all that planning and numbering move."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), group_key().alias("key"))


def _shard(firsts: list[int], key: str = "key") -> F.Column:
    at = F.lit(0)
    for f in firsts:
        at = at + (F.col(key) >= F.lit(f)).cast("int")
    return at


def assign(docs: DataFrame, shards: int = SHARDS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = checkpoint(light_rows(docs))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    firsts, _ = plan(checkpoint(groups), shards, segments)
    # Slots follow (key, doc_id), which also cuts a large group into several tasks.
    ordered = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "size", "text_crc32")
    numbered = checkpoint(ordered.withColumn("shard", _shard(firsts)).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    parts = numbered.groupBy("part", "shard").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("shard", "part").collect()  # tasks + shards rows
    before, base = {}, []
    for r in parts:
        base.append((r.part, r.shard, before.get(r.shard, 0) - r.least))
        before[r.shard] = before.get(r.shard, 0) + r.n
    bases = F.broadcast(docs.sparkSession.createDataFrame(base, "part int, shard int, base long"))
    return numbered.join(bases, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS) -> int:
    """Writes ``docs`` as Parquet, one folder per shard (``_shard``, or another name where that is taken); returns the capacity in bytes."""
    firsts, capacity = plan(checkpoint(light_rows(docs).groupBy("key").agg(F.sum("size").alias("size"))), shards)
    key, shard = unused(docs, "key", "shard")
    docs.withColumn(key, group_key()).withColumn(shard, _shard(firsts, key)).drop(key).write.partitionBy(shard).mode("errorifexists").parquet(folder)
    return capacity
