"""Packing documents into token sequences by bounded-space online best-fit.

A document is its ids and a closing id. Longer ones than ``size`` are cut into
pieces of ``size`` ids (the last may be shorter); shorter ones stay whole. Each
task keeps a fixed number of open bins in a bitset keyed by free space: a piece
goes to the open bin it leaves least room in; where none fits and the number is
reached, the fullest bin closes. Pieces of bins that are still open when a task
ends are not given away half empty: they go on to the next level, with fewer
tasks, until one task holds what is left. A level's task gets the ids of
``LEVEL_BINS`` times as many bins as it may leave open, however many pieces they
are, so each level hands on at most about a quarter of what it got and their
number grows with the logarithm of the input. Every level is checkpointed, so
sequence ids stay as they were made.

Defined cases: a null or empty text is its closing id alone. Rows that repeat a
doc_id are packed each for itself. Null doc_ids stay null. Other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint
from .textbatch import chunks, utf8
from .tokens import ENCODED_BYTES, encoder, vocabulary_path, with_end

SIZE = 2048
END = 0
OPEN_BINS = 2048
#: Ids of one task after the first level, in bins, as a multiple of the bins it keeps open.
LEVEL_BINS = 4

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64())]
_IDS = [("ids", pa.binary())]


class BestFit:
    """Open bins by free space; ``put`` returns the bins that close."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.bits = 0
        self.bins: dict[int, list[list]] = {}
        self.open = 0

    def _take(self, free: int) -> list:
        same = self.bins[free]
        found = same.pop()
        if not same:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, item: tuple, length: int) -> list[list]:
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            free, items = self.size, []
            if length < self.size and self.open >= self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        items.append(item)
        free -= length
        if free == 0:
            closed.append(items)
        else:
            self.bins.setdefault(free, []).append(items)
            self.bits |= 1 << free
            self.open += 1
        return closed

    def rest(self) -> list[list]:
        return [items for free in sorted(self.bins) for items in self.bins[free]]


def _pack(pieces: Iterator[tuple], level: int, part: int, last: bool, size: int, open_bins: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``pieces``: rows of _PIECE (and _IDS). What is left open has a null sequence_id unless this is the last level."""
    fit, made, out = BestFit(size, open_bins), 0, []

    def give(items: list, named: bool) -> None:
        nonlocal made
        at = 0
        for p in items:
            out.append((*p[:5], (level << 58) | (part << 34) | made if named else None, at if named else None, *p[5:]))
            at += p[3]
        made += named

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for p in pieces:
        for items in fit.put(p, p[3]):
            give(items, True)
        if len(out) >= 4096:
            yield batch()
    for items in fit.rest():
        give(items, last)
    yield batch()


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian 32-bit)."""
    path = path or vocabulary_path()
    schema = pa.schema(_PIECE + _PLACE + (_IDS if with_ids else []))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, ENCODED_BYTES):
                names = batch.column(0).slice(a, b - a).to_pylist()
                ids, own = with_end(*encoder(path).encode_utf8(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                for name, x, y in zip(names, own.tolist(), own.tolist()[1:], strict=False):
                    for i, s in enumerate(range(x, y, size)):
                        e = min(s + size, y)
                        part = raw[4 * s : 4 * e]
                        yield (name, i, s - x, e - s, zlib.crc32(part), *((bytes(part),) if with_ids else ()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack(cut(batches), 0, TaskContext.get().partitionId(), False, size, open_bins, schema)

    def later(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (p for b in batches for p in zip(*(b.column(c).to_pylist() for c in [*range(5), *range(7, len(schema))]), strict=True))
            yield from _pack(rows, level, TaskContext.get().partitionId(), last, size, open_bins, schema)

        return run

    level = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, ddl))
    done, n, share = level.where("sequence_id is not null"), 0, LEVEL_BINS * open_bins * size
    while True:
        waiting = level.where("sequence_id is null")
        left, ids = waiting.agg(F.count("*"), F.sum("length")).first()
        if not left:
            return done
        n += 1
        tasks = -(-ids // share)
        last = tasks == 1
        waiting = waiting.repartition(tasks)
        if left <= open_bins:  # no bin need close early, so the longest go first
            waiting = waiting.sortWithinPartitions(F.desc("length"), "doc_id", "piece")
        level = checkpoint(waiting.mapInArrow(later(n, last), ddl))
        done = done.unionByName(level.where("sequence_id is not null"))
