"""Benchmark decontamination: windows of benchmark words found in documents.

Each benchmark item gives windows of ``width`` consecutive words; an item of
fewer words, but not none, is one window of all its words. Their 64-bit hashes
form the broadcast set. Every document is scanned once, in place (no shuffle):
its windows are looked up in a bitmap, then in the sorted set, and every hit is
verified against the window's own bytes before it counts.

The set's size is checked: ``max_windows`` bounds what one pass broadcasts. A
larger benchmark is cut into blocks of items: the rows are numbered and written,
scanned once for each block, and the blocks' hit words are united per row; what
is dropped or cut follows from the united words, as with one block.

Defined cases: null or empty text has no words, so it is never hit. Null or
empty items have no window. Repeated rows give repeated results, a repeated
item_id is one item. A null item_id is ignored (it names nothing). Other
columns of either table are not read; ``clean`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, unused
from .textbatch import ALNUM, chunks, utf8, words_of

WIDTH = 13
MAX_WINDOWS = 2_000_000
#: The column of row numbers in a scan, beside doc_id and text.
ROW = "_scan_row"


class WindowSet:
    """Windows of benchmark items, by length: sorted hashes, a bitmap before them, and who owns each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[dict[bytes, list[str]]]]] = {}
        found: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for item, text in items:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            w = words_of(raw, np.array([0, len(raw)]), ALNUM)
            if not len(w.hash):
                continue
            k = min(width, len(w.hash))
            parts = [ALNUM.fold[raw[s:e]].tobytes() for s, e in zip(w.start, w.end, strict=True)]
            for i, h in zip(*w.window_hash(k), strict=True):
                own = found.setdefault(k, {}).setdefault(int(h), {}).setdefault(b" ".join(parts[i : i + k]), [])
                if item not in own:
                    own.append(item)
        for k, by_hash in found.items():
            keys = np.array(sorted(by_hash), dtype=np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[k] = (keys, bits, [by_hash[int(h)] for h in keys])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """(words per document, hit mask over words, first word per document, items per document)."""
        w = words_of(data, offsets, ALNUM)
        hit = np.zeros(len(w.hash), dtype=bool)
        items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        for k, (keys, bits, owners) in self.by_length.items():
            at, h = w.window_hash(k)
            near = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
            same = keys[slot] == h[near]
            for i, s in zip(at[near[same]].tolist(), slot[same].tolist(), strict=True):
                words = b" ".join(ALNUM.fold[data[a:b]].tobytes() for a, b in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True))
                if (own := owners[s].get(words)) is not None:  # verified, not only the same hash
                    hit[i : i + k] = True
                    items[w.doc[i]].update(own)
        return np.diff(w.first), hit, w.first, items


def _benchmark_blocks(benchmark: DataFrame, width: int, max_windows: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``max_windows`` words (so of windows, too); one item alone may be longer."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("item is not null and body is not null").distinct()
    block: list[tuple[str, str]] = []
    size = 0
    for r in items.orderBy("item", "body").toLocalIterator():
        n = max(1, (len(r.body) + 1) // 2)
        if block and size + n > max_windows:
            yield block
            block, size = [], 0
        block.append((r.item, r.body))
        size += n
    if block:
        yield block


def _blocks(benchmark: DataFrame, width: int, max_windows: int) -> tuple[list[tuple[str, str]], Iterator[list[tuple[str, str]]] | None]:
    """(the first block, None), or, if there are more, (the first block, all blocks as they are asked for)."""
    blocks = _benchmark_blocks(benchmark, width, max_windows)
    first, second = next(blocks, []), next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def _broadcast(spark: SparkSession, block: list[tuple[str, str]], width: int) -> Broadcast:
    return spark.sparkContext.broadcast(WindowSet(block, width))


SCANNED = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids), spans (runs of hit words, numbers from 0)."""
    first, blocks = _blocks(benchmark, width, max_windows)
    if blocks is None:
        return _scan_block(docs.select("doc_id", "text").withColumn(ROW, F.lit(0).cast("long")), _broadcast(docs.sparkSession, first, width)).drop("row")
    return _scan_blocks(_numbered(docs.select("doc_id", "text")), blocks, width).drop("row")


def _numbered(docs: DataFrame, row: str = ROW) -> DataFrame:
    """``docs`` with a number of each row, written, so that all scans see the same numbers."""
    return checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))


def _scan_blocks(rows: DataFrame, blocks: Iterator[list[tuple[str, str]]], width: int) -> DataFrame:
    """The scans of all blocks united per row; each is written and its windows released before the next is made."""
    scans = []
    for block in blocks:
        windows = _broadcast(rows.sparkSession, block, width)
        scans.append(checkpoint(_scan_block(rows, windows)))
        windows.destroy()
    out = reduce(DataFrame.unionByName, scans)
    merged = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Unite overlapping runs: each keeps only what reaches past the furthest word before it.
    step = "struct(greatest(a.reach, s.last) as reach, a.n + greatest(0L, s.last - greatest(a.reach, s.first - 1)) as n)"
    return merged.select("row", "doc_id", "n_words", F.expr(f"aggregate(spans, struct(-1L as reach, 0L as n), (a, s) -> {step}, a -> a.n)").alias("n_hit"), "items", "spans")


def _scan_block(docs: DataFrame, windows) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                n, hit, first, items = windows.value.scan(data[own[0] : own[-1]], own - own[0])
                total = np.concatenate([[0], np.cumsum(hit)])
                spans = []
                for i, x in enumerate(items):
                    if not x:
                        spans.append([])
                        continue
                    edge = np.diff(np.concatenate([[False], hit[first[i] : first[i + 1]], [False]]).astype(np.int8))
                    spans.append([{"first": int(s), "last": int(e) - 1} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        batch.column(2).slice(a, b - a),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans", "row"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(ROW).alias("row"))
    return rows.mapInArrow(scan, SCANNED + ", row long")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: hits, the items' digest, and whether it is contaminated (5 % of its words or more)."""
    return scan_documents(docs, benchmark, width, max_windows).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, action: str = "drop", width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with its own columns and without contamination.

    ``drop`` removes contaminated documents; ``cut`` keeps them and removes
    every hit span from the text. Rows whose text has no hit stay as they are.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"action is drop or cut, not {action!r}")
    schema = docs.schema
    text_at = docs.columns.index("text")
    first, blocks = _blocks(benchmark, width, max_windows)
    if blocks is None:
        return _cut_block(docs, _broadcast(docs.sparkSession, first, width), schema, text_at, drop=action == "drop")
    row, spans_name = unused(docs, "row", "spans")
    rows = _numbered(docs, row)
    found = _scan_blocks(rows.select("doc_id", "text", F.col(row).alias(ROW)), blocks, width)
    if action == "drop":
        return rows.join(found.where(contaminated()).select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)
    spans = found.where("n_hit > 0").select(F.col("row").alias(row), F.col("spans").alias(spans_name))
    return _cut_block(rows.join(spans, row, "left").select(*docs.columns, spans_name), None, schema, text_at)


def _hits_of(data: np.ndarray, offsets: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """As ``WindowSet.scan``, from spans that are known; for items the spans themselves."""
    w = words_of(data, offsets, ALNUM)
    hit = np.zeros(len(w.hash), dtype=bool)
    for i, own in enumerate(spans):
        for span in own or ():
            hit[w.first[i] + span["first"] : w.first[i] + span["last"] + 1] = True
    return np.diff(w.first), hit, w.first, spans


def _cut_block(docs: DataFrame, windows, schema, text_at: int, drop: bool = False) -> DataFrame:
    """``docs`` without what ``windows`` hit; without ``windows`` the hits are the last column, which goes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                part, rel = data[own[0] : own[-1]], own - own[0]
                piece = batch.slice(a, b - a)
                if windows is None:
                    n, hit, first, items = _hits_of(part, rel, piece.column(piece.num_columns - 1).to_pylist())
                    piece = piece.select(list(range(piece.num_columns - 1)))
                else:
                    n, hit, first, items = windows.value.scan(part, rel)
                if drop:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    h = total[first[1:]] - total[first[:-1]]
                    yield piece.filter(pa.array(~((h > 0) & (20 * h >= n))))
                    continue
                if any(items):
                    texts = piece.column(text_at).to_pylist()
                    w = words_of(part, rel, ALNUM)
                    for i, x in enumerate(items):
                        if x:
                            gone = np.zeros(int(rel[i + 1] - rel[i]), dtype=bool)
                            edge = np.diff(np.concatenate([[False], hit[first[i] : first[i + 1]], [False]]).astype(np.int8))
                            for s, e in zip(np.flatnonzero(edge == 1) + first[i], np.flatnonzero(edge == -1) - 1 + first[i], strict=True):
                                gone[w.start[s] - rel[i] : w.end[e] - rel[i]] = True
                            texts[i] = part[rel[i] : rel[i + 1]][~gone].tobytes().decode()
                    columns = list(piece.columns)
                    columns[text_at] = pa.array(texts, piece.schema.field(text_at).type)
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                yield piece

    return docs.mapInArrow(cut, schema)
