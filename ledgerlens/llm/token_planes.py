"""Token ids in plane files: fixed-size id blocks, transposed into byte or bit planes, each compressed by itself.

A file holds one ascending range of doc_ids::

    "TPL1" | planes of block 0 | planes of block 1 | ... | index | length of index (u64) | "TPL1"

A block is ``block_ids`` ids (the last may be shorter). ``byte`` planes hold the
first, second, third and fourth byte of all its ids, ``bit`` planes bit 0 to 31;
every plane is a zstandard frame, and a plane of zeros has no bytes. The index is
a zstandard frame of JSON: block size, kind, the place and length of each plane
of each block, and the doc_ids with their id counts, so any block or document is
read without the others.

Tasks write to a temporary name of their attempt and rename it, so a repeated or
duplicate attempt leaves one whole file with the same bytes. The manifest lists
files in doc_id order with the ids before each.

Defined cases: a null or empty text is its end id alone. Null doc_ids sort first.
Rows that repeat a doc_id stand in order of their text. An empty table gives no
file and no row. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, store
from .textbatch import chunks, utf8
from .tokens import ENCODED_BYTES, encoder, vocabulary_path, with_end

MAGIC = b"TPL1"
BLOCK_IDS = 1 << 16
END = 2


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block as raw bytes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes | None], n: int, kind: str) -> np.ndarray:
    """The ids of a block; None is a plane of zeros."""
    if kind == "byte":
        rows = np.zeros((n, 4), dtype=np.uint8)
        for i, p in enumerate(planes):
            if p is not None:
                rows[:, i] = np.frombuffer(p, dtype=np.uint8)
        return rows.reshape(-1).view("<u4")
    ids = np.zeros(n, dtype=np.uint32)
    for i, p in enumerate(planes):
        if p is not None:
            ids |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(i)
    return ids


class PlaneWriter:
    def __init__(self, out, block_ids: int = BLOCK_IDS, kind: str = "byte"):
        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are byte or bit, not {kind!r}")
        self.out, self.block_ids, self.kind = out, block_ids, kind
        self.blocks: list[list] = []
        self.names: list[int | None] = []
        self.counts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.at = out.write(MAGIC)
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, names: list, ids: np.ndarray, counts: list[int]) -> None:
        self.names += names
        self.counts += counts
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            all_ids = np.concatenate(self.waiting)
            whole = len(all_ids) // self.block_ids * self.block_ids
            for a in range(0, whole, self.block_ids):
                self._block(all_ids[a : a + self.block_ids])
            self.waiting = [all_ids[whole:]]
            self.held = len(all_ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = []
        for raw in to_planes(ids, self.kind):
            packed = self.press.compress(raw) if raw.strip(b"\0") else b""
            planes.append([self.at, len(packed)])
            self.at += self.out.write(packed) if packed else 0
        self.blocks.append([len(ids), planes])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = self.press.compress(json.dumps({"block_ids": self.block_ids, "kind": self.kind, "blocks": self.blocks, "doc_ids": self.names, "counts": self.counts}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Blocks and documents of a file opened for random reads."""

    def __init__(self, src):
        self.src = src
        size = src.size()
        src.seek(size - 12)
        tail = src.read(12)
        src.seek(0)
        if tail[8:] != MAGIC or src.read(4) != MAGIC:
            raise ValueError("not a whole plane file")
        (n,) = struct.unpack("<Q", tail[:8])
        src.seek(size - 12 - n)
        index = json.loads(zstandard.ZstdDecompressor().decompress(src.read(n)))
        self.block_ids, self.kind, self.blocks = index["block_ids"], index["kind"], index["blocks"]
        self.doc_ids, self.counts = index["doc_ids"], index["counts"]
        self._open = zstandard.ZstdDecompressor()

    def block(self, i: int) -> np.ndarray:
        n, places = self.blocks[i]
        planes = []
        for at, length in places:
            self.src.seek(at)
            planes.append(self._open.decompress(self.src.read(length)) if length else None)
        return from_planes(planes, n, self.kind)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from number ``start`` of the file on; only their blocks are read."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, (start + count - 1) // self.block_ids
        return np.concatenate([self.block(i) for i in range(a, b + 1)])[start - a * self.block_ids :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's number in the file, ids), with one block at a time in memory."""
        at, have, i, begin = 0, np.empty(0, np.uint32), 0, 0
        for name, n in zip(self.doc_ids, self.counts, strict=True):
            parts, need = [], n
            while need:
                if begin == len(have):
                    have, begin, i = self.block(i), 0, i + 1
                part = have[begin : begin + need]
                parts.append(part)
                begin += len(part)
                need -= len(part)
            yield name, at, np.concatenate(parts) if parts else np.empty(0, np.uint32)
            at += n


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS, kind: str = "byte") -> list[dict]:
    """Writes ``docs`` to ``folder`` (shared by all executors) and returns the manifest, also stored as manifest.json.

    A manifest row is a file: name, docs, ids, and start, the ids in files before it.
    """
    path = path or vocabulary_path()
    files, place = store(folder)
    files.create_dir(place)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, here = store(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.tpl"
        draft = f"{here}/_{name}.{context.taskAttemptId()}"
        writer = sink = None
        ids_total = 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, ENCODED_BYTES):
                if writer is None:
                    sink = fs.open_output_stream(draft)
                    writer = PlaneWriter(sink, block_ids, kind)
                ids, own = with_end(*encoder(path).encode_utf8(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), end)
                writer.add(batch.column(0).slice(a, b - a).to_pylist(), ids, np.diff(own).tolist())
                ids_total += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{here}/{name}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "part": pa.array([context.partitionId()], pa.int64()), "docs": pa.array([len(writer.names)], pa.int64()), "ids": pa.array([ids_total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id, or of none, are dealt further by their texts.
    ordered = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    written = checkpoint(ordered.mapInArrow(save, "file string, part long, docs long, ids long"))
    manifest, start = [], 0
    for r in written.orderBy("part").collect():  # one row per file
        manifest.append({"file": r.file, "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    with files.open_output_stream(f"{place}/_manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    files.move(f"{place}/_manifest.json", f"{place}/manifest.json")
    return manifest


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``folder``, from its files alone."""
    files, place = store(folder)
    with files.open_input_file(f"{place}/manifest.json") as src:
        manifest = json.loads(src.read())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, here = store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{here}/{name}") as src:
                    rows = [(d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in PlaneReader(src).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return listed.repartition(max(1, len(manifest))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
