"""Deterministic sharded WARC archives of pages, and their reader.

Records are cut into shards, ranges of (page_id, digest) whose limits are keys
chosen by their hash, and sorted in them; each shard is written to files that
roll over at a compressed size, every record a gzip member of its own. Limits,
headers, record ids, dates and digests come from the rows alone, so the same
rows give the same files, byte by byte, however they are partitioned.

Of records with equal payloads of at least ``least_bytes``, the one with the
largest page_id is a response and the others are revisits of it (headers only);
smaller ones are all responses. Which is which is decided on (page_id, digest,
length) rows: the largest id per digest is aggregated before any exchange, and
its revisits travel as small rows with the pages to the one sort. So payloads
are exchanged once, and a payload that a third of all pages share costs no more.

Commit: a task writes to temporary names of its attempt, renames the files when
all are whole, and reports them; the driver then writes the manifest to a
temporary name and renames it. Readers read only what the manifest lists, so
files of lost attempts are never seen, and a repeated attempt replaces its files
with equal ones.

Defined cases: a null or empty html is an empty payload. Rows that repeat a
page_id and payload are records of the same type with ids of their own. A null
page_id has no number in its headers and is never what others refer to. A null
url is ``about:blank``; characters that may not stand in a header are
percent-encoded. An empty table gives a manifest without files. Other columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import limits, range_of
from .shared import checkpoint, store

ROLL_BYTES = 128 << 20
#: Payload bytes of a shard, about; with many shards more, as the driver holds their limits.
SHARD_BYTES = 16 << 20
LEAST_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else 'about:blank'}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RollingWriter:
    """Files of a task under temporary names, rolled over at a compressed size."""

    def __init__(self, folder: str, part: int, attempt: int, roll_bytes: int):
        self.fs, self.here = store(folder)
        self.part, self.attempt, self.roll = part, attempt, roll_bytes
        self.files: list[dict] = []
        self.sink = None

    def _draft(self, name: str) -> str:
        return f"{self.here}/_{name}.{self.attempt}"

    def _put(self, raw: bytes) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without time or name
        packed = press.compress(raw) + press.flush()
        self.sink.write(packed)
        self.digest.update(packed)
        self.size += len(packed)

    def add(self, raw: bytes) -> None:
        if self.sink is None:
            self.name = f"pages-{self.part:06d}-{len(self.files):05d}.warc.gz"
            self.sink = self.fs.open_output_stream(self._draft(self.name), compression=None)
            self.digest, self.size, self.records = hashlib.sha1(), 0, 0
            info = f"software: ledgerlens\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, self.name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._put(head.encode() + info + b"\r\n\r\n")
        self._put(raw)
        self.records += 1
        if self.size >= self.roll:
            self._close()

    def _close(self) -> None:
        self.sink.close()
        self.sink = None
        self.files.append({"file": self.name, "part": self.part, "bytes": self.size, "records": self.records, "sha1": self.digest.hexdigest()})

    def commit(self) -> list[dict]:
        if self.sink is not None:
            self._close()
        for f in self.files:
            self.fs.move(self._draft(f["file"]), f"{self.here}/{f['file']}")
        return self.files


def _revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of all revisits, each once."""
    light = pages.where(F.col("payload_bytes") >= least_bytes).select("page_id", "digest")
    last = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return light.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Writes ``pages`` (page_id, url, html) to ``folder``, shared by all executors, and returns the manifest."""
    files, place = store(folder)
    files.create_dir(place)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("payload_bytes"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    marks = _revisits(rows, least_bytes).select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        out, done, key, refers_to, nth = None, [], None, None, 0
        for batch in batches:
            for shard, page_id, digest, kind, to, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or shard != out.part:
                    done += out.commit() if out is not None else []
                    out = RollingWriter(folder, shard, attempt, roll_bytes)
                if (page_id, digest) != key:
                    key, refers_to, nth = (page_id, digest), None, 0
                if kind == 0:  # the mark stands before its pages
                    refers_to = to
                    continue
                payload = text.encode()
                if hashlib.sha1(payload).digest() != digest:
                    raise ValueError(f"page {page_id}: the payload doesn't have its digest")
                out.add(record(page_id, url, payload, digest.hex(), refers_to, nth))
                nth += 1
        done += out.commit() if out is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in done], t) for k, t in _MANIFEST], names=[k for k, _ in _MANIFEST])

    h = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")  # orders as the digest does
    key = (F.col("page_id").isNotNull().cast("long"), F.coalesce("page_id", F.lit(0)).cast("long"), h)
    count, size = rows.agg(F.count("*"), F.sum("payload_bytes")).first()
    cuts = limits(rows.select(*[k.alias(n) for k, n in zip(key, ("has", "id", "h"), strict=True)]), count, (size or 0) // shard_bytes)
    shards = own.unionByName(marks).select(range_of(cuts, key).alias("shard"), "page_id", "digest", "kind", "refers_to", "url", "html")
    ordered = shards.repartition("shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    written = checkpoint(ordered.mapInArrow(save, "file string, part long, bytes long, records long, sha1 string"))
    manifest = [r.asDict() for r in written.orderBy("file").collect()]  # one row per file
    with files.open_output_stream(f"{place}/_manifest.json") as sink:
        sink.write(json.dumps(manifest).encode())
    files.move(f"{place}/_manifest.json", f"{place}/manifest.json")
    return manifest


_MANIFEST = [("file", pa.string()), ("part", pa.int64()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())]


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an open archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as src:
        while first := src.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while (line := src.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            n = int(head["content-length"])
            block = src.read(n)
            if len(block) != n or src.read(4) != b"\r\n\r\n":
                raise ValueError("the record is cut off")
            yield head, block


def _page(head: dict[str, str], block: bytes) -> tuple:
    """The reader's row of a response or revisit; its digests are checked."""
    if head["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"{head['warc-record-id']}: wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: wrong payload")
    number = lambda k: int(head[k]) if k in head else None
    return number("page-id"), n, digest, head["warc-type"], number("refers-to-page-id"), head["warc-target-uri"], payload.decode() if head["warc-type"] == "response" else None


_PAGE = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, html of the records in ``folder``.

    Files are read as streams, a record at a time; html is null for revisits.
    """
    files, place = store(folder)
    with files.open_input_file(f"{place}/manifest.json") as src:
        manifest = json.loads(src.read())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, here = store(folder)

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PAGE, strict=True)], names=[k for k, _ in _PAGE])

        for batch in batches:
            for name, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(f"{here}/{name}", compression=None) as src:
                    for head, block in records(src):
                        if head["warc-type"] == "warcinfo":
                            continue
                        rows.append(_page(head, block))
                        seen, size = seen + 1, size + len(block)
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)
                if seen != many:
                    raise ValueError(f"{name} has {seen} records, not {many}")

    listed = spark.createDataFrame([(m["file"], m["records"]) for m in manifest], "file string, records long")
    return listed.repartition(max(1, len(manifest))).mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
