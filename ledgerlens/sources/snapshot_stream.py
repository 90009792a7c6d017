"""Snapshot documents as a streamed source: ``spark.read.format("snapshot_json")``.

A document is a JSON object ``{date: [ {...}, ... ]}``, plain or gzip (told by
its first bytes, not its name), of any size. The reader of a file walks the
text piece by piece and gives one row for each list element, so a task holds
one piece, one element and one Arrow batch, never the document. Elements stay
text; the same expressions as for small files take them apart
(``snapshot_files.rows_of_items``).

A date given twice in a document counts as a JSON parser counts it, the last
one alone. Which occurrence is the last is found by a first walk over the file;
the second gives the rows.

Files are opened by pyarrow's file systems (file, hdfs, s3, gs). Where only
Spark can open a store, ``snapshot_files.read_texts`` reads whole files.
"""

from __future__ import annotations

import codecs
import gzip
import io
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once, characters an element may have, and rows and characters of a batch.
PIECE = 1 << 20
MOST_ELEMENT = 1 << 26
BATCH_ROWS = 4096
BATCH_CHARS = 4 << 20

SCHEMA = "source_backend string, path string, kind string, date_text string, item string"
#: Fixed values of ``kind``: a list element, a value that is no list, a document that is no object.
ITEM, VALUE, BROKEN = "item", "value", "broken"

_SPACE = re.compile(r"[ \t\n\r]*")
_AFTER = " \t\n\r,]}"
_scan = json.JSONDecoder().scan_once


class Broken(ValueError):
    """The text is no JSON object."""


class _Text:
    """A text of which only the part being read is held."""

    def __init__(self, read):
        self.read, self.held, self.at, self.ended = read, "", 0, False

    def more(self) -> None:
        """At least doubles what is held, so that a long element is scanned few times."""
        parts, want = [self.held[self.at :]], max(1, len(self.held) - self.at)
        while want > 0 and not self.ended:
            piece = self.read()
            self.ended = not piece
            parts.append(piece)
            want -= len(piece)
        self.held, self.at = "".join(parts), 0

    def next(self) -> str:
        """The next character that is no space, or '' at the end."""
        while True:
            self.at = _SPACE.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if self.ended:
                return ""
            self.more()

    def take(self, expected: str) -> str:
        c = self.next()
        if not c or c not in expected:
            raise Broken(f"{expected!r} expected")
        self.at += 1
        return c

    def value(self) -> tuple[object, str]:
        """The next JSON value and its text."""
        self.next()
        while True:
            try:
                found, end = _scan(self.held, self.at)
                # A number could go on, also behind what reads as its end ("1.5e").
                if self.ended or (end < len(self.held) and (not isinstance(found, (int, float)) or self.held[end] in _AFTER)):
                    text, self.at = self.held[self.at : end], end
                    return found, text
            except (StopIteration, ValueError, RecursionError):
                if self.ended:
                    raise Broken("no JSON value") from None
            if len(self.held) - self.at > MOST_ELEMENT:
                raise Broken("too long a value")
            self.more()


def walk(read) -> Iterator[tuple[int, str, str, str]]:
    """(number of the date in the document, date, kind, text) in order; Broken where the text is no object.

    ``read()`` gives the next piece of the text, and '' at its end. A list also
    has a first entry with an empty text, so that an empty one is seen.
    """
    text = _Text(read)
    text.take("{")
    number = 0
    if text.next() == "}":
        text.take("}")
    else:
        while True:
            key, _ = text.value()
            if not isinstance(key, str):
                raise Broken("a name expected")
            text.take(":")
            if text.next() == "[":
                text.take("[")
                yield number, key, ITEM, ""
                if text.next() == "]":
                    text.take("]")
                else:
                    while True:
                        yield number, key, ITEM, text.value()[1]
                        if text.take(",]") == "]":
                            break
            else:
                yield number, key, VALUE, text.value()[1]
            number += 1
            if text.take(",}") == "}":
                break
    if text.next():
        raise Broken("more than one value")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def _pieces(path: str):
    """A function that gives the next piece of a file's text."""
    system, at = located(path)
    raw = system.open_input_stream(at, compression=None)
    start = raw.read(2)
    body = io.BufferedReader(_Rejoined(start, raw), PIECE)
    stream = gzip.GzipFile(fileobj=body) if start == b"\x1f\x8b" else body
    decoder = codecs.getincrementaldecoder("utf-8")()

    def read() -> str:
        while True:
            data = stream.read(PIECE)
            text = decoder.decode(data, final=not data)
            if text or not data:
                return text

    return read


class _Rejoined(io.RawIOBase):
    """A stream with its first bytes put back."""

    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.start or self.rest.read(len(into))
        data, self.start = data[: len(into)], data[len(into) :] if self.start else b""
        into[: len(data)] = data
        return len(data)


class SnapshotFile(InputPartition):
    def __init__(self, source: str, path: str):
        self.source, self.path = source, path


class SnapshotReader(DataSourceReader):
    def __init__(self, files: list[list[str]]):
        self.files = files

    def partitions(self) -> Sequence[InputPartition]:
        return [SnapshotFile(*f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, SnapshotFile):  # no files: Spark asks for one empty part
            return
        yield from batches(partition.source, partition.path)


def batches(source: str, path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a document."""
    last: dict[str, int] = {}
    rows: list[tuple[str, str | None, str | None]] = []
    held = 0

    def out() -> pa.RecordBatch:
        kinds, dates, items = zip(*rows, strict=True)
        columns = [[source] * len(rows), [path] * len(rows), list(kinds), list(dates), list(items)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["source_backend", "path", "kind", "date_text", "item"])

    try:
        for number, date, _, _ in walk(_pieces(path)):
            last[date] = number
        for number, date, kind, text in walk(_pieces(path)):
            if last[date] == number and (text or kind == VALUE):
                rows.append((kind, date, text))
                held += len(text)
            if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield out()
                rows, held = [], 0
    except Broken:
        rows = [(BROKEN, None, None)]  # a document is judged whole, before any of its rows
    if rows:
        yield out()


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(json.loads(self.options["files"]))


def read_items(spark: SparkSession, paths_by_source: Mapping[str, Sequence[str]]) -> DataFrame:
    """(source_backend, path, kind, date_text, item): a row for each element of each document, a file a task."""
    files = [[source, path] for source, paths in paths_by_source.items() for path in paths]
    if not files:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot_json").option("files", json.dumps(files)).load()


def discover(spark: SparkSession, paths_by_source: Mapping[str, Sequence[tuple[int, str]]], tasks: int = 64) -> DataFrame:
    """(source_backend, year, path, found): one job whose tasks look for the files."""
    wanted = [(source, year, path) for source, paths in paths_by_source.items() for year, path in paths]
    schema = "source_backend string, year int, path string"
    if not wanted:
        return spark.createDataFrame([], f"{schema}, found boolean")

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = []
            for path in batch.column("path").to_pylist():
                system, at = located(path)
                found.append(system.get_file_info(at).type == fs.FileType.File)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*batch.schema.names, "found"])

    return spark.createDataFrame(wanted, schema).repartition(min(tasks, len(wanted))).mapInArrow(look, f"{schema}, found boolean")
