"""Published states of a folder: numbered pointer files, each written under a
temporary name and renamed, so a reader sees the state before or after a write
and never one in between. The highest complete pointer counts; a pointer that a
stopped writer left half done is passed over. Only a folder without any pointer
counts as never published: other errors are raised, not taken for emptiness."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

_POINTERS = "_versions"


class Conflict(RuntimeError):
    """Another job published on the same state first."""


@dataclass(frozen=True)
class Head:
    """What a job has seen of a folder, in one listing: the current state (None
    if nothing was ever published) and the number a write on top of it takes.
    A second write on the same state takes the same number, and fails."""

    state: dict | None
    number: int


class Folder:
    """Small file operations of a store, by Hadoop's file system (driver only)."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.base}/{name}")

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A whole new file, or an error if it is there already."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._at(draft), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(name) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), False)
            raise Conflict(f"{self.base}/{name} was written by another job")

    def move(self, name: str, to: str) -> None:
        target = self._at(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._at(name), target):
            raise RuntimeError(f"{self.base}/{name} could not be moved to {to}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def latest(spark: SparkSession, base: str) -> Head:
    """The current state of a folder and the number above every pointer there is, complete or not."""
    folder = Folder(spark, base)
    pointers = [n for n in folder.names(_POINTERS) if n.endswith(".json")]
    number = 1 + max([0, *(int(n.removesuffix(".json")) for n in pointers)])
    for name in reversed(pointers):
        try:
            state = json.loads(folder.read(f"{_POINTERS}/{name}"))
        except ValueError:
            continue
        if isinstance(state, dict) and "number" in state:
            return Head(state, number)
    if pointers:
        raise RuntimeError(f"{base}: no pointer in {_POINTERS} is complete")
    return Head(None, number)


def head(spark: SparkSession, base: str) -> dict | None:
    """The current state of a folder, or None if nothing was ever published there."""
    return latest(spark, base).state


def commit(spark: SparkSession, base: str, number: int, state: dict) -> None:
    """Makes ``state`` the current one; raises Conflict if another job has published ``number`` meanwhile.

    ``number`` is that of the :class:`Head` on which the state was worked out."""
    Folder(spark, base).write_new(f"{_POINTERS}/{number:012d}.json", json.dumps(state | {"number": number}))
