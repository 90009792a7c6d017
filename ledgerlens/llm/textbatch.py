"""Text columns of Arrow batches as numpy arrays: word spans and 64-bit word and window hashes.

Everything works on UTF-8 bytes. The word classes used here have only ASCII
separators, so bytes and code points give the same words. Hashes depend on the
bytes alone (no process seed), so every executor gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


@dataclass(frozen=True)
class WordClass:
    """Which bytes separate words and which byte each other byte counts as."""

    separator: np.ndarray  # bool[256]
    value: np.ndarray  # uint64[256]
    fold: np.ndarray  # uint8[256]


def _word_class(separators: set[int]) -> WordClass:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    sep = np.zeros(256, dtype=bool)
    sep[sorted(separators)] = True
    return WordClass(sep, seeded(256, 77)[fold], fold)


#: Words are runs without \x20 and \x09-\x0D; A-Z count as a-z.
SPACED = _word_class({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, letters and non-ASCII characters; A-Z count as a-z.
ALNUM = _word_class({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        if n > 4 * CHUNK_BYTES:  # one giant text: don't keep its tables
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of some documents, in order."""

    hash: np.ndarray  # uint64
    doc: np.ndarray  # index of the word's document
    start: np.ndarray  # first byte in data
    end: np.ndarray  # past the last byte
    first: np.ndarray  # per document: index of its first word; one more entry at the end

    def window_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every run of ``k`` words inside one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        coef = seeded(k, 1000 + k) | np.uint64(1)
        h = self.hash[:n] * coef[0]
        for j in range(1, k):
            h += self.hash[j : j + n] * coef[j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return at, mix64(h[at])


def words_of(data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``; offsets begin at 0."""
    n = len(data)
    if n == 0:
        e = np.empty(0, dtype=np.int64)
        return Words(np.empty(0, dtype=np.uint64), e, e, e, np.zeros(len(offsets), dtype=np.int64))
    inside = ~kind.separator[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(kind.value[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(h, doc, start, end, first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    a = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, dtype=np.int64)
    body = a.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about ``most`` bytes together, at least one document each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def sum_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's words; ``first`` as in Words."""
    total = np.concatenate([np.zeros(1, dtype=np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
