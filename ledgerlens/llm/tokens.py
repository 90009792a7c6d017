"""Token ids of whole texts by a public tokenizer, with the ids of repeated words kept.

The tokenizer's normaliser and splitter never join characters across a space or
a newline, nor a Latin letter with ASCII punctuation after it (a run of letters
always ends a word of the splitter). So texts are cut there, as bytes, and a
text's ids are those of its pieces, one after the other. Arrow numbers the
different pieces of a chunk; each of them is encoded once per Python worker (the
table is bounded and starts anew when full) and ids are put together with numpy.

New pieces that are Latin letters alone are encoded many at a time: each gives
exactly one id that ends a word, and that tells their ids apart. Everything else
is encoded by itself.

This holds for word_bpe_49k.json, whose splitter drops white space;
``WordEncoder`` refuses a tokenizer for which it does not.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa

from .textbatch import utf8

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces kept by a worker.
MOST_KEPT = 500_000
#: Bytes of text encoded at once; a longer text is encoded alone.
ENCODED_BYTES = 8 << 20
#: Words encoded in one call.
_TOGETHER = 256


def _bytes_in(*spans: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    for a, b in spans:
        found[a : b + 1] = True
    return found


_SPACE = _bytes_in((0x20, 0x20), (0x0A, 0x0A))
#: ASCII letters, and the first byte of U+00C0 to U+023F.
_LETTER = _bytes_in((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC8))
#: ASCII punctuation, without the | that stands after a letter inside the tokenizer's own tokens.
_CUT = _bytes_in((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of Latin letters up to U+023F that stay one letter when lower-cased."""
    out = _LETTER[data]
    lead = np.flatnonzero(out[:-1] & (data[:-1] >= 0x80))
    first, second = data[lead], data[lead + 1]
    good = ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0))
    out[lead] = out[lead + 1] = good
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without spaces and newlines, limits of the pieces in them, each text's first piece; one more entry at the end)."""
    space = _SPACE[data]
    start = np.zeros(len(data), dtype=bool)
    start[1:] = space[:-1] | (_CUT[data[1:]] & _letters(data)[:-1])
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    start &= ~space
    at = np.flatnonzero(start)
    body = data[~space]
    return body, np.append(at - np.cumsum(space)[at], len(body)), np.searchsorted(at, offsets)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        for probe in ("It's  a\ntest, <|endoftext|> é ́x\n\n'S ab1 2", "a ̈b\nÉ̀ don 't"):
            alone = [i for part in probe.replace("\n", " ").split(" ") for i in self._ids([part])[0]]
            if alone != self._ids([probe])[0]:
                raise ValueError(f"{path}: the tokenizer joins characters across white space")
        for token in self._tokenizer.get_added_tokens_decoder().values():
            raw = np.frombuffer(token.content.encode(), dtype=np.uint8)
            if len(pieces(raw, np.array([0, len(raw)]))[1]) != 2:
                raise ValueError(f"{path}: the tokenizer has a token that would be cut, {token.content}")
        names = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(names.values()) + 1, dtype=bool)
        self._ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self._place: dict[bytes, int] = {}
        self._ids_kept = np.empty(0, dtype=np.uint32)
        self._bounds = np.zeros(1, dtype=np.int64)

    def _keep(self, new: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self._place.update(zip(new, range(len(self._place), len(self._place) + len(new)), strict=True))
        self._bounds = np.concatenate([self._bounds, len(self._ids_kept) + ends])
        self._ids_kept = np.concatenate([self._ids_kept, ids])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], others: list[bytes]) -> None:
        """Keeps the ids of new pieces; ``words`` are letters alone."""
        groups = [words[a : a + _TOGETHER] for a in range(0, len(words), _TOGETHER)]
        new, found, ends, at = [], [], [], 0
        for group, ids in zip(groups, self._ids([b" ".join(g).decode() for g in groups]), strict=True):
            own = np.array(ids, dtype=np.uint32)
            end = np.flatnonzero(self._ends_word[own]) + 1
            if len(end) != len(group) or end[-1] != len(own):
                others = others + group
                continue
            new += group
            found.append(own)
            ends.append(at + end)
            at += len(own)
        alone = self._ids([p.decode() for p in others])
        new += others
        found += [np.array(ids, dtype=np.uint32) for ids in alone]
        ends.append(at + np.cumsum([len(ids) for ids in alone], dtype=np.int64))
        self._keep(new, np.concatenate(found), np.concatenate(ends))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of each text's ids)."""
        raw = [t.encode() for t in texts]
        return self.encode_utf8(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))

    def encode_utf8(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the texts ``data[offsets[i]:offsets[i + 1]]``; offsets begin at 0."""
        if len(self._place) > MOST_KEPT:
            self._clear()
        body, limits, first = pieces(data, offsets)
        if len(limits) == 1:
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        numbered = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        held, edge = utf8(numbered.dictionary)
        raw, edges = held.tobytes(), edge.tolist()
        different = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        at = np.fromiter(map(self._place.get, different, repeat(-1)), dtype=np.int64, count=len(different))
        if len(missing := np.flatnonzero(at < 0)):
            word = np.logical_and.reduceat(_letters(held), edge[:-1])[missing]
            self._learn([different[i] for i in missing[word].tolist()], [different[i] for i in missing[~word].tolist()])
            at[missing] = np.fromiter(map(self._place.__getitem__, (different[i] for i in missing.tolist())), dtype=np.int64, count=len(missing))
        at = at[numbered.indices.to_numpy()]
        begin = self._bounds[at]
        many = self._bounds[at + 1] - begin
        total = np.concatenate([[0], np.cumsum(many)])
        ids = self._ids_kept[np.repeat(begin - total[:-1], many) + np.arange(total[-1])]
        return ids, total[first]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end``."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))
