"""Language-model scoring: a log-bilinear model, trained by noise-contrastive estimation.

Tokens are words (runs without white space, A-Z as a-z) and one end per text.
The ``LISTED`` most frequent words (of count ``LEAST_COUNT`` or more) have
vectors of their own, as what is predicted and as context. A word's class is
that of its last two bytes; ``CLASSES`` classes hold about equally many tokens.
All other words of a class share a symbol there, and the end is a class of its
own. The probability of a word is two softmaxes and, for the others, a share:

    P(class | context) * P(symbol | class, context) [* (c + 0.1) / (N + 0.1 (V + 1))]

with c the word's count and N, V the tokens and words of the class's others. So
each text has a normalised probability, whatever its words.

A context is the last ``ORDER`` symbols: each has a vector for its distance, the
sum is the predicted vector, and both softmaxes are its products with the vectors
of the classes, and of the class's symbols, plus a bias. A chunk's sums are worked
out by matrix products, inside the classes for all tokens of a class at once.

All training texts take part in everything: word counts are summed by Spark
(partial sums in the tasks, then by word), and each text is trained on in one of
``ROUNDS`` rounds. A round's texts are dealt into shards of about ``SHARD_BYTES``
by a hash of (doc_id, text) and sorted by it; each shard trains its own copy of
the parameters, at least ``LEAST_STEPS`` mini-batches, and the shards' parameters
are averaged, weighted by their tokens. Shards, their order, mini-batches and
noise follow from the texts, so the scores do not depend on how the table is
partitioned. What the driver and each task hold is bounded by the model: at most
``KNOWN`` frequent words with their counts, 65,536 endings, and the parameters.
The counts of all other words stay in Spark and meet the texts' rare words in a
join.

Defined cases: a null or empty text is its end alone. A null doc_id counts as
empty text in the split. Rows that repeat a doc_id are scored each for itself,
and rows that repeat a text too are trained on as often. A very long text is
cut into chunks of no less than one text, in one task. Without training texts (or
with an empty table, which gives no rows) every base probability is 1 and the
model is uniform over its one class and the end. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint
from .textbatch import CHUNK_BYTES, SPACED, chunks, utf8, words_of

#: Most words with a vector of their own, and the least count of such a word.
LISTED = 20_480
LEAST_COUNT = 3
CLASSES = 128
#: Most words whose counts every task holds.
KNOWN = 1 << 17
ORDER = 2
WIDTH = 16
#: Noise classes, and noise words of each class, of a mini-batch.
CLASS_NOISE = 8
NOISE = 4
BATCH = 8192
LEAST_STEPS = 200
ROUNDS = 3
RATE = 0.8
SMOOTH = 0.1
#: Bytes of text that one set of parameters is trained on in a round, about.
SHARD_BYTES = 16 << 20
#: Stands for the end among word hashes.
END_HASH = np.uint64(0x5EED0F7E0DD0C5ED)
_HELD = 1_500_000
#: Upper bits of a hash that lead to its place among the frequent words.
_UPPER_BITS = 18
#: Parts of the parameters, each averaged by itself.
_SLICES = 64


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def _endings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last two bytes of each word (A-Z as a-z) as one number."""
    last = SPACED.fold[data[end - 1]].astype(np.int32)
    before = np.where(end - start > 1, SPACED.fold[data[np.maximum(end - 2, 0)]], 0).astype(np.int32)
    return before << 8 | last


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, ending, n) of all tokens in ``docs``; the end's ending is -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, first, back = np.unique(h, return_index=True, return_inverse=True)
            return own, e[first], np.bincount(back, weights=n).astype(np.int64)

        def give() -> Iterator[pa.RecordBatch]:
            for h, e, n in held:
                for a in range(0, len(h), 200_000):
                    s = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(e[s], pa.int32()), pa.array(n[s], pa.int64())], names=["word", "ending", "n"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            texts += len(offsets) - 1
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                w = words_of(part, offsets[a : b + 1] - offsets[a], SPACED)
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, _endings(part, w.start[first], w.end[first]), n))
                size += len(h)
                if size > _HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield from give()
                        held.clear()
                        size = 0
        if texts:
            held.append((np.array([END_HASH]), np.array([-1], dtype=np.int32), np.array([texts])))
            held[:] = [merged()]
            yield from give()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, ending int, n long")
    return rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Symbols by class: each class's listed words, then the symbol of its other words; the end is the last class."""

    keys: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # their counts
    listed: np.ndarray  # their symbols, -1 for words without one
    class_of: np.ndarray  # class of each ending
    first: np.ndarray  # first symbol of each class; one more entry at the end
    log_rest: np.ndarray  # by symbol: log10 of the denominator among a class's other words, 0 for words and the end
    bias: np.ndarray  # log of each symbol's share of its class's tokens
    class_bias: np.ndarray  # log of each class's share of all tokens
    tokens: int
    types: int
    ends: int

    @property
    def end(self) -> int:
        return len(self.bias) - 1

    @property
    def class_of_symbol(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.class_bias)), np.diff(self.first))

    @cached_property
    def _buckets(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(keys and a last one, the place of the first key of each run of hashes with the same upper bits, most keys in a run)."""
        begin = np.searchsorted(self.keys, np.arange(1 << _UPPER_BITS, dtype=np.uint64) << np.uint64(64 - _UPPER_BITS))
        return np.append(self.keys, np.uint64((1 << 64) - 1)), begin, int(np.diff(begin, append=len(self.keys)).max())

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """``np.searchsorted(self.keys, hashes)``; the keys are hashes, so few have the same upper bits."""
        keys, begin, most = self._buckets
        if most > 32:
            return np.searchsorted(self.keys, hashes)
        slot = begin[hashes >> np.uint64(64 - _UPPER_BITS)]
        for _ in range(most):
            slot += keys[slot] < hashes
        return slot

    @property
    def log_total(self) -> float:
        return math.log10(self.tokens + SMOOTH * (self.types + 1))


def _least_count(words: DataFrame, known: int) -> int:
    """The least count at which no more than ``known`` words are left.

    Found from a histogram in steps of a sixteenth of an octave, so that tasks
    send only words that are known in the end.
    """
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    rows = words.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # at most 1024 rows
    least, total = 1 << 62, 0
    for r in rows:
        total += r.words
        if total > known:
            break
        least = r.least
    return least


def _dealt(tokens: np.ndarray, classes: int) -> np.ndarray:
    """A class for each ending: the heaviest endings first, each to the class that has least."""
    out = np.zeros(len(tokens), dtype=np.int32)
    load = [(0, c) for c in range(classes)]
    for e in np.lexsort((np.arange(len(tokens)), -tokens)).tolist():
        held, c = heapq.heappop(load)
        out[e] = c
        heapq.heappush(load, (held + int(tokens[e]) + 1, c))  # endings never met are dealt too
    return out


def vocabulary(counts: DataFrame, listed: int = LISTED, classes: int = CLASSES, known: int = KNOWN, least: int = LEAST_COUNT) -> Vocabulary:
    whole = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("ending") < 0, F.col("n")))).first()
    words = counts.where("ending >= 0")
    top = words.where(F.col("n") >= _least_count(words, known)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    word = top["word"].to_numpy(dtype=np.int64).view(np.uint64)
    n = top["n"].to_numpy(dtype=np.int64)
    ending = top["ending"].to_numpy(dtype=np.int64)
    found = words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    tokens, types = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    at = found["ending"].to_numpy(dtype=np.int64)
    tokens[at], types[at] = found["n"].to_numpy(dtype=np.int64), found["types"].to_numpy(dtype=np.int64)
    class_of = _dealt(tokens, classes)
    k = min(listed, int((n >= least).sum()))
    own = class_of[ending[:k]]
    by_class = np.argsort(own, kind="stable")  # in a class by count
    size = np.bincount(own, minlength=classes) + 1
    first = np.concatenate([[0], np.cumsum(size), [size.sum() + 1]])
    symbol = np.full(len(word), -1, dtype=np.int32)
    symbol[by_class] = np.arange(k) + own[by_class]  # each class before has one symbol more
    rest = first[1:-1] - 1
    n_rest = np.bincount(class_of, weights=tokens, minlength=classes)
    v_rest = np.bincount(class_of, weights=types, minlength=classes)
    np.subtract.at(n_rest, own, n[:k])
    np.subtract.at(v_rest, own, 1)
    ends = int(whole[2] or 0)
    share = np.zeros(first[-1])
    share[symbol[:k]] = n[:k]
    share[rest] = n_rest
    share[-1] = ends
    share += 0.5
    log_rest = np.zeros(first[-1])
    log_rest[rest] = np.log10(n_rest + SMOOTH * (v_rest + 1))
    total = np.add.reduceat(share, first[:-1])
    order = np.argsort(word)
    bias = np.log(share) - np.repeat(np.log(total), np.diff(first))
    return Vocabulary(word[order], n[order], symbol[order], class_of, first, log_rest, bias, np.log(total / total.sum()), int(whole[0] or 0), int(whole[1]), ends)


@dataclass
class Tokens:
    """A chunk's tokens: each text's words, then its end."""

    symbol: np.ndarray
    contexts: list[np.ndarray]  # symbols 1, 2, ... before; the start counts as one more symbol
    first: np.ndarray  # per text: its first token; one more entry at the end
    count: np.ndarray  # count in training, -1 where it is not known here
    word: np.ndarray  # hashes


def tokens_of(data: np.ndarray, offsets: np.ndarray, v: Vocabulary, order: int) -> Tokens:
    w = words_of(data, offsets, SPACED)
    docs = len(offsets) - 1
    first = w.first + np.arange(docs + 1)
    at = np.arange(len(w.hash)) + w.doc
    total = len(w.hash) + docs
    word = np.full(total, END_HASH, dtype=np.uint64)
    word[at] = w.hash
    count = np.full(total, v.ends, dtype=np.int64)
    symbol = np.full(total, v.end, dtype=np.int32)
    if len(w.hash):
        other = (v.first[1:] - 1)[v.class_of[_endings(data, w.start, w.end)]]
        if len(v.keys):
            slot = np.minimum(v.slots(w.hash), len(v.keys) - 1)
            hit = v.keys[slot] == w.hash
            count[at] = np.where(hit, v.counts[slot], -1)
            listed = np.where(hit, v.listed[slot], -1)
            symbol[at] = np.where(listed >= 0, listed, other)
        else:
            count[at], symbol[at] = -1, other
    doc_first = np.repeat(first[:-1], np.diff(first))
    contexts = []
    for k in range(1, order + 1):
        c = np.full(total, v.end + 1, dtype=np.int32)
        c[k:] = np.where(np.arange(k, total) - k >= doc_first[k:], symbol[: total - k] if k < total else symbol[:0], v.end + 1)
        contexts.append(c)
    return Tokens(symbol, contexts, first, count, word)


def _log_sum(x: np.ndarray, small: bool) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; ``x`` is used up. ``small``: no value is beyond 60 or -60."""
    top = 0 if small else x.max(axis=1)
    if not small:
        x -= top[:, None]
    np.exp(x, out=x)
    return np.log(x @ np.ones(x.shape[1], dtype=x.dtype)) + top


@dataclass
class Model:
    context: np.ndarray  # order x (symbols + start) x width
    of_class: np.ndarray  # classes x width
    class_bias: np.ndarray
    target: np.ndarray  # symbols x width
    bias: np.ndarray
    first: np.ndarray  # as in the vocabulary; not trained

    @staticmethod
    def new(v: Vocabulary, order: int = ORDER, width: int = WIDTH) -> Model:
        rng = np.random.default_rng(20)
        some = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        n, c = len(v.bias), len(v.class_bias)
        return Model(some(order, n + 1, width), some(c, width), v.class_bias.astype(np.float32), some(n, width), v.bias.astype(np.float32), v.first)

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.of_class, self.class_bias, self.target, self.bias]

    def predicted(self, contexts: list[np.ndarray]) -> np.ndarray:
        h = np.take(self.context[0], contexts[0], axis=0)
        for i in range(1, len(contexts)):
            h += np.take(self.context[i], contexts[i], axis=0)
        return h

    def log_probabilities(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Normalised natural log-probability of each token's symbol."""
        own = _class_of(self.first)[symbol]
        by_class = np.argsort(own, kind="stable")
        out = np.empty(len(symbol))
        edge = np.searchsorted(own[by_class], np.arange(len(self.first)))
        classes, width = self.of_class.shape
        for c, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if a == b:
                continue
            lo, hi = int(self.first[c]), int(self.first[c + 1])
            inside = slice(lo, hi if hi - lo > 1 else lo)  # a class of one symbol has one softmax
            # Both softmaxes by one product, in which a 1 in each row meets the biases.
            both = np.empty((classes + inside.stop - lo, width + 1), dtype=self.of_class.dtype)
            both[:classes, :-1], both[:classes, -1] = self.of_class, self.class_bias
            both[classes:, :-1], both[classes:, -1] = self.target[inside], self.bias[inside]
            most = math.sqrt(float(np.einsum("ij,ij->i", both, both).max()))
            step = max(64, (1 << 17) // len(both))  # products that stay in the cache
            for s in range(a, b, step):
                at = by_class[s : min(b, s + step)]
                h = np.ones((len(at), width + 1), dtype=both.dtype)
                h[:, :-1] = self.predicted([x[at] for x in contexts])
                x = h @ both.T
                small = most * math.sqrt(float(np.einsum("ij,ij->i", h, h).max())) < 60  # then so is every product
                small = small or max(float(x.max()), -float(x.min())) < 60
                found = x[:, c].copy()
                found -= _log_sum(x[:, :classes], small)
                if inside.stop > lo:
                    found += x[np.arange(len(at)), classes + symbol[at] - lo]
                    found -= _log_sum(x[:, classes:], small)
                out[at] = found
        return out


def _class_of(first: np.ndarray) -> np.ndarray:
    """The class of each symbol."""
    return np.repeat(np.arange(len(first) - 1, dtype=np.int16 if len(first) < 1 << 15 else np.int64), np.diff(first))


class Trainer:
    """Noise-contrastive estimation at both levels, with Adagrad steps on the rows that a mini-batch touches."""

    def __init__(self, model: Model, seed: int, noise: int = NOISE, class_noise: int = CLASS_NOISE, rate: float = RATE):
        self.m = Model(*[x.copy() for x in model.arrays()], model.first)
        self.squares = [np.full_like(x, 1e-2) for x in self.m.arrays()]
        self.rng = np.random.default_rng(seed)
        self.noise, self.class_noise, self.rate = noise, class_noise, rate
        # Noise follows the shares of the starting biases in the vocabulary.
        classes = np.exp(model.class_bias.astype(np.float64))
        self.classes = np.cumsum(classes / classes.sum())
        self.log_classes = (np.log(classes / classes.sum()) + math.log(class_noise)).astype(np.float32)
        inside = np.exp(model.bias.astype(np.float64))
        total = np.repeat(np.add.reduceat(inside, model.first[:-1]), np.diff(model.first))
        self.log_inside = (np.log(inside / total) + math.log(noise)).astype(np.float32)
        self.inside = np.cumsum(inside / total)  # class c spans c to c + 1
        self.class_of = _class_of(model.first)

    def step(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> None:
        m, many = self.m, len(symbol)
        # Tokens by class: those of a class share its noise words.
        own = self.class_of[symbol]
        order = np.argsort(own, kind="stable")
        own, symbol, contexts = own[order].astype(np.int64), symbol[order], [c[order] for c in contexts]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        classes = own[begin]
        h = m.predicted(contexts)

        # Classes: one set of noise for the mini-batch.
        x = np.minimum(np.searchsorted(self.classes, self.rng.random(self.class_noise)), len(self.classes) - 1)
        mine = np.take(m.of_class, own, axis=0)
        g = _miss(np.einsum("ij,ij->i", h, mine) + m.class_bias[own] - self.log_classes[own])
        gx = -_hit(h @ m.of_class[x].T + (m.class_bias[x] - self.log_classes[x]))
        dh = g[:, None] * mine + gx @ m.of_class[x]
        at = np.concatenate([classes, x])
        vectors = np.concatenate([np.add.reduceat(g[:, None] * h, begin, axis=0), gx.T @ h])
        weights = np.concatenate([np.add.reduceat(g, begin), gx.sum(axis=0)])
        slopes = [(1, 2, at, vectors, weights)]

        # Symbols: a class of one symbol has nothing to learn.
        real = (np.diff(m.first)[own] > 1).astype(np.float32)
        x = np.searchsorted(self.inside, classes[:, None] + self.rng.random((len(classes), self.noise)))
        x = np.clip(x, m.first[classes][:, None], m.first[classes + 1][:, None] - 1)
        t, shift = m.target[x], m.bias[x] - self.log_inside[x]
        spans = list(zip(begin.tolist(), [*begin[1:].tolist(), many], strict=True))
        other = np.empty((many, self.noise), dtype=np.float32)
        for k, (a, b) in enumerate(spans):
            other[a:b] = h[a:b] @ t[k].T + shift[k]
        mine = np.take(m.target, symbol, axis=0)
        g = _miss(np.einsum("ij,ij->i", h, mine) + m.bias[symbol] - self.log_inside[symbol]) * real
        gx = -_hit(other) * real[:, None]
        dh += g[:, None] * mine
        noise = np.empty_like(t)
        for k, (a, b) in enumerate(spans):
            dh[a:b] += gx[a:b] @ t[k]
            noise[k] = gx[a:b].T @ h[a:b]
        noise = noise.reshape(-1, h.shape[1])
        at = np.concatenate([symbol, x.ravel()])
        slopes.append((3, 4, at, np.concatenate([g[:, None] * h, noise]), np.concatenate([g, np.add.reduceat(gx, begin, axis=0).ravel()])))

        for i, c in enumerate(contexts):
            rows, grad = _by_row(c, dh)
            self._move(m.context[i], self.squares[0][i], rows, grad / many)
        values = m.arrays()
        for vector, bias, at, grad, weight in slopes:
            rows, both = _by_row(at, np.concatenate([grad, weight[:, None]], axis=1))
            self._move(values[vector], self.squares[vector], rows, both[:, :-1] / many)
            self._move(values[bias], self.squares[bias], rows, both[:, -1] / many)

    def _move(self, value: np.ndarray, square: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        total = np.take(square, rows, axis=0)
        total += grad * grad
        square[rows] = total
        value[rows] = np.take(value, rows, axis=0) + self.rate * grad / np.sqrt(total)


def _hit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _miss(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(x, -30, 30)))


def _by_row(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indices, and the sum of the rows of each."""
    order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")  # short numbers are sorted by their digits
    sorted_at = at[order]
    begin = np.flatnonzero(np.diff(sorted_at, prepend=-1))
    return sorted_at[begin], np.add.reduceat(np.take(rows, order, axis=0), begin, axis=0)


def _train_once(docs: DataFrame, v: Vocabulary, model: Model, turn: int, shards: int) -> Model:
    """One round over ``docs`` (key, text): shards by the key, each trained in the key's order, then averaged."""
    shared = docs.sparkSession.sparkContext.broadcast((v, model))
    sizes = [x.size for x in model.arrays()]
    cuts = np.linspace(0, sum(sizes), _SLICES + 1).astype(int).tolist()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, begin = shared.value
        trainer, shard, texts, size, steps, tokens = None, None, [], 0, 0, 0
        seen: list[tuple[np.ndarray, list[np.ndarray]]] = []  # until there are enough steps

        def learn() -> None:
            nonlocal size, steps, tokens, seen
            if not texts:
                return
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            t = tokens_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, voc, len(begin.context))
            tokens += len(t.symbol)
            # A mini-batch takes tokens from all over the chunk.
            every = max(1, -(-len(t.symbol) // BATCH))
            parts = [(t.symbol[i::every], [c[i::every] for c in t.contexts]) for i in range(every)]
            for p in parts:
                trainer.step(*p)
            steps += len(parts)
            seen = seen + parts if steps < LEAST_STEPS else []
            texts.clear()
            size = 0

        def done() -> pa.RecordBatch:
            nonlocal steps
            learn()
            while seen and steps < LEAST_STEPS:
                for p in seen:
                    trainer.step(*p)
                steps += len(seen)
            flat = np.concatenate([x.ravel() for x in trainer.m.arrays()]).astype("<f4")
            parts = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            n = len(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([float(tokens)] * n), pa.array(parts, pa.binary())], names=["slice", "shard", "tokens", "flat"]
            )

        # Chunks follow from the rows alone, not from the batches they come in.
        for batch in batches:
            values = batch.column(1).cast(pa.large_binary())
            for k, value in zip(batch.column(0).to_pylist(), values, strict=True):
                if k != shard:
                    if trainer is not None:
                        yield done()
                    shard, trainer, steps, tokens, seen = k, Trainer(begin, turn * 1_000_003 + k), 0, 0, []
                texts.append(value.as_py() or b"")
                size += len(texts[-1]) + 1
                if size >= CHUNK_BYTES:
                    learn()
        if trainer is not None:
            yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, total, tokens = None, None, 0.0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([(total / tokens).astype("<f8").tobytes()], pa.binary())], names=["slice", "flat"])

        for batch in batches:
            for k, n, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if k != which:
                    if which is not None:
                        yield row()
                    which, total, tokens = k, 0.0, 0.0
                total = total + np.frombuffer(raw, dtype="<f4").astype(np.float64) * n
                tokens += n
        if which is not None:
            yield row()

    dealt = docs.select(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(shards)).cast("int").alias("shard"), "key", "text")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "key").select("shard", "text")
    trained = dealt.mapInArrow(train, "slice int, shard int, tokens double, flat binary")
    sums = trained.repartition(_SLICES, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice int, flat binary").collect()  # _SLICES rows
    shared.unpersist()
    if not sums:
        return model
    flat = np.concatenate([np.frombuffer(r.flat, dtype="<f8") for r in sorted(sums, key=lambda r: r.slice)])
    out, at = [], 0
    for x in model.arrays():
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return Model(*out, model.first)


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, order: int = ORDER, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model after ``rounds`` rounds; each text is in one of them."""
    model = Model.new(v, order, width)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), text.alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-size // (rounds * shard_bytes)))
    for i in range(rounds):
        model = _train_once(rows.where(F.pmod(F.col("key"), F.lit(rounds)) == i), v, model, i + 1, shards)
    return model


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((v, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, m = shared.value
        to_log10 = 1 / math.log(10)
        other = np.zeros(len(voc.bias), dtype=bool)  # the symbols of a class's other words
        other[voc.first[1:-1] - 1] = True
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for a, b in chunks(offsets):
                t = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], voc, len(m.context))
                known = t.count >= 0
                own = np.where(known, np.log10(np.maximum(t.count, 0) + SMOOTH), 0.0)
                n = np.diff(t.first)
                words = np.where(other[t.symbol], own - voc.log_rest[t.symbol], 0.0)
                by_model = m.log_probabilities(t.symbol, t.contexts) * to_log10 + words
                add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every text has its end
                rare = np.flatnonzero(~known)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, t.first), pa.int32()), pa.array(t.word[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array(n, pa.int64()), pa.array(add((t.count > 0).astype(np.int64)), pa.int64()), pa.array(add(own) - n * voc.log_total), pa.array(add(by_model)), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = checkpoint(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"))
    rare = scored.select("row", F.explode("rare").alias("word"))
    met = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.count("n").alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(met, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def report(docs: DataFrame, **how) -> DataFrame:
    """Learns from the rows that are not held out and scores all."""
    training = docs.where(~held_out())
    counts = checkpoint(word_counts(training))
    v = vocabulary(counts)
    return score(docs, counts, v, train(training, v, **how))
