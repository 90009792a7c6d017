"""Language identification with bit-sliced Bloom filters of letter trigrams.

A filter slot is a bit mask of languages (a 64-bit word for every 64 of them), so
one lookup (the AND of a trigram's slots) returns all languages that contain the
trigram. A text's languages are
compared by their popcounts over the text's trigrams, each corrected for the
filter's false positives in that language's slice: of n lookups with h hits and
rate f, (h - n f) / (1 - f) are taken as real.

Every letter gives one trigram: the letter with its two neighbours, lower-cased,
where what is no letter counts as a blank. Three code points fit 63 bits, so
trigrams are exact.

Learning counts the trigrams of all given rows (summed in the tasks, then by
trigram). A language contains every trigram whose frequency in it is at least
``SHARE`` of the trigram's greatest frequency in any language, however rare it
is; so foreign passages do not enter. The filter has ``PER_GRAM`` slots or more
for each trigram of the richest language. Where that passes ``PART_SLOTS`` or
``PART_BYTES``, the trigrams are dealt over several filters (``SplitFilter``); the
texts are scanned with one after the other, and the real hits are summed. So the
driver collects and broadcasts one bounded filter at a time.

Defined cases: null texts, and texts without a letter, are ``und`` with score 0.
Where no trigram is known, the language with the most training trigrams is
given, with score 0; with no training row all is ``und``. Ties go to the language
with more training trigrams, then by name. Repeated rows count and are answered
each for itself. Columns other than those named are not read. Any number of distinct
labels is learned; their names and totals are held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import chunks, mix64, utf8

#: Least slots of a filter, and slots for each trigram of the richest language.
SLOTS = 1 << 20
PER_GRAM = 4
#: Bounds of one filter; a larger one is split.
PART_SLOTS = 1 << 22
PART_BYTES = 1 << 25
HASHES = 3
SHARE = 0.25
UNKNOWN = "und"
#: Distinct trigrams that a task holds before it gives them out.
_HELD = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all letters, index of each one's text)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), dtype="<u4")
    letter = _letters()[code]
    at = np.flatnonzero(letter)
    c = np.where(letter, code, 0).astype(np.uint64)
    grams = (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1]
    ends = np.cumsum([len(t) + 1 for t in low])
    return grams, np.searchsorted(ends, at - 1, side="right")


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix64(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(hashes):
        yield (h & np.uint64(slots - 1)).astype(np.int64)
        h = h + step


def _decoded(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = utf8(batch.column(column))
    for a, b in chunks(offsets):
        body = data[offsets[a] : offsets[b]].tobytes()
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        yield a, b, [body[x:y].decode() for x, y in zip(at, at[1:], strict=False)]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang) with both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                for a in range(0, len(g), 100_000):
                    part = g[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(n[a : a + 100_000], pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for a, b, texts in _decoded(batch, 0):
                langs = batch.column(1).slice(a, b - a).to_pylist()
                grams, doc = trigrams(texts)
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])[doc]
                for i, lang in enumerate(names):
                    g, n = np.unique(grams[of == i], return_counts=True)
                    if lang in held:
                        both = np.concatenate([held[lang][0], g])
                        g, back = np.unique(both, return_inverse=True)
                        n = np.bincount(back, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = (g, n)
                if sum(len(g) for g, _ in held.values()) > _HELD:
                    yield from give()
        yield from give()

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return mix64(grams ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(parts)


def _judged(langs: list[str], real: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score from the real hits (languages x texts) among each text's ``n`` trigrams."""
    if not langs:
        return [UNKNOWN] * len(n), np.zeros(len(n))
    real = np.clip(real, 0, n)
    score = np.where(n > 0, real.max(axis=0) / np.maximum(n, 1), 0.0)
    return [langs[b] if k else UNKNOWN for b, k in zip(real.argmax(axis=0), n, strict=True)], score


class LanguageFilter:
    """The languages of trigrams; of several parts, one holds the trigrams dealt to it."""

    def __init__(self, langs: list[str], table: np.ndarray, hashes: int, part: int = 0, parts: int = 1):
        """``table``: words x slots; language i is bit i % 64 of word i // 64."""
        self.langs, self.hashes, self.part, self.parts = langs, hashes, part, parts
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.dtype(k).itemsize * 8 >= len(langs)), np.uint64)
        self.table = table.astype(kind)
        self.false_rate = np.array([float(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** hashes for i in range(len(langs))])

    def contained(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The mask of the languages of one word that contain each trigram (or seem to)."""
        mask, table = None, self.table[word]
        for s in slots_of(grams, len(table), self.hashes):
            mask = table[s] if mask is None else mask & table[s]
        return mask

    def real(self, grams: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        """Hits less the false ones, languages x texts, among this part's trigrams."""
        if self.parts > 1:
            own = _part_of(grams, self.parts) == self.part
            grams, doc = grams[own], doc[own]
        n = np.bincount(doc, minlength=texts).astype(float)
        out = np.empty((len(self.langs), texts))
        for i, f in enumerate(self.false_rate):
            if i % 64 == 0:
                mask = self.contained(grams, i // 64)
            hits = np.bincount(doc, weights=(mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), minlength=texts)
            out[i] = (hits - n * f) / max(1e-9, 1 - f)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, doc = trigrams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        return _judged(self.langs, self.real(grams, doc, len(texts)), n)


class SplitFilter:
    """A filter over the bounds of one: ``parts`` filters of ``slots`` each, made when they are asked for."""

    def __init__(self, langs: list[str], kept: DataFrame, slots: int, hashes: int, parts: int):
        self.langs, self.kept, self.slots, self.hashes, self.parts = langs, kept, slots, hashes, parts

    def part(self, part: int) -> LanguageFilter:
        return _filled(self.kept, self.langs, self.slots, self.hashes, part, self.parts)


def _filled(kept: DataFrame, langs: list[str], slots: int, hashes: int, part: int = 0, parts: int = 1) -> LanguageFilter:
    """One part's filter of the rows (gram, langs: numbers of its languages)."""
    words = -(-len(langs) // 64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words * slots, dtype=np.uint64)  # word after word
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            lists = batch.column(1)
            lang = lists.flatten().to_numpy()
            bits, base = np.uint64(1) << (lang % 64).astype(np.uint64), lang.astype(np.int64) // 64 * slots
            each = np.repeat(np.arange(len(grams)), lists.value_lengths().to_numpy())
            own = _part_of(grams, parts)[each] == part
            for s in slots_of(grams[each[own]], slots, hashes):
                np.bitwise_or.at(table, base[own] + s, bits[own])
        at = np.flatnonzero(table)
        for a in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000], pa.int64()), pa.array(table[at[a : a + 100_000]].view(np.int64), pa.int64())], names=["slot", "mask"])

    got = kept.coalesce(32).mapInArrow(fill, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most `words * slots` rows
    table = np.zeros(words * slots, dtype=np.int64)
    table[got["slot"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64)
    return LanguageFilter(langs, table.view(np.uint64).reshape(words, slots), hashes, part, parts)


def learn(labelled: DataFrame, slots: int | None = None, hashes: int = HASHES, floor: float = 0.0, share: float = SHARE, part_slots: int = PART_SLOTS, part_bytes: int = PART_BYTES) -> LanguageFilter | SplitFilter:
    """The filter of all rows (text, lang). ``slots`` (a power of two) replaces the measured number."""
    from .shared import checkpoint

    counts = checkpoint(gram_counts(labelled))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()
    langs = [r.lang for r in totals]
    if not langs:
        return LanguageFilter([], np.zeros((1, slots or SLOTS), dtype=np.uint64), hashes)
    numbered = labelled.sparkSession.createDataFrame([(r.lang, i, float(r.n)) for i, r in enumerate(totals)], "lang string, i int, total double")
    each = counts.join(F.broadcast(numbered), "lang").select("gram", F.struct("i", (F.col("n") / F.col("total")).alias("p")).alias("x"))
    per_gram = each.groupBy("gram").agg(F.collect_list("x").alias("xs"), F.max("x.p").alias("top"))
    own = F.filter("xs", lambda x: (x["p"] >= F.lit(floor)) & (x["p"] >= F.col("top") * share))
    kept = checkpoint(per_gram.select("gram", F.transform(own, lambda x: x["i"]).alias("langs")).where(F.size("langs") > 0))
    if slots is None:
        most = kept.select(F.explode("langs").alias("i")).groupBy("i").count().agg(F.max("count")).first()[0] or 0
        slots = max(SLOTS, 1 << (PER_GRAM * most - 1).bit_length())
    width = 8 * -(-len(langs) // 64)
    bound = 1 << (max(1, min(part_slots, part_bytes // width)).bit_length() - 1)
    if slots > bound:
        return SplitFilter(langs, kept, bound, hashes, slots // bound)
    return _filled(kept, langs, slots, hashes)


def _with_real(rows: DataFrame, model: SplitFilter) -> DataFrame:
    """``rows`` with one more column: each language's real hits, summed over the parts one after the other."""
    from .shared import checkpoint, unused

    column = rows.columns.index("text")
    rows = rows.withColumn(unused(rows, "real")[0], F.lit(None).cast("array<double>"))
    for part in range(model.parts):
        shared = rows.sparkSession.sparkContext.broadcast(model.part(part))

        def add(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in _decoded(batch, column):
                    real = shared.value.real(*trigrams(texts), b - a).T.ravel()
                    if part:
                        real = real + batch.column(batch.num_columns - 1).slice(a, b - a).flatten().to_numpy()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(real) + 1, len(shared.value.langs)), pa.int32()), pa.array(real))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], lists], names=batch.schema.names)

        rows = checkpoint(rows.mapInArrow(add, rows.schema))
        shared.destroy()
    return rows


def _answered(rows: DataFrame, model: LanguageFilter | SplitFilter, answer, schema) -> DataFrame:
    """``answer(slice of a batch, texts, languages, scores)`` of all ``rows``; the slice has their own columns."""
    column, width = rows.columns.index("text"), len(rows.columns)
    langs = model.langs
    split = isinstance(model, SplitFilter)
    if split:
        rows = _with_real(rows, model)
    shared = None if split else rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _decoded(batch, column):
                piece = batch.slice(a, b - a)
                if split:
                    real = piece.column(width).flatten().to_numpy().reshape(b - a, len(langs)).T
                    found = _judged(langs, real, np.bincount(trigrams(texts)[1], minlength=b - a).astype(float))
                else:
                    found = shared.value.predict(texts)
                yield answer(piece.select(list(range(width))), texts, *found)

    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: LanguageFilter | SplitFilter) -> DataFrame:
    """doc_id, lang_pred and score (the share of the text's trigrams that are in the language) of every row."""

    def answer(piece: pa.RecordBatch, texts: list[str], langs: list[str], score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _answered(rows, model, answer, "doc_id long, lang_pred string, score double")


def thresholds(labelled: DataFrame, model: LanguageFilter | SplitFilter, least: float) -> dict[str, float]:
    """For each language, ``least`` times the median score of the texts labelled with it."""

    def answer(piece: pa.RecordBatch, texts: list[str], langs: list[str], score: np.ndarray) -> pa.RecordBatch:
        known = pa.array(np.array(langs, dtype=object) != UNKNOWN)
        return pa.RecordBatch.from_arrays([piece.column(1).filter(known), pa.array(score, pa.float64()).filter(known)], names=["lang", "score"])

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = _answered(rows, model, answer, "lang string, score double").groupBy("lang").agg(F.percentile_approx("score", 0.5).alias("mid"))
    return {r.lang: least * r.mid for r in found.collect()}


def keep_known(docs: DataFrame, model: LanguageFilter | SplitFilter, least: float | dict[str, float]) -> DataFrame:
    """``docs`` with its own columns, without texts that are ``und`` or score below ``least`` (of their language).

    A model without languages keeps every text with a letter.
    """

    def answer(piece: pa.RecordBatch, texts: list[str], langs: list[str], score: np.ndarray) -> pa.RecordBatch:
        if some:
            bound = np.array([least.get(x, 0.0) for x in langs]) if isinstance(least, dict) else least
            return piece.filter(pa.array((np.array(langs, dtype=object) != UNKNOWN) & (score >= bound)))
        return piece.filter(pa.array(np.bincount(trigrams(texts)[1], minlength=len(texts)) > 0))

    some = bool(model.langs)
    return _answered(docs, model, answer, docs.schema)


def fold(parts: int) -> F.Column:
    """crc32 of doc_id as text modulo ``parts``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts
