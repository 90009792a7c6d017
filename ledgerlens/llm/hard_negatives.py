"""Hard negatives by an inverted multi-index with certified stops.

A vector's components are taken as floor(scale * x), and a row's score for an
anchor is the integer inner product. For every anchor its ``positives`` best
other rows of the same label are found, and for each of those the best rows of
other labels whose score lies in a window below the positive's
(``low`` <= 100 * score / positive score <= ``high``).

Method: each half of the vectors has a codebook of ``CODEWORDS`` centres
(k-means in numpy on at most about ``SAMPLE_ROWS`` rows, chosen by hash; it
decides the speed alone). A row lies in the cell of its two centres. A half's
score is at most q.c + |q| r, where r is the greatest distance of a row from
its centre, so the sum of two half bounds limits the scores of a cell. The
multi-sequence heap yields a query's cells by falling bound; their rows are
scored exactly, and the search stops when what is asked for is certified: when
the next bound is below the last of the best same-label rows, or for every
positive below its window or below the last of its best rows in the window.
So results are exact, for any codebook and any partitioning.

Every partition's rows are indexed in shards of up to ``SHARD_ROWS`` where they
are read; no vector is exchanged. The anchors are written to the shared folder
and each task reads them in blocks of ``BLOCK_ANCHORS``. A shard hands on the
few best rows for each anchor, and a window over the anchor's shards merges
them. A lost task indexes its shard again.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part. A vector shorter than others counts as continued with
zeros (an empty one scores 0). A row without an id is no anchor; it takes part
otherwise and comes last among ties. Ties go by the smaller id. Rows repeated
with id and vector are different rows, and each is an anchor. Other columns are
not read. An empty table, or one without anchors, gives no rows. Scores of
2^62 and more fail with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder, store

CODEWORDS = 16
SAMPLE_ROWS = 20_000
ROUNDS = 10
SHARD_ROWS = 1 << 18
BLOCK_ANCHORS = 1024
#: Rows scored between two looks at whether the search is certified, at first; the number doubles.
FIRST_LOOK = 256

_NO_ID = np.iinfo(np.int64).max  # sorts last
_POSITIVE = "a bigint, anchor_id bigint, own bigint, positive_id bigint, positive_score bigint"
_NEGATIVE = "a bigint, k int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def codebook(points: np.ndarray, size: int = CODEWORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds, begun at distinct points spread over the sample."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (points @ centres.T), axis=1)


class Shard:
    """Some rows, ordered by cell and label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = len(books[0][0])
        x = vectors.astype(np.float64)
        near = [nearest(p, book) for p, book in zip((x[:, :half], x[:, half:]), books, strict=True)]
        self.books, self.half, self.wide = books, half, len(books[1])
        self.radius = []
        for p, book, c in zip((x[:, :half], x[:, half:]), books, near, strict=True):
            r = np.full(len(book), -np.inf)  # -inf: no row has this centre
            np.maximum.at(r, c, np.sqrt(((p - book[c]) ** 2).sum(axis=1)))
            self.radius.append(r)
        cell = near[0] * self.wide + near[1]
        order = np.lexsort((labels, cell))
        self.ids, self.labels, cell = ids[order], labels[order], cell[order]
        self.norm = float(np.sqrt((x**2).sum(axis=1)).max(initial=0))
        self.vectors, self.x = vectors[order], x[order]
        self.small = self.x.astype(np.float32)
        cells = len(books[0]) * self.wide
        self.first = np.searchsorted(cell, np.arange(cells + 1)).tolist()
        self.part: dict[tuple[int, int], tuple[int, int]] = {}
        edge = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(self.labels, prepend=0) != 0)).tolist()
        for a, b in zip(edge, [*edge[1:], len(cell)], strict=True):
            self.part[int(cell[a]), int(self.labels[a])] = (a, b)

    def rows_for(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the query in a type in which scores are exact."""
        most = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * self.norm
        if most < 1 << 23:
            return self.small, q.astype(np.float32)
        if most < 1 << 52:
            return self.x, q.astype(np.float64)
        if most < 1 << 62:
            return self.vectors, q
        raise ValueError("an inner product may not fit into 64 bits")

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bound: the multi-sequence heap over the two codebooks."""
        q = q.astype(np.float64)
        bounds = []
        for p, book, r in zip((q[: self.half], q[self.half :]), self.books, self.radius, strict=True):
            size = float(np.sqrt((p**2).sum()))
            used = np.flatnonzero(r > -np.inf)
            b = book[used] @ p + size * r[used]
            by = np.argsort(-b, kind="stable")
            bounds.append((b[by].tolist(), used[by].tolist()))
        (b1, c1), (b2, c2) = bounds
        slack = 0.01 + 1e-9 * float(np.sqrt((q**2).sum())) * self.norm
        if not b1 or not b2:
            return
        heap, reached = [(-b1[0] - b2[0], 0, 0)], [0] * (len(c1) + 1)  # reached[i]: cells of row i taken from the heap
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield slack - bound, c1[i] * self.wide + c2[j]
            reached[i] = j + 1
            if j + 1 < len(c2) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-b1[i] - b2[j + 1], i, j + 1))
            if i + 1 < len(c1) and reached[i + 1] == j:
                heapq.heappush(heap, (-b1[i + 1] - b2[j], i + 1, j))

    def best(self, at: np.ndarray, score: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(id, score) of the n best rows by score, then id."""
        if len(at) > n:
            last = np.partition(score, len(score) - n)[len(score) - n]
            near = score >= last
            at, score = at[near], score[near]
        order = np.lexsort((self.ids[at], -score))[:n]
        return list(zip(self.ids[at[order]].tolist(), score[order].tolist(), strict=True))

    def same_label(self, q: np.ndarray, label: int, n: int) -> list[tuple[int, int]]:
        """The n best rows of the label."""
        rows, query = self.rows_for(q)
        at, score, held, look, worst = [], [], 0, max(FIRST_LOOK // 8, n), None
        for bound, cell in self.cells(q):
            if worst is not None and bound < worst:
                break
            span = self.part.get((cell, label))
            if span is None:
                continue
            a, b = span
            at.append(np.arange(a, b))
            score.append(rows[a:b] @ query)
            held += b - a
            if held >= look:
                all_scores = np.concatenate(score)
                worst = np.partition(all_scores, held - n)[held - n]
                look = 2 * held
        if not at:
            return []
        return self.best(np.concatenate(at), np.concatenate(score).astype(np.int64), n)

    def other_labels(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
        """For every window (least, greatest score) the n best rows of other labels in it."""
        rows, query = self.rows_for(q)
        at, score, held, look = [], [], 0, FIRST_LOOK
        certified = min((lo for lo, hi in windows if lo <= hi), default=None)
        if certified is None:
            return [[] for _ in windows]
        for bound, cell in self.cells(q):
            if bound < certified:
                break
            a, b = self.first[cell], self.first[cell + 1]
            if a == b:
                continue
            c, d = self.part.get((cell, label), (b, b))
            for s, e in ((a, c), (d, b)):
                if s < e:
                    at.append(np.arange(s, e))
                    score.append(rows[s:e] @ query)
                    held += e - s
            if held >= look:
                look = 2 * held
                all_scores = np.concatenate(score)
                least = []
                for lo, hi in windows:
                    if lo <= hi:
                        inside = all_scores[(all_scores >= lo) & (all_scores <= hi)]
                        least.append(np.partition(inside, len(inside) - n)[len(inside) - n] if len(inside) >= n else lo)
                certified = min(least)
        if not at:
            return [[] for _ in windows]
        where, got = np.concatenate(at), np.concatenate(score).astype(np.int64)
        out = []
        for lo, hi in windows:
            inside = (got >= lo) & (got <= hi)
            out.append(self.best(where[inside], got[inside], n))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` whole numbers, filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _shards(batches: Iterator[pa.RecordBatch], width: int, books: tuple[np.ndarray, np.ndarray]) -> Iterator[Shard]:
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if len(batch):
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            held.append((ids, batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), width)))
        if sum(len(h[0]) for h in held) >= SHARD_ROWS:
            yield Shard(*map(np.concatenate, zip(*held, strict=True)), books)
            held = []
    if held:
        yield Shard(*map(np.concatenate, zip(*held, strict=True)), books)


def _blocks(uri: str) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the shared folder, some at a time."""
    system, path = store(uri)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BLOCK_ANCHORS)


def _name(i: int) -> int | None:
    return None if i == _NO_ID else i


def _find_positives(uri: str, width: int, books: tuple[np.ndarray, np.ndarray], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, width, books):
            for block in _blocks(uri):
                q = _matrix(block.column("v").combine_chunks() if isinstance(block.column("v"), pa.ChunkedArray) else block.column("v"), width)
                out = []
                for i, (a, anchor, label) in enumerate(zip(*(block.column(c).to_pylist() for c in ("a", "vec_id", "label")), strict=True)):
                    own = int(sum(int(x) * int(x) for x in q[i]))
                    out += [(a, anchor, own, _name(p), s) for p, s in shard.same_label(q[i], label, n + 1)]
                yield _batch(out, ("a", "anchor_id", "own", "positive_id", "positive_score"))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if name == "k" else pa.int64()) for c, name in zip(columns, names, strict=True)], names=list(names))


def _find_negatives(uri: str, width: int, books: tuple[np.ndarray, np.ndarray], n: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, width, books):
            for block in _blocks(uri):
                q = _matrix(block.column("v"), width)
                out = []
                for i, (a, anchor, label, found) in enumerate(zip(*(block.column(c).to_pylist() for c in ("a", "vec_id", "label", "found")), strict=True)):
                    windows = [(-(-low * f["positive_score"] // 100), high * f["positive_score"] // 100) for f in found]
                    for f, rows in zip(found, shard.other_labels(q[i], label, windows, n), strict=True):
                        out += [(a, f["k"], anchor, f["positive_id"], f["positive_score"], _name(r), s) for r, s in rows]
                yield _batch(out, ("a", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return run


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole components) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: vec_id, label, embedding."""
    spark = rows.sparkSession
    vectors = usable(rows)
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    out = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if not n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    width = max(width, 2)
    folder = shared_folder(spark, "hard-negatives")
    chosen = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n)) < SAMPLE_ROWS
    drawn = vectors.where(chosen).limit(2 * SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    drawn = _matrix(drawn.chunk(0) if isinstance(drawn, pa.ChunkedArray) and drawn.num_chunks else drawn, width) if len(drawn) else np.zeros((1, width), dtype=np.int64)
    books = (codebook(drawn[:, : width // 2]), codebook(drawn[:, width // 2 :]))

    vectors.where(is_anchor).withColumn("a", F.monotonically_increasing_id()).write.parquet(f"{folder}/anchors")
    near = vectors.mapInArrow(_find_positives(f"{folder}/anchors", width, books, positives), _POSITIVE)
    ranked = Window.partitionBy("a").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    near = near.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= positives + 1)
    # The anchor itself, or a row that can't be told from it, is the first with its id and its own score.
    itself = F.col("positive_id").eqNullSafe(F.col("anchor_id")) & (F.col("positive_score") == F.col("own"))
    found = near.groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("found"),
        F.coalesce(F.min(F.when(itself, F.col("k"))), F.lit(positives + 1)).alias("self"),
    )
    others = F.slice(F.filter("found", lambda f: f["k"] != F.col("self")), 1, positives)
    found = found.select("a", others.alias("found")).where(F.size("found") > 0)
    anchors = spark.read.parquet(f"{folder}/anchors")
    anchors.join(found, "a").write.parquet(f"{folder}/windows")

    far = vectors.mapInArrow(_find_negatives(f"{folder}/windows", width, books, negatives, low, high), _NEGATIVE)
    ranked = Window.partitionBy("a", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    far = far.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return far.select(*out)
