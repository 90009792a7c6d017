"""Near duplicates by BagMinHash signatures, bands, and verified multiset overlap.

A document is the multiset of its runs of five words (fewer words, but some:
one run of all). Two documents are linked where the multiset Jaccard similarity
(sum of the lesser counts over sum of the greater) is 0.8 or more; classes are
the connected components of the links. Words are runs without white space
(\\x20, \\x09-\\x0D), A-Z as a-z.

Steps: (1) one pass gives each row its text's MD5 and the band keys of its
signature; texts stay where they are. (2) Equal texts become one node, so a
group of copies costs one row from here on. (3) In every band bucket each node
is compared with the bucket's pivot, a node in the midst of the others; pairs
are verified on the texts, and verified links give components. (4) In buckets
that still hold several components, the nodes outside the largest are compared
with all others, block by block (``_links_across``). So no link between
candidates is lost, and pairs inside one component, which cannot change the
result, are not made.

With 24 bands of 5 values a pair at similarity 0.8 shares no bucket with
probability 7e-5 (0.85: 8e-7, 0.9: 1e-9).

Defined cases: a null text is alone in its class. Texts without words are equal
only as whole texts. Rows with the same doc_id and text are one document.
One document of each class is kept: the one with the least doc_id (null first)
and, where several texts have that id, the least MD5. Empty texts are equal
texts without words. An empty table has no classes. A very long text is signed
and compared whole, by one task. Extra columns are not read by ``classes`` and
are passed through by ``dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import checkpoint, unused
from .textbatch import SPACED, chunks, mix64, seeded, utf8, words_of

SHINGLE = 5
BANDS = 24
ROWS = 5
#: Similarity as a fraction of whole numbers, compared exactly.
AT_LEAST = (4, 5)

#: Texts of a bucket that a task holds on either side.
BLOCK = 128
#: Stands for a null doc_id where a key is needed; it sorts first.
NO_ID = -(1 << 63)

_KEY_BITS = np.uint64(12)  # a chunk has at most 4096 documents; the key keeps 52 bits


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document << 52 | shingle key) and their counts, for at most 4096 documents."""
    w = words_of(data, offsets, SPACED)
    at, h = w.window_hash(width)
    doc = w.doc[at]
    count = np.diff(w.first)
    parts = [(doc.astype(np.uint64) << np.uint64(52)) | (h >> _KEY_BITS)]
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            at, h = w.window_hash(k)
            own = np.isin(w.doc[at], short)
            parts.append((w.doc[at][own].astype(np.uint64) << np.uint64(52)) | (h[own] >> _KEY_BITS))
    return np.unique(np.concatenate(parts), return_counts=True)


def bag_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of weighted sets; equal values meet with the weighted Jaccard probability.

    Every key owns, over its weight axis, a Poisson process of (time, place)
    points that is the same in all documents. The axis is cut into the levels
    [0,1), [1,2), [2,4), [4,8) ..., each with one process of the rate of its
    width; a point's unit cell within the level comes from successive halvings
    (the bits of a hash), and it counts where the cell lies below the key's
    weight. A signature value is the id of the earliest point at its place.
    Points are made in rounds, and only for processes whose last time is still
    below the latest value of their document's signature.
    """
    sig = np.zeros(docs * size, dtype=np.uint64)
    best = np.full(docs * size, np.inf)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    e = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(e)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, weight = doc[e], weight[e].astype(np.uint64)
    rate = np.where(level > 1, np.exp2(level - 1), 1.0)
    low = np.where(level > 0, rate, 0).astype(np.uint64)
    state = mix64(key[e] ^ (seeded(64, 5)[level]))
    time = np.zeros(len(e))
    made = np.zeros(len(e), dtype=np.uint64)
    total = np.bincount(doc, weights=rate, minlength=docs)
    # Enough points for all places of a signature, as each place is met by chance.
    many = np.minimum(np.maximum(1, 1.2 * size * np.log(size + 1) / np.maximum(total, 1))[doc] * rate, 4096).astype(np.int64)
    while len(doc):
        p = np.repeat(np.arange(len(doc)), many)
        begin = np.cumsum(many) - many
        nth = (np.arange(len(p)) - begin[p]).astype(np.uint64) + made[p]
        point = mix64(state[p] + nth * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[p]
        run = np.cumsum(gap)
        when = run - (run[begin] - gap[begin])[p] + time[p]
        other = mix64(point ^ np.uint64(0xA0761D6478BD642F))
        cell = low[p] + (other & (np.maximum(low[p], np.uint64(1)) - np.uint64(1)))
        place = doc[p] * size + (((other >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        ok = cell < weight[p]
        np.minimum.at(best, place[ok], when[ok])
        won = np.flatnonzero(ok)
        won = won[when[won] == best[place[won]]]
        sig[place[won]] = point[won]
        time = when[begin + many - 1]
        made = made + many.astype(np.uint64)
        open_docs = np.unique(doc)
        latest = np.zeros(docs)
        latest[open_docs] = best.reshape(docs, size)[open_docs].max(axis=1)
        go = time < latest[doc]
        doc, weight, rate, low, state, time, made = (x[go] for x in (doc, weight, rate, low, state, time, made))
        left = np.bincount(doc, weights=rate, minlength=docs)
        many = np.clip(size / np.maximum(left, 1)[doc] * rate, 1, 4096).astype(np.int64)
    return sig.reshape(docs, size)


def band_keys(data: np.ndarray, offsets: np.ndarray, width: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys as docs x bands, whether the document has shingles)."""
    n = len(offsets) - 1
    both, count = shingles(data, offsets, width)
    doc = (both >> np.uint64(52)).astype(np.int64)
    sig = bag_min_hash(doc, both & np.uint64((1 << 52) - 1), count, n, bands * rows).reshape(n, bands, rows)
    out = np.broadcast_to(seeded(bands, 9), (n, bands)).copy()
    for r in range(rows):
        out = mix64(out ^ sig[:, :, r])
    return out.view(np.int64), np.bincount(doc, minlength=n) > 0


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in chunks(offsets):
        for x in range(a, b, 4096):
            yield x, min(b, x + 4096)


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """at, fp (MD5 of the text) and band keys (null where there is no shingle) of every row with a text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in _runs(offsets):
                own = offsets[a : b + 1]
                keys, some = band_keys(data[own[0] : own[-1]], own - own[0], width, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["at", "fp", "bands"])

    return _texts(docs).mapInArrow(sign, "at long, fp binary, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where(F.col("text").isNotNull()).select(_at(), F.unhex(F.md5(text)).alias("fp"), text.alias("body"))


def _at() -> F.Column:
    """doc_id as a key that is never null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, at_least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of node ids whose ``texts`` (id, body) are similar enough."""
    rows = pairs.join(texts.select(F.col("id").alias("u"), F.col("body").alias("u_text")), "u").join(texts.select(F.col("id").alias("v"), F.col("body").alias("v_text")), "v").select("u", "v", "u_text", "v_text")
    num, den = at_least

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ud, uo), (vd, vo) = utf8(batch.column(2)), utf8(batch.column(3))
            for a, b in _runs(uo + vo):
                x, nx = shingles(ud[uo[a] : uo[b]], uo[a : b + 1] - uo[a], width)
                y, ny = shingles(vd[vo[a] : vo[b]], vo[a : b + 1] - vo[a], width)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                n = b - a
                of = lambda keys, weights: np.bincount((keys >> np.uint64(52)).astype(np.int64), weights=weights, minlength=n).astype(np.int64)
                both = of(x[i], np.minimum(nx[i], ny[j]))
                either = of(x, nx) + of(y, ny) - both
                keep = pa.array((either > 0) & (den * both >= num * either))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).filter(keep), batch.column(1).slice(a, n).filter(keep)], names=["u", "v"])

    return rows.mapInArrow(verify, "u long, v long").distinct()


def _features(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, features per row): the n-th time a shingle stands in a text is a feature of its own,
    so that the overlap of multisets is that of sets."""
    data, offsets = utf8(texts)
    rows, keys, sizes = [], [], []
    for a, b in _runs(offsets):
        own = offsets[a : b + 1]
        both, n = shingles(data[own[0] : own[-1]], own - own[0], width)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = (both >> np.uint64(52)).astype(np.int64)
        keys.append(mix64(np.repeat(both & np.uint64((1 << 52) - 1), n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        rows.append(a + np.repeat(row, n))
        sizes.append(np.bincount(row, weights=n, minlength=b - a).astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sizes)


def _similar(x: np.ndarray, y: np.ndarray, first: np.ndarray, keys: np.ndarray, sizes: np.ndarray, at_least: tuple[int, int]) -> np.ndarray:
    """Which rows of ``x`` are similar enough to which of ``y`` (a matrix); a row's features are keys[first[i]:first[i + 1]]."""
    parts = [np.concatenate([keys[first[i] : first[i + 1]] for i in side]) for side in (x, y)]
    shared = np.intersect1d(*parts)
    overlap = np.zeros((len(x), len(y)), dtype=np.int64)
    for a in range(0, len(shared), 4096):
        some = shared[a : a + 4096]
        inside = []
        for side, part in zip((x, y), parts, strict=True):
            at = np.minimum(np.searchsorted(some, part), len(some) - 1)
            hit = some[at] == part
            m = np.zeros((len(side), len(some)), dtype=np.float32)
            m[np.repeat(np.arange(len(side)), sizes[side])[hit], at[hit]] = 1
            inside.append(m)
        overlap += (inside[0] @ inside[1].T).astype(np.int64)
    num, den = at_least
    either = sizes[x][:, None] + sizes[y][None, :] - overlap
    return (either > 0) & (den * overlap >= num * either)


def _links_across(buckets: DataFrame, labels: DataFrame, texts: DataFrame, width: int, at_least: tuple[int, int]) -> DataFrame:
    """All links (u, v) between different components inside one bucket.

    In a bucket the nodes outside its largest component are held against all its
    nodes, block by block: each side is dealt into blocks of about ``BLOCK``
    texts, and a task sees two blocks at a time, whatever a bucket's size. Only
    links leave the tasks; no rows are made for pairs.
    """
    marked = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    mixed = marked.join(parts, "key").select(
        "key", "id", "label", (F.col("label") != F.col("main")).alias("outside"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("x_blocks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("y_blocks")
    )
    spread = F.xxhash64("id", F.lit(1))
    own_x, own_y = F.pmod(spread, F.col("x_blocks")), F.pmod(spread, F.col("y_blocks"))
    x = mixed.where("outside").select("key", "id", "label", F.lit(0).alias("side"), own_x.cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)).alias("y"))
    y = mixed.select("key", "id", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("x"), own_y.cast("int").alias("y"))
    rows = x.unionByName(y).join(texts, "id").select("key", "x", "y", "side", "id", "label", "body")
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(table):
                return
            block = table.combine_chunks().to_batches()[0]
            side, ids, label = (block.column(i).to_numpy() for i in (3, 4, 5))
            _, keys, sizes = _features(block.column(6), width)
            first = np.concatenate([[0], np.cumsum(sizes)])
            edges = _group_edges(block)
            u, v = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mid = a + int(np.searchsorted(side[a:b], 1))
                if mid in (a, b):
                    continue
                i, j = np.nonzero(_similar(np.arange(a, mid), np.arange(mid, b), first, keys, sizes, at_least) & (label[a:mid, None] != label[None, mid:b]))
                u.append(ids[a + i])
                v.append(ids[mid + j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = int(_group_edges(table)[-2]) if len(table) else 0
            if last:  # the last group may go on in the next batch
                yield from links(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    found = dealt.mapInArrow(compare, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _group_edges(block) -> np.ndarray:
    """Where runs of equal (key, x, y) begin in sorted rows, and the end."""
    if not len(block):
        return np.array([0])
    change = np.zeros(len(block) - 1, dtype=bool)
    for i in range(3):
        c = block.column(i).to_numpy()
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(block)]])


def classes(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, at_least: tuple[int, int] = AT_LEAST) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), kept (it has the class's least (doc_id, MD5)), at and fp; one row per row of ``docs``."""
    signed = _signed(docs, width, bands, rows)
    # Copies become one node; its id holds because the frame is checkpointed.
    nodes = checkpoint(signed.groupBy("fp").agg(F.min("at").alias("at"), F.first("bands").alias("bands")).select(F.monotonically_increasing_id().alias("id"), "fp", "at", "bands"))
    all_buckets = nodes.where("bands is not null").select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("key"))
    sizes = all_buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = checkpoint(all_buckets.join(sizes, "key"))
    # The pivot of a bucket is the node with the most company in all its buckets: of a group of near copies, one near their middle.
    company = buckets.groupBy("id").agg(F.sum("n").alias("company"))
    pivots = buckets.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", "id")).alias("v"))
    near = buckets.join(pivots, "key").where("id != v").select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()

    # Only texts that share a bucket leave their place, once.
    wanted = nodes.select("id", "at", "fp").join(buckets.select("id").distinct(), "id")
    # Rows that repeat an id and its text are one text, put together where they are first.
    bodies = _texts(docs).groupBy("at", "fp").agg(F.any_value("body").alias("body"))
    texts = checkpoint(bodies.join(wanted, ["at", "fp"]).select("id", "body"))
    edges = checkpoint(_verified(near, texts, width, at_least))
    labels = components(edges)

    more = checkpoint(_links_across(buckets.select("key", "id"), labels, texts, width, at_least))
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    grouped = nodes.select("id", "fp", "at").join(labels, "id", "left").select("fp", "at", F.coalesce("label", "id").alias("label"))
    least = grouped.groupBy("label").agg(F.min(F.struct("at", "fp")).alias("first"))
    named = grouped.join(least, "label").select("fp", F.col("first.at").alias("least"), (F.col("first.fp") == F.col("fp")).alias("first"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _at(), F.unhex(F.md5(F.col("text").cast("string"))).alias("fp"))
    least_id = F.coalesce("least", "at")
    return ids.join(named, "fp", "left").select("doc_id", F.when(least_id != NO_ID, least_id).alias("class_id"), ((least_id == F.col("at")) & F.coalesce("first", F.lit(True))).alias("kept"), "at", "fp")


def report(docs: DataFrame, **how) -> DataFrame:
    return classes(docs, **how).select("doc_id", "class_id", "kept")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with its own columns, one document of each class: the one with the least (doc_id, MD5)."""
    found = checkpoint(classes(docs, **how))
    at, fp = unused(docs, "at", "fp")
    gone = found.where("not kept").select(F.col("at").alias(at), F.col("fp").alias(fp)).distinct()
    here = F.unhex(F.md5(F.col("text").cast("string")))
    out = docs.join(gone, (_at() == F.col(at)) & (here == F.col(fp)), "left_anti")
    if not found.groupBy("at").count().where("count > 1").isEmpty():
        # Rows that repeat a doc_id: one of each (doc_id, text) stays.
        out = out.withColumn(fp, here).dropDuplicates(["doc_id", fp]).drop(fp)
    return out
