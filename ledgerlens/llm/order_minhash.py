"""Order MinHash fingerprints of texts, in DataFrame expressions only.

Words are runs of [^\\x20\\x09-\\x0D], those over ``PIECE`` characters cut into
pieces of that length. A k-mer is ``KMER`` words in a row (a text of fewer
words, but some, is one k-mer), and the n-th occurrence of a k-mer in a text is
an element of its own. For each of ``SLOTS`` orders of all elements the
``TUPLE`` least ones are selected, put back into their order in the text, and
their k-mers hashed to one signature value. Two texts agree in a slot where the
selected elements are common to both and stand in the same order, so the share
of agreeing slots (``likeness``) falls with edits and with moved passages, not
only with missing words.

The orders: ``SEEDS`` hash functions put the elements on a ring, and each order
begins at another place of a ring and goes round it. Every element of a text is
equally likely to be the least of each order, as with separate permutations,
but a text's elements are sorted once for each seed and each order costs one
binary search. Occurrence numbers come from a sort of (k-mer hash, place).
All is n log n for a text of n words.

``with_next`` gives every row the text that follows it by (doc_id, text hash):
rows are cut into ``BUCKET_ROWS`` or so by keys drawn from the table, the first
text of each bucket also goes to the bucket before, and a window looks one row
ahead within a bucket. Texts are exchanged once. Copies of one key (one doc_id
and text) that are drawn often are dealt over several buckets.

Defined cases: a null text counts as empty. Texts without words have the same
signature (zeros). A null doc_id sorts first; rows with one doc_id follow each
other by their text's hash. Repeated rows follow each other, so the next text
of all but the last is their own. A single row is followed by itself. An empty
table gives no rows. Texts of any length are taken whole (an array of words in
one task; up to 67 million words). ``with_next`` passes other columns through
under their names; its new columns are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let
from .shared import unused

PIECE = 16
KMER = 2
TUPLE = 2
SEEDS = 4
SLOTS = 128

#: Rows that share a bucket of ``with_next``, about; and the most buckets, whose keys the driver holds.
BUCKET_ROWS = 64
MOST_BUCKETS = 65536
#: A key drawn so often, or more, is dealt over a bucket for each quarter of that.
OFTEN = 16

#: Low bits of an element hold its place, the others its hash.
PLACE_BITS = 26
_PLACE = (1 << PLACE_BITS) - 1
_WORD = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _code(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(_PLACE)


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(place)


def _powers(n: Column) -> Column:
    """The powers of two up to n, greatest first; n > 0."""
    return F.transform(F.sequence(F.length(F.bin(n.cast("long"))) - 1, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def _furthest(powers: Column, holds) -> Column:
    """The greatest sum t of powers for which ``holds(t)``, where ``holds`` is true up to some t and false beyond."""
    return F.aggregate(powers, F.lit(0), lambda t, step: F.when(F.coalesce(holds(t + step), F.lit(False)), t + step).otherwise(t))


def _elements(kmers: Column, powers: Column) -> Column:
    """Hashes of (k-mer, occurrence number) with their places, unordered."""

    def numbered(s: Column) -> Column:
        same = lambda x, at: _code(F.get(s, at)) == _code(x)
        nth = lambda x, i: F.when(F.coalesce(same(x, i - 1), F.lit(False)), _furthest(powers, lambda t: same(x, i - t))).otherwise(0)
        return F.transform(s, lambda x, i: _packed(F.xxhash64(_code(x), nth(x, i)), _place(x)))

    return let(F.sort_array(F.transform(kmers, lambda h, i: _packed(h, i.cast("long")))), numbered)


def _starts() -> Column:
    """Where the orders of a seed begin on its ring: evenly spaced."""
    each = SLOTS // SEEDS
    places = [(j * (1 << 64)) // each - (1 << 63) for j in range(each)]
    return F.split(F.lit(" ".join(map(str, places))), " ").cast("array<bigint>")


def _slots(seed: int, elements: Column, kmers: Column, powers: Column) -> Column:
    """The signature values of the orders of one seed."""

    def selected(ring: Column) -> Column:
        n = F.size(ring)

        def value(t: Column) -> Column:
            chosen = F.array_sort(F.array(*[_place(F.get(ring, (t + j) % n)) for j in range(TUPLE)]))
            return let(chosen, lambda c: F.xxhash64(*[F.get(kmers, F.get(c, F.lit(j)).cast("int")) for j in range(TUPLE)]).bitwiseAND(0xFFFF).cast("int"))

        return F.transform(_starts(), lambda s: let(_furthest(powers, lambda t: F.get(ring, t - 1) < s), value))

    ring = elements if seed == 0 else F.transform(elements, lambda x: _packed(F.xxhash64(_code(x), F.lit(seed)), _place(x)))
    return let(F.sort_array(ring), selected)


def signature(text: Column) -> Column:
    """SLOTS numbers under 65536; zeros for a null text or one without words."""

    def of_kmers(kmers: Column) -> Column:
        powers = _powers(F.size(kmers))
        return let(powers, lambda p: let(_elements(kmers, p), lambda e: F.concat(*[_slots(seed, e, kmers, p) for seed in range(SEEDS)])))

    def of_words(w: Column) -> Column:
        kmers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - KMER, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(KMER)]))
        return F.when(F.size(w) > 0, let(kmers, of_kmers)).otherwise(F.array_repeat(F.lit(0), SLOTS))

    return let(words(F.coalesce(text, F.lit(""))), of_words)


def as_text(sig: Column) -> Column:
    """Four hexadecimal digits for each slot."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    return F.size(F.filter(a, lambda v, j: v == F.get(b, j))) / F.lit(float(SLOTS))


def _cuts(keys: DataFrame) -> list[tuple[int, int, int, int]]:
    """(has an id, id, hash, buckets) in order: the least key of the table and keys drawn from its rows."""
    n = keys.count()
    if n == 0:
        return []
    share = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS)) / n
    drawn: dict[tuple[int, int, int], int] = {}
    least = keys.agg(F.min(F.struct("has", "id", "h")).alias("k")).first().k
    drawn[tuple(least)] = 1
    for r in keys.where(F.rand(11) < share).collect():
        drawn[r.has, r.id, r.h] = drawn.get((r.has, r.id, r.h), 0) + 1
    return [(*k, max(1, 4 * times // OFTEN) if times >= OFTEN else 1) for k, times in sorted(drawn.items())]


def with_next(docs: DataFrame, extra: dict[str, Column], following: dict[str, str]) -> DataFrame:
    """``docs`` with the columns ``extra`` worked out, and under new names columns of the next row.

    ``following`` names, for a column of ``docs`` or ``extra``, the new column.
    """
    has, key, h, place, bucket, copy = unused(docs, "has", "key", "hash", "place", "bucket", "copy")
    doc_id = F.col("doc_id")
    parts = {has: doc_id.isNotNull().cast("long"), key: F.coalesce(doc_id, F.lit(0)).cast("long"), h: F.xxhash64("text")}
    cuts = _cuts(docs.select(*[c.alias(name) for c, name in zip(parts.values(), ("has", "id", "h"), strict=True)]))
    carried = list(following)
    rows = docs.withColumns(parts)
    column = lambda j: F.split(F.lit(" ".join(str(c[j]) for c in cuts)), " ").cast("array<bigint>")
    if cuts:
        first = [0]
        for c in cuts:
            first.append(first[-1] + c[3])
        cut = [column(j) for j in range(3)]  # each is folded to one literal (their zip would not be)
        own = [F.col(c) for c in (has, key, h)]

        def reached(at: Column) -> Column:
            a, b, c = (F.get(x, at) for x in cut)
            return (a < own[0]) | ((a == own[0]) & ((b < own[1]) | ((b == own[1]) & (c <= own[2]))))

        firsts = F.split(F.lit(" ".join(map(str, first))), " ").cast("array<bigint>")
        total = first[-1]
        powers = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
        rows = rows.withColumn(place, _furthest(powers, lambda t: reached(t - 1)) - 1)
        last = F.get(firsts, F.col(place) + 1) - 1
        is_cut = (F.get(cut[0], F.col(place)) == own[0]) & (F.get(cut[1], F.col(place)) == own[1]) & (F.get(cut[2], F.col(place)) == own[2])
        width = last - F.get(firsts, F.col(place)) + 1
        dealt = F.when(is_cut & (width > 1), F.get(firsts, F.col(place)) + F.floor(F.rand(12) * width)).otherwise(last)
    else:
        rows, total = rows.withColumn(place, F.lit(0)), 1
        dealt, is_cut, firsts = F.lit(0).cast("long"), F.lit(False), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    main = rows.withColumns({bucket: dealt, copy: F.lit(0)}).withColumns(extra)
    heads = rows.where(is_cut).groupBy(place, has, key, h).agg(*[F.any_value(c).alias(c) for c in docs.columns])
    before = F.transform(F.sequence(F.get(firsts, F.col(place)), F.get(firsts, F.col(place) + 1) - 1), lambda b: (b + total - 1) % total)
    heads = heads.withColumn(bucket, F.explode(before)).withColumn(copy, F.lit(1)).withColumns(extra)
    heads = heads.select(*[F.col(f"`{c}`") if c in (has, key, h, place, bucket, copy, *carried) else F.lit(None).cast(main.schema[c].dataType).alias(c) for c in main.columns])
    ahead = Window.partitionBy(bucket).orderBy(copy, has, key, h)
    out = main.unionByName(heads).withColumns({new: F.lead(F.col(old)).over(ahead) for old, new in following.items()})
    return out.where(F.col(copy) == 0).drop(has, key, h, place, bucket, copy)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with its text's fingerprint in a new column ``fingerprint`` (replaced where there is one)."""
    return docs.withColumn("fingerprint", as_text(signature(F.col("text"))))


def edited(text: Column, following: Column) -> Column:
    """The text with the last half of its code points replaced by the first as many of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike it is to that and to the next document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(rows, {"sig": signature(F.col("text"))}, {"text": "next_text", "sig": "next_sig"})
    changed = both.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    changed = changed.withColumn("edited_sig", signature(F.col("edited")))
    return changed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
