"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule says which documents it rejects. On a sample each rule's cost (seconds
for the sample) and selectivity (share it rejects) are measured, and rules are
ordered by rejections per cost: once one rejects a document, the others are not
worked out for it. The verdict does not depend on the order, so neither the
sample nor the clock changes a result.

Words are runs of [^\\x20\\x09-\\x0D]. A document is rejected for
 - fewer than 50 words,
 - more than half of its words in repeated 3-word windows,
 - more than one symbol of #*$%&|<> for each four words,
 - more than 40 % repeated lines,
 - a mean word length under 3 or over 12,
 - more than 40 % capitals A-Z among the characters of its words,
 - less than 70 % words with a letter.

Defined cases: null and empty texts have no words, so they fail the first rule.
Repeated rows are judged each for itself; other columns are not read by
``report`` and are passed through by ``keep``. An empty table keeps the rules in
their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let
from .shared import sample

#: About the rows of the sample that orders the rules.
SAMPLE_ROWS = 1000
#: What a rule costs at least, below which times are not told apart.
LEAST_SECONDS = 1e-3

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_counts(text: Column) -> Column:
    """struct(n, dup): lines, and those equal to an earlier one."""
    return let(lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    Windows are sorted as hash bits above position bits; those with an equal
    neighbour are then compared as text, and the union of the repeated ones is
    counted. Sorting keeps this n log n for texts of any length.
    """

    def from_sorted(s: Column, b: Column) -> Column:
        code = lambda x: F.call_function("shiftright", x, b)
        near = F.filter(s, lambda x, j: F.coalesce(code(x) == code(F.get(s, j - 1)), F.lit(False)) | F.coalesce(code(x) == code(F.get(s, j + 1)), F.lit(False)))
        place = F.transform(near, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1))
        return F.when(F.size(near) == 0, F.lit(0).cast("long")).otherwise(let(place, exact))

    def exact(places: Column) -> Column:
        as_text = F.transform(places, lambda p: F.struct(F.concat_ws(" ", *[F.get(w, (p + k).cast("int")) for k in range(3)]).alias("g"), p.alias("p")))

        def repeated(c: Column) -> Column:
            kept = F.filter(c, lambda x, j: F.coalesce(x["g"] == F.get(c, j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(c, j + 1)["g"], F.lit(False)))
            at = F.sort_array(F.transform(kept, lambda x: x["p"]))
            none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, none, step, lambda a: a["n"])

        return let(F.array_sort(as_text), repeated)

    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))

    def windows(b: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long")))
        return let(F.sort_array(keys), lambda s: from_sorted(s, b))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(bits, windows))


def n_capitals(w: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(w, ""), "[^A-Z]+", "")).cast("long")


def n_lettered(w: Column) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long")


@dataclass(frozen=True)
class Parts:
    """What rules read of a document: expressions, or columns where they are worked out already."""

    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    line_counts: Column
    n_repeat_words: Column


def parts(text: Column, w: Column) -> Parts:
    return Parts(w, F.size(w), word_chars(w), n_symbols(text), line_counts(text), n_repeat_words(w))


@dataclass(frozen=True)
class Rule:
    """``rejects(parts)`` is true for the documents that the rule rejects."""

    name: str
    rejects: Callable[[Parts], Column]


def few_words(n: Column) -> Column:
    return n < 50


def repeats(n: Column, repeated: Column) -> Column:
    return repeated * 100 > n * 50


BASE = (
    Rule("few_words", lambda d: few_words(d.n_words)),
    Rule("repeats", lambda d: repeats(d.n_words, d.n_repeat_words)),
)
MORE = (
    Rule("symbols", lambda d: d.n_symbols * 4 > d.n_words),
    Rule("repeated_lines", lambda d: let(d.line_counts, lambda x: x["dup"] * 10 > x["n"] * 4)),
    Rule("word_length", lambda d: let(d.word_chars, lambda c: (c < d.n_words * 3) | (c > d.n_words * 12))),
    Rule("capitals", lambda d: n_capitals(d.words) * 10 > d.word_chars * 4),
    Rule("letters", lambda d: n_lettered(d.words) * 10 < d.n_words * 7),
)
RULES = (*BASE, *MORE)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def _rejected(rule: Rule, text: Column) -> Column:
    return let(words(text), lambda w: rule.rejects(parts(text, w)))


#: The words alone: what every rule's measurement holds besides the rule.
_NOTHING = Rule("nothing", lambda d: d.n_words < 0)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, runs: int = 3) -> list[Measured]:
    """Each rule's cost and selectivity on about ``rows`` rows, the best rejection per cost first.

    A rule's cost is the least time of ``runs`` runs, less that of a run which
    only takes the texts apart: what a job costs to start is not a rule's.
    """
    texts = sample(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rows)
    n = max(1, texts.count())

    def timed(rule: Rule) -> tuple[float, int]:
        own = texts.agg(F.count_if(_rejected(rule, F.col("text"))).alias("n"))
        rejected = own.first().n  # once before, so that compiling is not counted
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            own.first()
            seconds.append(time.perf_counter() - began)
        return min(seconds), rejected

    start, _ = timed(_NOTHING)
    found = [(rule, *timed(rule)) for rule in rules]
    return sorted((Measured(rule, max(seconds - start, LEAST_SECONDS), rejected / n) for rule, seconds, rejected in found), key=lambda m: -m.worth)


def cascade(d: Parts, ordered: list[Rule]) -> Column:
    """True where no rule rejects; rules after the first that rejects are not worked out."""
    if not ordered:
        return F.lit(True)
    at = F.when(ordered[0].rejects(d), F.lit(False))
    for rule in ordered[1:]:
        at = at.when(rule.rejects(d), F.lit(False))
    return at.otherwise(F.lit(True))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with its own columns, without what the rules reject."""
    ordered = [m.rule for m in measure(docs, rules, rows)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(let(words(text), lambda w: cascade(parts(text, w), ordered)))


def report(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    ordered = [m.rule for m in measure(docs, MORE, rows)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words(text).alias("w"))
    t, w = F.col("text"), F.col("w")
    # The rules read the columns that are returned anyway, and work out only what is not among them.
    found = split.select(
        "doc_id",
        "w",
        F.size(w).cast("long").alias("n_words"),
        word_chars(w).alias("word_chars"),
        n_symbols(t).alias("n_symbols"),
        line_counts(t).alias("lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    )
    d = Parts(w, *[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")])
    judged = found.withColumn("base_failed", few_words(d.n_words) | repeats(d.n_words, d.n_repeat_words))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(d, ordered))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", "base_failed", kept.alias("kept"))
