"""Secret scans, in DataFrame expressions only: fixed patterns, and Markov models of characters.

Fixed patterns (leftmost, non-overlapping per kind): ``assign`` a key word, a
separator and a value of 6 or more characters; ``access`` AKIA and capitals or
digits, 20 or more; ``hex`` 24 or more of 0-9a-f.

The method adds ``random`` spans: runs of 20 or more of [A-Za-z0-9+/_=-] that
overlap no fixed span and are likelier as random strings than as ordinary
identifiers. Both models are first-order Markov chains over these 67 characters
(after a seldom seen character they lean on the plain
frequencies), learned from labelled samples; a run counts where the
log-likelihood ratio over all its steps is at least ``LEAST_RATIO`` nats.

Labelled samples: random strings are SHA-2 digests in base64 and hex (a fixed
number) and the values of fixed spans; identifiers are the other runs of 6 or
more of these characters. The texts for both are a sample of about
``SAMPLE_ROWS`` rows; everything else reads all rows.

Places are code points, ends are exclusive. Defined cases: a null or empty text
has no span. Repeated rows are scanned each for itself. Other columns are not
read by ``report`` and are passed through by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import constant_doubles, let
from .shared import sample, unused

#: About the rows whose texts give labelled samples, and the number of made random strings.
SAMPLE_ROWS = 2000
RANDOM_STRINGS = 2000
LEAST_RATIO = 12.0
LEAST_LENGTH = 20
#: Weight of the plain character frequencies, in steps.
PRIOR = 20.0

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order. A run is only looked for where it begins; shorter ones can't hold a match.
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}",
}
BASE = ("assign", "access", "hex")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARK = "\u0001"
#: Matches summed at once, so that long lists of them take no quadratic time.
_BLOCK = 128


def _found(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of all matches of a kind's pattern."""

    def placed(parts: Column) -> Column:
        # Odd parts are matches. Places are summed in blocks of parts.
        n = F.size(parts)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)))

        def with_starts(bs: Column) -> Column:
            sums = F.transform(bs, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)))
            return let(sums, lambda ss: F.flatten(F.transform(bs, lambda p, b: in_block(p, b, F.aggregate(F.slice(ss, F.lit(1), b), F.lit(0), lambda a, x: a + x)))))

        def in_block(p: Column, b: Column, start: Column) -> Column:
            none = F.struct(start.alias("at"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

            def step(a: Column, x: Column) -> Column:
                end = a["at"] + F.length(x)
                more = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), x.alias("value"))))
                return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.when((a["i"] % 2) == 1, more).otherwise(a["out"]).alias("out"))

            return F.aggregate(p, none, step, lambda a: a["out"])

        nothing = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
        return F.when(n < 2, nothing).otherwise(let(blocks, with_starts))

    marked = F.regexp_replace(text, KINDS[kind], f"{MARK}$0{MARK}")
    return let(F.split(marked, MARK), placed)


def _kind_spans(text: Column, kind: str) -> Column:
    """array<struct<start, k, end, value>> of a kind; k is the kind's number."""
    found = _found(text, kind)
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6)
    k = list(KINDS).index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["value"].alias("value")))


def clean_text(column: str = "text") -> Column:
    """The text with another character in place of the mark; neither can stand in a match, and no place moves."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(MARK), F.lit("\u0002"))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_kind_spans(text, k) for k in BASE]))


def _steps(docs: DataFrame, column: str) -> DataFrame:
    """(pair, n): how often each pair of neighbouring characters stands in the strings of a column."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, F.lit(2)))
    return docs.where(F.length(column) > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def labelled_samples(docs: DataFrame, rows: int = SAMPLE_ROWS, strings: int = RANDOM_STRINGS) -> tuple[DataFrame, DataFrame]:
    """(random strings, ordinary identifiers), each with a column ``sample``."""
    spark = docs.sparkSession
    texts = sample(docs.select("doc_id", clean_text().alias("text")), rows)
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(strings).select(F.when(F.col("id") % 4 == 0, digest).otherwise(F.base64(F.unhex(digest))).alias("sample"))
    spans = texts.select(F.explode(base_spans(F.col("text"))).alias("s"))
    value = F.when(F.col("s.k") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value"))
    found = spans.select(F.regexp_replace(value, r"[^A-Za-z0-9+/_=-]", "").alias("sample"))
    rest = texts.select(F.regexp_replace("text", "|".join(KINDS[k] for k in BASE), " ").alias("text"))
    words = rest.select(F.explode(F.expr(r"regexp_extract_all(text, '[A-Za-z0-9+/_=-]{6,}', 0)")).alias("sample"))
    return made.unionByName(found), words


def learn(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of a step from one character to the next, by (first * 67 + second)."""
    size = len(ALPHABET)

    def chain(samples: DataFrame) -> list[list[float]]:
        seen = {r.pair: r.n for r in _steps(samples, "sample").where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()}  # at most 67 * 67 rows
        after = [sum(seen.get(a + b, 0) for a in ALPHABET) + 0.5 for b in ALPHABET]
        alone = [x / sum(after) for x in after]
        out = []
        for a in ALPHABET:
            row = [seen.get(a + b, 0) + PRIOR * alone[j] for j, b in enumerate(ALPHABET)]
            out.append([x / sum(row) for x in row])
        return out

    p, q = chain(random), chain(ordinary)
    return [round(math.log(p[i][j] / q[i][j]), 6) for i in range(size) for j in range(size)]


def ratio(value: Column, table: list[float]) -> Column:
    """The summed log-likelihood ratio of a string over ALPHABET."""
    size = len(ALPHABET)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    weights = constant_doubles(table)
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda a, c: F.struct((a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(weights, a["last"] * size + c))).alias("sum"), c.alias("last"))
    return F.aggregate(codes, none, step, lambda a: a["sum"])


def with_spans(docs: DataFrame, text: Column, table: list[float], least: float = LEAST_RATIO, base: str = "_base", spans: str = "_spans") -> DataFrame:
    """``docs`` with two new columns, ``base`` and ``spans`` (both sorted by start, then kind)."""
    (clean, runs) = unused(docs, "clean_text", "runs_found")
    scanned = docs.withColumn(clean, text).withColumn(base, base_spans(F.col(clean))).withColumn(runs, _kind_spans(F.col(clean), "random"))
    added = F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])) & (ratio(r["value"], table) >= least))
    return scanned.withColumn(spans, F.when(F.size(runs) == 0, F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), added)))).drop(runs, clean)


def _named(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, table: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), clean_text(), table, least)
    count = lambda k: F.size(F.filter("_base", lambda s: s["k"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return found.select("doc_id", *[count(k) for k in range(3)], F.sha2(_named("_base"), 256).alias("base_sha256"), _named("_spans").alias("spans"))


def redact(docs: DataFrame, table: list[float], least: float = LEAST_RATIO, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with its own columns, every span of the text replaced (overlapping ones together)."""
    base, spans = unused(docs, "base", "spans")
    found = with_spans(docs, clean_text(), table, least, base, spans)

    def cut(chars: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gap = F.array_join(F.slice(chars, a["at"] + 1, s["start"] - a["at"]), "")
            return F.when(s["end"] <= a["at"], a).when(s["start"] < a["at"], F.struct(s["end"].alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.lit(by))).alias("out")))

        end = lambda a: F.concat(F.array_join(a["out"], ""), F.array_join(F.slice(chars, a["at"] + 1, F.size(chars)), ""))
        return F.aggregate(spans, none, step, end)

    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(let(F.filter(F.split(F.col("text"), ""), lambda c: c != ""), cut))
    return found.withColumn("text", text.cast(docs.schema["text"].dataType)).select(*docs.columns)
