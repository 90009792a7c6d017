"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hard_negatives, langid, lm, near_dedup, order_minhash, packing, periodic, quality, secret_scan, sharding, token_planes, warc
from .native import let
from .shared import prepare, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    warc.write(pages, folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(langid.fold(3) != 1))
    return langid.identify(docs, model).select("doc_id", (langid.fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-planes")
    token_planes.write(docs, folder)
    return token_planes.read_back(spark, folder)


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.report(docs, secret_scan.learn(*secret_scan.labelled_samples(docs)))


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with all after word a repeating the first p of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    return F.when(h % 10 == 0, let(quality.words(text), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("best")
    return (
        periodic.runs(docs)
        .withColumn("best", periodic.greatest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            best["start"].alias("start"),
            best["length"].alias("length"),
            best["period"].alias("period"),
            F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
            F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = (F.col("label").cast("long") + 1) % 10
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, shifted).otherwise(F.col("label").cast("long")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_token_planes": op8_token_planes,
    "op9_minimax_sharding": op9_minimax_sharding,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_order_minhash": op12_order_minhash,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
          FROM pages
        ), m AS (
          SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top
          FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM m
    """,
    "op3_quality_cascade": r"""
        WITH t AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
        ), s AS (
          SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
          FROM t
        ), windows AS (
          SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS n
          FROM (SELECT r, unnest(gs) AS g, generate_subscripts(gs, 1) AS i
                FROM (SELECT r, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS gs FROM s))
        ), repeated AS (
          SELECT r, COUNT(DISTINCT i + k) AS n FROM windows, range(0, 3) g(k) WHERE n > 1 GROUP BY r
        ), m AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
                 length(regexp_replace(array_to_string(w, ''), '[^A-Z]+', '', 'g')) AS capitals,
                 len(list_filter(w, lambda v: regexp_matches(v, '\p{L}'))) AS lettered
          FROM s LEFT JOIN repeated USING (r)
        ), b AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols * 4 > n_words OR n_dup_lines * 10 > n_lines * 4
                    OR word_chars < n_words * 3 OR word_chars > n_words * 12
                    OR capitals * 10 > word_chars * 4 OR lettered * 10 < n_words * 7) AS kept
        FROM b
    """,
    "op5_benchmark_decontamination": rf"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents
        ), b AS (
          SELECT CAST(item_id AS VARCHAR) AS item,
                 regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ), bw AS (
          SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g
          FROM (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0)
        ), ks AS (
          SELECT DISTINCT k FROM bw
        ), dw AS (
          SELECT r, k, unnest(gs) AS g, generate_subscripts(gs, 1) AS i
          FROM (SELECT r, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')) AS gs
                FROM d, ks WHERE len(w) >= k)
        ), hits AS (
          SELECT r, dw.k AS k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
        ), words AS (
          SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
        ), items AS (
          SELECT r, COUNT(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.l, '')) AS items_sha256,
               coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
    """,
    "op13_hard_negatives": """
        WITH e AS (
          SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
          FROM e a, e b WHERE a.vec_id % 100 = 0
        ), p AS (
          SELECT ar, br, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND ar <> br
          QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5
        )
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.ar = s.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, vec_id) <= 10
    """,
}
