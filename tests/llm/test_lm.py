import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import lm

SF = "/root/testdata/sf0.01"


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def brute_base(docs):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(x for i, t in docs if not held[i] for x in toks(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[i], len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks(t))) for i, t in docs), key=str)


def check(docs, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    want = brute_base(docs)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in rows)


DOCS = [(i, "The cat sat on the mat. " * (i % 4) + f"word{i % 7} ünd x\n") for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "y" * 30000), (104, "rare " * 20000), (5, "again"), (None, "no id here"), (105, "AÉ\x0baé")]


def test_base_is_brute_force(docs_frame):
    check(DOCS, lm.report(docs_frame(DOCS)).collect())


def test_rare_words_meet_their_counts_in_the_join(docs_frame, monkeypatch):
    """With hardly any word known to the tasks the base scores are the same."""
    frame = docs_frame(DOCS)
    training = frame.where(~lm.held_out())
    counts = lm.word_counts(training)
    v = lm.vocabulary(counts, listed=2, classes=3, known=2)
    check(DOCS, lm.score(frame, counts, v, lm.Model.new(v)).collect())


def test_no_more_words_are_known_than_allowed(spark):
    counts = spark.createDataFrame([(i, 7, n) for i, n in enumerate([100, 90, 50, 50, 50, 3, 2, 1, 1, 1, 1])] + [(-1, -1, 9)], "word long, ending int, n long")
    for known in (1, 2, 4, 5, 7, 20):
        v = lm.vocabulary(counts, listed=3, classes=3, known=known)
        assert len(v.keys) <= known and set(v.counts) == {n for n in (100, 90, 50, 3, 2, 1) if sum(x >= n for x in [100, 90, 50, 50, 50, 3, 2, 1, 1, 1, 1]) <= known}
        assert v.tokens == 358 and v.types == 12


def learned(docs_frame, **how):
    training = docs_frame(DOCS)
    counts = lm.word_counts(training)
    v = lm.vocabulary(counts, **how)
    return counts, v, lm.train(training, v)


def test_probabilities_sum_to_one(docs_frame):
    """Over all symbols after any context, and over all other words of a class (one unseen word among them)."""
    counts, v, m = learned(docs_frame, listed=6, classes=5, least=1)
    n = len(v.bias)
    for context in ([0, 1], [n, n], [n - 1, 2]):
        p = np.exp(m.log_probabilities(np.arange(n), [np.full(n, c) for c in context]))
        assert p.sum() == pytest.approx(1, abs=1e-5)
    inside = np.zeros(n)
    listed = {int(k) for k, s in zip(v.keys, v.listed, strict=True) if s >= 0}
    assert len(listed) == 6
    rest = v.first[1:-1] - 1
    for r in counts.where("ending >= 0").collect():
        if r.word % 2**64 not in listed:
            s = rest[v.class_of[r.ending]]
            inside[s] += (r.n + lm.SMOOTH) / 10 ** v.log_rest[s]
    for s in rest:
        assert inside[s] + lm.SMOOTH / 10 ** v.log_rest[s] == pytest.approx(1)


def brute_score(text, counts, v, m):
    """A word at a time, in plain numbers: log10 of P(class) P(symbol | class) and the share of other words."""
    known = {int(k) % 2**64: int(s) for k, s in zip(v.keys, v.listed, strict=True)}
    n, total, before = len(v.bias), 0.0, [len(v.bias)] * 2
    raw = (text or "").encode()
    for word in [*raw.split(), None]:
        if word is None:
            symbol, extra = n - 1, 0.0
        else:
            w = lm.words_of(np.frombuffer(word, np.uint8), np.array([0, len(word)]), lm.SPACED)
            h = int(w.hash[0])
            c = int(v.class_of[lm._endings(np.frombuffer(word, np.uint8), w.start, w.end)[0]])
            symbol, extra = known.get(h, -1), 0.0
            if symbol < 0:
                symbol = int(v.first[c + 1]) - 1
                extra = math.log10(counts.get(h, 0) + 0.1) - v.log_rest[symbol]
        c = next(k for k in range(len(v.class_bias)) if v.first[k] <= symbol < v.first[k + 1])
        q = [float(sum(m.context[i][before[i]][j] for i in range(2))) for j in range(m.target.shape[1])]
        dot = lambda x, q=q: sum(a * float(b) for a, b in zip(q, x, strict=True))
        by_class = [math.exp(dot(t) + float(b)) for t, b in zip(m.of_class, m.class_bias, strict=True)]
        inside = {s: math.exp(dot(m.target[s]) + float(m.bias[s])) for s in range(v.first[c], v.first[c + 1])}
        total += math.log10(by_class[c] / sum(by_class)) + math.log10(inside[symbol] / sum(inside.values())) + extra
        before = [symbol, before[0]]
    return total


def test_scores_are_those_of_a_plain_scorer(docs_frame):
    counts, v, m = learned(docs_frame, listed=8, classes=4, known=9)
    table = {r.word % 2**64: r.n for r in counts.collect()}
    for r in lm.score(docs_frame(DOCS), counts, v, m).collect():
        text = dict(DOCS[:60] + DOCS[60:]).get(r.doc_id) if r.doc_id != 5 else None
        if r.doc_id not in (5, 104):
            assert r.score == pytest.approx(brute_score(text, table, v, m), rel=1e-4, abs=1e-4)


def test_scores_do_not_depend_on_the_layout(docs_frame, monkeypatch):
    """Other partitions and batches, several shards: the same model."""
    rows = DOCS + [(i, f"more {i % 13} and {i % 5} of it\n" * 9) for i in range(200, 400)]
    found = []
    for parts in (1, 3, 7):
        scored = lm.report(docs_frame(rows).repartition(parts), shard_bytes=4000).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in scored))
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)


def test_words_with_one_ending_are_told_apart(docs_frame):
    """Two common words of one class in exchanged places give another score."""
    rows = [(i, "the boating man saw the coating dry and went boating home") for i in range(300)]
    docs = docs_frame(rows + [(1001, "the boating man saw the coating dry"), (1002, "the coating man saw the boating dry")])
    got = {r.doc_id: r.score for r in lm.report(docs).collect()}
    assert got[1001] > got[1002] + 1


def test_the_vocabulary_grows_with_the_counts(spark):
    """Every word of enough counts has a symbol, up to the bound; classes hold like shares of the tokens."""
    rows = [(i, i % 500, 2 + i % 7) for i in range(5000)] + [(-1, -1, 9)]
    counts = spark.createDataFrame(rows, "word long, ending int, n long")
    v = lm.vocabulary(counts, classes=16)
    assert (v.listed >= 0).sum() == sum(n >= lm.LEAST_COUNT for _, e, n in rows if e >= 0) and len(set(v.listed.tolist())) == (v.listed >= 0).sum() + 1
    share = np.exp(v.class_bias[:-1])
    assert share.max() < 1.3 * share.min()
    assert (lm.vocabulary(counts, classes=16, listed=100).listed >= 0).sum() == 100


def test_contexts_stay_inside_a_text():
    first = np.array([0, 1, 2])
    v = lm.Vocabulary(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(1 << 16, np.int32), first, np.zeros(2), np.zeros(2), np.log(np.array([0.5, 0.5])), 0, 0, 0)
    raw = b"a b cd e"
    t = lm.tokens_of(np.frombuffer(raw, np.uint8), np.array([0, 3, 3, 8]), v, 2)
    assert t.symbol.tolist() == [0, 0, 1, 1, 0, 0, 1] and t.first.tolist() == [0, 3, 4, 7]
    assert t.contexts[0].tolist() == [2, 0, 0, 2, 2, 0, 0] and t.contexts[1].tolist() == [2, 2, 0, 2, 2, 2, 0]


def test_empty_table(docs_frame):
    assert lm.report(docs_frame(DOCS).limit(0)).collect() == []
    only = lm.report(docs_frame([(100, "a b")])).collect()
    check([(100, "a b")], only)


def test_query_beats_the_base_on_held_out_texts(spark):
    import __spark_entry__ as e

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = e.queries()["op4_log_bilinear"](spark, SF).collect()
    check(docs, rows)
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1


def _vocabulary(keys, first=(0, 1, 2)):
    n = first[-1]
    zero = np.zeros(len(keys), dtype=np.int64)
    return lm.Vocabulary(np.sort(keys), zero, zero, np.zeros(1 << 16, dtype=np.int32), np.array(first), np.zeros(n), np.zeros(n), np.zeros(len(first) - 1), 1, 1, 1)


@pytest.mark.parametrize("keys", [np.random.default_rng(1).integers(0, 1 << 64, 50_000, dtype=np.uint64), np.arange(100, dtype=np.uint64), np.array([7, 1 << 63, (1 << 64) - 1], dtype=np.uint64)])
def test_slots_are_those_of_a_binary_search(keys):
    v = _vocabulary(keys)
    asked = np.concatenate([keys, keys + np.uint64(1), np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
    assert (v.slots(asked) == np.searchsorted(v.keys, asked)).all()


@pytest.mark.parametrize("scale", [0.1, 1.0, 12.0])
def test_both_softmaxes_of_one_product(scale):
    """Against each softmax alone in double precision; with large products too."""
    v, rng = _vocabulary(np.empty(0, dtype=np.uint64), (0, 5, 6, 300, 301)), np.random.default_rng(4)
    m = lm.Model.new(v)
    for x in m.arrays():
        x += rng.normal(0, scale, x.shape).astype(x.dtype)
    symbol = rng.integers(0, 301, 3000)
    contexts = [rng.integers(0, 302, 3000) for _ in range(lm.ORDER)]
    got = m.log_probabilities(symbol, contexts)
    h = m.predicted(contexts).astype(np.float64)
    for i, s in enumerate(symbol.tolist()):
        c = int(np.searchsorted(m.first, s, side="right")) - 1
        lo, hi = int(m.first[c]), int(m.first[c + 1])
        parts = [(m.of_class @ h[i] + m.class_bias, c), (m.target[lo:hi] @ h[i] + m.bias[lo:hi], s - lo)]
        want = sum(x[k] - x.max() - math.log(np.exp(x - x.max()).sum()) for x, k in parts)
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4 * (1 + scale * scale))


def test_rows_are_summed_alike_with_short_and_long_indices():
    rng = np.random.default_rng(6)
    at, rows = rng.integers(0, 1 << 16, 4000), rng.normal(0, 1, (4000, 3)).astype(np.float32)
    short, long = lm._by_row(at, rows), lm._by_row(at + (1 << 16), rows)
    assert (short[0] + (1 << 16) == long[0]).all() and (short[1] == long[1]).all()
