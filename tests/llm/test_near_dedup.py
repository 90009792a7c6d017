import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import near_dedup
from ledgerlens.llm.graph import components


def bag(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return None
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs):
    """class ids by all pairs; and how near the nearest pair is to the bound."""
    n = len(docs)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [None if t is None else bag(t) for _, t in docs]
    for i in range(n):
        for j in range(i):
            a, b = docs[i][1], docs[j][1]
            if a is None or b is None:
                continue
            if a == b or (bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8):
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 10**9), docs[i][0])
    return sorted((docs[i][0], least[find(i)], docs[i][0] == least[find(i)]) for i in range(n))


def some_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    docs, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 60, 300]))]
        for k in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(k % 4 * len(w) // 100):
                w[rng.randrange(len(w))] = word()
            docs.append((n := n + 1, " ".join(w)))
    docs += [(900, None), (901, None), (902, ""), (903, ""), (904, " \n"), (905, "a b"), (906, "A  b\n"), (907, "b a"), (908, "same line here again now\n" * 50), (909, "same line here again now\n" * 47), (910, "same line here again now\n" * 30), (911, "x" * 50000)]
    rng.shuffle(docs)
    return docs


def test_classes_are_brute_force(spark, docs_frame):
    docs = some_docs()
    got = near_dedup.report(docs_frame(docs))
    assert got.columns == ["doc_id", "class_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_dedup_keeps_one_of_each_class(spark, docs_frame):
    docs = some_docs() + [(950, "again and again"), (950, "again and again"), (951, "again and again")]
    frame = docs_frame(docs)
    kept = near_dedup.dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, k in brute(docs) if k})


def test_chain_through_a_bucket_without_its_least_node(spark, docs_frame):
    """a~b~c with a, c too far apart: links between non-pivots are found too."""
    w = [f"w{i}" for i in range(400)]
    docs = []
    for k in range(12):
        v = list(w)
        v[: 8 * k] = [f"x{i}" for i in range(8 * k)]
        docs.append((100 - k, " ".join(v)))
    assert sorted(map(tuple, near_dedup.report(docs_frame(docs)).collect())) == brute(docs)


def test_signature_estimates_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    size = 4000
    for wa, wb in ((1, 1), (3, 5), (2, 9)):
        key = rng.integers(1, 2**52, 60).astype(np.uint64)
        a, b = np.arange(0, 45), np.arange(15, 60)
        w1, w2 = np.full(45, wa), np.full(45, wb)
        w1[:20] += 1
        doc = np.repeat([0, 1], 45)
        sig = near_dedup.bag_min_hash(doc, np.concatenate([key[a], key[b]]), np.concatenate([w1, w2]), 2, size)
        x, y = np.zeros(60), np.zeros(60)
        x[a], y[b] = w1, w2
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / size) ** 0.5 + 1e-9


def test_signature_does_not_depend_on_the_other_documents():
    key = np.arange(1, 40, dtype=np.uint64)
    one = near_dedup.bag_min_hash(np.zeros(39, dtype=int), key, np.ones(39, dtype=int), 1, 120)
    two = near_dedup.bag_min_hash(np.repeat([0, 1], [5, 39]), np.concatenate([key[:5], key]), np.ones(44, dtype=int), 2, 120)
    assert (one[0] == two[1]).all()


def test_empty_table(docs_frame):
    assert near_dedup.report(docs_frame([(1, "a")]).limit(0)).collect() == []
    assert near_dedup.dedup(docs_frame([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        if len(seen) > 1:
            assert got[a] == min(seen)


def test_a_group_around_the_bound(spark, docs_frame):
    """Many texts of one base, some nearer and some farther than the bound: links are found, few pairs are made."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
        docs.append((k + 1, " ".join(w)))
    rng.shuffle(docs)
    assert sorted(map(tuple, near_dedup.report(docs_frame(docs)).collect())) == brute(docs)


def test_near_copies_without_an_own_id(spark, docs_frame):
    """Near copies whose doc_ids are null or repeated: one document of each class stays."""
    base = [[f"{c}{i}" for i in range(100)] for c in "abcd"]
    near = lambda k, n: " ".join([*base[k][:-1], f"end{n}"])
    docs = [(None, near(0, n)) for n in range(4)] + [(None, near(0, 0)), (7, near(0, 9))]
    docs += [(5, near(1, n)) for n in range(4)] + [(6, near(1, 8))]
    docs += [(5, near(2, 0)), (None, near(3, 0)), (None, "alone"), (8, None), (9, None), (5, near(1, 2))]
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    ids = lambda i: -(2**63) if i is None else i
    # brute's class ids over row numbers give the groups.
    group = {i: c for i, c, _ in brute([(n, t) for n, (_, t) in enumerate(docs)])}
    want = []
    for n, (i, t) in enumerate(docs):
        own = [docs[m] for m in group if group[m] == group[n]]
        first = min(own, key=lambda d: (ids(d[0]), md5(d[1]) if d[1] else ""))
        want.append((i, first[0], (i, t) == first))
    frame = docs_frame(docs)
    assert sorted(map(tuple, near_dedup.report(frame).collect()), key=str) == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.dedup(frame).collect()), key=str)
    assert kept == sorted({d for d, w in zip(docs, want, strict=True) if w[2]}, key=str) and len(kept) == 7


def test_a_text_repeated_without_ids_is_compared_once(spark, docs_frame, monkeypatch):
    """Two near texts, 200 rows each: one pair of texts, not 40,000."""
    one = " ".join(f"w{i}" for i in range(100))
    rows = [(None, one)] * 200 + [(None, one.replace("w50", "x"))] * 200
    pairs, real = [], near_dedup._verified

    def verified(found, texts, *how):
        pairs.append((found.count(), texts.count()))
        return real(found, texts, *how)

    monkeypatch.setattr(near_dedup, "_verified", verified)
    got = near_dedup.classes(docs_frame(rows).repartition(4)).collect()
    assert pairs == [(1, 2)] and len(got) == 400 and sum(r.kept for r in got) == 200
