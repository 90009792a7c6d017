import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import packing, token_planes, tokens

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"


def plain(text, end):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


DOCS = [(5, None), (4, ""), (3, " \n "), (2, "<|endoftext|> It's"), (1, "It's a  test.\nDon't É é ﬁ Σ" * 3), (9, "word " * 5000), (9, "z"), (9, "z"), (7, "x" * 3000), (8, "\t\r a b\x1cc")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sSté́̈|<>1a  \x85Σ"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_ids_are_those_of_the_library(texts):
    ids, own = tokens.encoder(tokens.vocabulary_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(own, own[1:], strict=False)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_words_together_and_alone():
    texts = ["The quick, Élan! naïve... x'y don't stop-it (a) İs ǅ ﬁn ſo ŉo IŒ ẞ e\u0301t, 'so 'tom dog's, don''t <b>"] + [" ".join(f"{a}{b}{c}" for b in ("o", "Ué", "zß")) for a in "abcÉž" for c in ("", ".", "'s", "9", "?!", "\u0301")] * 3
    e = tokens.WordEncoder(tokens.vocabulary_path())
    for t in texts:
        assert e.encode([t])[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 2)
    e = tokens.WordEncoder(tokens.vocabulary_path())
    for t in ("a b c d", "e f a", "a a"):
        assert e.encode([t])[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def check_packed(docs, rows, size=2048, end=0):
    want = []
    for i, t in docs:
        ids = plain(t, end)
        want += [(i, n, s, len(ids[s : s + size]), crc(ids[s : s + size])) for n, s in enumerate(range(0, len(ids), size))]
    got = [tuple(r) for r in rows]
    assert sorted((x[:5] for x in got), key=str) == sorted(want, key=str)
    by = {}
    for x in got:
        by.setdefault(x[5], []).append((x[6], x[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(w[3] for w in want) // size)


@pytest.mark.parametrize("how", [{}, {"open_bins": 2}, {"size": 16}])
def test_packing(docs_frame, how):
    docs = DOCS + [(100 + i, "some words " * random.Random(i).randint(1, 900)) for i in range(60)] + [(None, "no name")]
    check_packed(docs, packing.pack(docs_frame(docs).repartition(5), **how).collect(), how.get("size", 2048))


def test_packing_keeps_ids(docs_frame):
    for r in packing.pack(docs_frame(DOCS), with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_best_fit_is_the_definition():
    """Against a plain list of open bins."""
    rng = random.Random(5)
    fit, open_bins, closed, want = packing.BestFit(50, 6), [], [], []
    for n in range(3000):
        length = rng.randint(1, 50)
        closed += fit.put((n,), length)
        fits = [b for b in open_bins if b[0] >= length]
        if fits:
            b = min(fits, key=lambda b: b[0])
            best = b[0]
            b = [x for x in open_bins if x[0] == best][-1]
            open_bins.remove(b)
        else:
            if length < 50 and len(open_bins) >= 6:
                least = min(b[0] for b in open_bins)
                b = [x for x in open_bins if x[0] == least][-1]
                open_bins.remove(b)
                want.append(b[1])
            b = [50, []]
        b = [b[0] - length, b[1] + [(n,)]]
        if b[0]:
            open_bins.append(b)
        else:
            want.append(b[1])
        assert fit.open == len(open_bins) <= 6
    assert closed == want


def test_packing_query(spark):
    import __spark_entry__ as e

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    made, least = check_packed(docs, e.queries()["op6_best_fit_packing"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect())
    assert made <= 1.02 * least + 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32 if n == 7 else 50000, n, dtype=np.uint32)
        planes = [p if p.strip(b"\0") else None for p in token_planes.to_planes(ids, kind)]
        assert (token_planes.from_planes(planes, n, kind) == ids).all()


def planes_want(docs):
    out, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] is not None, d[1])):
        ids = plain(t, 2)
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, docs_frame, tmp_path, kind):
    docs = [*DOCS, (None, "no name")]
    folder = f"file://{tmp_path}/planes"
    manifest = token_planes.write(docs_frame(docs).repartition(4), folder, block_ids=100, kind=kind)
    got = sorted((tuple(r) for r in token_planes.read_back(spark, folder).collect()), key=lambda r: r[1])
    assert got == planes_want(docs)
    assert not [f for f in (tmp_path / "planes").iterdir() if f.name.startswith("_")]
    whole = np.concatenate([plain(t, 2) for _, t in sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] is not None, d[1]))])
    for m in manifest:
        with pafs.LocalFileSystem().open_input_file(f"{tmp_path}/planes/{m['file']}") as src:
            reader = token_planes.PlaneReader(src)
            for a, n in ((0, 1), (m["ids"] // 2, m["ids"] - m["ids"] // 2), (m["ids"] - 1, 1)):
                assert (reader.read(a, n) == whole[m["start"] + a : m["start"] + a + n]).all()


def test_no_documents(spark, docs_frame, tmp_path):
    assert packing.pack(docs_frame([(1, "a")]).limit(0)).collect() == []
    assert token_planes.write(docs_frame([(1, "a")]).limit(0), f"file://{tmp_path}/none") == []
    assert token_planes.read_back(spark, f"file://{tmp_path}/none").collect() == []


def test_planes_query(spark):
    import __spark_entry__ as e

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in e.queries()["op8_token_planes"](spark, SF).collect()), key=lambda r: r[1])
    assert got == planes_want(docs)


def test_short_documents_take_few_levels(docs_frame, monkeypatch):
    """What a level hands on shrinks with the ids, however many pieces they are."""
    levels, real = [], packing.checkpoint
    monkeypatch.setattr(packing, "checkpoint", lambda df: levels.append(1) or real(df))
    docs = [(i, f"a few words {i}") for i in range(4000)]
    rows = packing.pack(docs_frame(docs).repartition(8), size=128, open_bins=8).collect()
    check_packed(docs, rows, 128)
    assert len(levels) <= 5
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(r.length for r in rows) / 128 + 1


_PARTS = [*"aZéÉß×÷İıŉȿɀ̸́Σ1'|<>!.,_~ \n\t", "'s", "<|endoftext|>", "<|startoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=30).map("".join), max_size=4))
def test_cuts_at_punctuation_change_no_id(texts):
    ids, own = tokens.encoder(tokens.vocabulary_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(own, own[1:], strict=False)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_kept_once_whatever_punctuation_follows():
    e, words, marks = tokens.WordEncoder(tokens.vocabulary_path()), ["word", "mot", "élan"], ["", ",", ".", ";", "!?"]
    t = "\n".join(w + m for w in words for m in marks)
    assert e.encode([t] * 2)[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids * 2
    assert len(e._place) == len(words) + len(marks) - 1


def test_packing_hands_texts_on_as_bytes(docs_frame, monkeypatch):
    """No string is made for each text before the encoder cuts it."""

    class Bytes:
        def encode_utf8(self, data, offsets):
            return tokens.encoder(tokens.vocabulary_path()).encode_utf8(data, offsets)

    monkeypatch.setattr(packing, "encoder", lambda path: Bytes())
    check_packed(DOCS, packing.pack(docs_frame(DOCS).repartition(2)).collect())
