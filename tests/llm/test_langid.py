import zlib

import numpy as np
import pytest

from ledgerlens.llm import langid

SF = "/root/testdata/sf0.01"
TRAIN = [("the cat and the hat with that", "en"), ("der hund und die katze mit dem", "de"), ("Ünd ßo weiter nach öben", "de"), ("the end of the thing", "en"), (None, "fr"), ("no language", None), ("", "en"), ("123 456", "en")]


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.createDataFrame(TRAIN, "text string, lang string"))


def by_hand(text):
    low = "\n" + text.lower() + "\n"
    return [tuple(c if c.isalpha() else "" for c in low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if low[i].isalpha()]


def test_filter_holds_every_trigram(model):
    assert model.langs == ["de", "en"]
    for text, lang in TRAIN:
        if text and lang and by_hand(text):
            grams, _ = langid.trigrams([text])
            assert len(grams) == len(by_hand(text))
            assert ((model.contained(grams) >> model.langs.index(lang)) & 1).all()


def test_popcounts_are_exact_in_a_large_filter(model):
    texts = ["the hund", "und the", "", "ÜBER", "x"]
    got = model.predict(texts)
    for i, t in enumerate(texts):
        grams = by_hand(t)
        hits = []
        for lang in model.langs:
            own = {g for s, name in TRAIN if s and name == lang for g in by_hand(s)}
            hits.append(sum(g in own for g in grams) / max(1, len(grams)))
        assert got[1][i] == pytest.approx(max(hits), abs=1e-6)
        assert got[0][i] in ([x for x, h in zip(model.langs, hits, strict=True) if h == max(hits)] if grams else ["und"])


def test_false_positives_are_taken_off(spark):
    """A filter far too small still gives nearly the real shares."""
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("abcdefghijklmnop"), 3000)), "x"), ("".join(rng.choice(list("klmnopqrstuvwxyz"), 3000)), "y")]
    small = langid.learn(spark.createDataFrame(rows, "text string, lang string"), slots=1 << 13, floor=0.0)
    assert small.false_rate.max() > 0.05
    langs, score = small.predict(["".join(rng.choice(list("αβγδεζηθικλμ"), 4000))])
    assert score[0] < 0.05
    assert small.predict([r[0] for r in rows])[0] == ["x", "y"]


def test_defined_cases(docs_frame, model):
    docs = docs_frame([(1, None), (2, ""), (3, "12 -"), (4, "the"), (4, "the"), (None, "und"), (6, "the and " * 20000), (7, "漢字")])
    got = langid.identify(docs, model)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert [r[1] for r in rows if r[0] in (1, 2, 3)] == ["und"] * 3 and len(rows) == 8
    assert all(0 <= r[2] <= 1 for r in rows) and dict((r[0], r[1]) for r in rows)[7] == "de"
    kept = langid.keep_known(docs, model, 0.2)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "6", "None"]
    assert langid.identify(docs.limit(0), model).collect() == []


def test_no_training_rows(spark, docs_frame):
    model = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert [tuple(r) for r in langid.identify(docs_frame([(1, "a")]), model).collect()] == [(1, "und", 0.0)]


def test_query_finds_held_out_languages(spark):
    import __spark_entry__ as e

    got = {r.doc_id: r for r in e.queries()["op7_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {d.doc_id for d in held}
    lettered = [d for d in held if d.lang and d.text and any(c.isalpha() for c in d.text)]
    wrong = [d.doc_id for d in lettered if got[d.doc_id].lang_pred != d.lang]
    assert len(wrong) <= 0.02 * len(lettered)


def test_rare_trigrams_are_known_in_a_rich_language(spark, docs_frame):
    """Half a million trigrams, each rarer than any fixed share, beside a poor language: no clean text is lost."""
    rng = np.random.default_rng(6)
    rich = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 10_000))) for _ in range(50)]
    rows = [(t, "zh") for t in rich] + [("the cat and the hat with that " * 40, "en")] * 5
    labelled = spark.createDataFrame(rows, "text string, lang string")
    docs = docs_frame([(i, t) for i, (t, _) in enumerate(rows)] + [(99, "αβγδ εζηθ " * 40)])
    for how in ({}, {"part_slots": 1 << 19}):
        model = langid.learn(labelled, **how)
        assert isinstance(model, langid.SplitFilter) == bool(how) and (not how or model.parts == 4)
        got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
        assert [got[i].lang_pred for i in range(55)] == ["zh"] * 50 + ["en"] * 5
        assert all(got[i].score > 0.95 for i in range(55)) and got[99].score < 0.2
        least = langid.thresholds(labelled, model, 0.2)
        assert set(least) == {"zh", "en"} and all(0.19 < x <= 0.2 for x in least.values())
        kept = langid.keep_known(docs, model, least)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(55))


def test_more_than_64_languages(spark, docs_frame):
    """140 languages of their own letters, whole and split: three words to a slot."""
    rng = np.random.default_rng(7)
    rows = [("".join(map(chr, 0x4E00 + 100 * k + rng.integers(0, 100, 300))), f"l{k:03}") for k in range(140)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    docs = docs_frame([(k, t[:200]) for k, (t, _) in enumerate(rows)] + [(900, ""), (901, "".join(rng.choice(list("αβγδεζηθικλμ"), 1000)))])
    for how in ({}, {"slots": 1 << 12, "part_slots": 1 << 10}):
        model = langid.learn(labelled, **how)
        assert len(model.langs) == 140 and isinstance(model, langid.SplitFilter) == bool(how)
        got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
        assert [got[k].lang_pred for k in range(140)] == [lang for _, lang in rows]
        assert all(got[k].score > 0.95 for k in range(140)) and got[900].lang_pred == "und" and got[901].score < 0.05
