import hashlib
import re

from ledgerlens.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, own = set(), set()
        for item, text in items:
            b = words(text)
            if not b:
                continue
            k = min(13, len(b))
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit.update(range(j, j + k))
                    own.add(str(item))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEMS = [(1, LONG), (2, "Short, item!"), (10, "éa été"), (3, ""), (4, None), (5, "..."), (6, "x " + LONG.upper()), (2, "Short, item!")]
DOCS = [
    (1, "pre " + LONG.replace(" ", ", ") + " post"),
    (2, None),
    (3, ""),
    (4, "a short-item here " + "w " * 500),
    (5, "été ÉA éa   été éa été"),
    (6, LONG[:40]),
    (7, ". , ;"),
    (8, (LONG + "\n") * 300),
    (1, "pre " + LONG),
    (9, "x\x00short item\x00"),
    (11, "two three four five six seven eight nine ten eleven twelve thirteen " * 2),
]


def frames(spark, docs_frame):
    return docs_frame(DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report_is_brute_force(spark, docs_frame):
    docs, bench = frames(spark, docs_frame)
    assert sorted(map(tuple, decontam.report(docs, bench).collect()), key=str) == brute(DOCS, ITEMS)


def test_blocks_give_the_same(spark, docs_frame):
    docs, bench = frames(spark, docs_frame)
    assert sorted(map(tuple, decontam.report(docs, bench, max_windows=3).collect()), key=str) == brute(DOCS, ITEMS)


def test_clean_drops_and_cuts(spark, docs_frame):
    docs, bench = frames(spark, docs_frame)
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[-1]}
    for most in (decontam.MAX_WINDOWS, 3):
        kept = decontam.clean(docs, bench, max_windows=most)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in DOCS} - bad
    cut = {r.doc_id: r.text for r in decontam.clean(docs, bench, "cut").collect()}
    assert cut[4] == "a  here " + "w " * 500 and cut[6] == LONG[:40] and cut[2] is None
    assert not any(LONG in (t or "") for t in cut.values())


def test_empty_tables(spark, docs_frame):
    docs, bench = frames(spark, docs_frame)
    assert decontam.report(docs.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in decontam.report(docs, bench.limit(0)).collect())


def test_query_is_brute_force(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = e.queries()["op5_benchmark_decontamination"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_drop_and_cut_row_by_row(spark, docs_frame):
    """Clean and contaminated rows under one id or none, items overlapping in different blocks: as with one block."""
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:14])), (2, " ".join(w[8:24])), (3, " ".join(w[24:37])), (4, "lone item")]
    whole = " ".join(w)
    docs = [(1, "a " + whole + " z"), (1, "clean"), (None, whole), (None, "also clean"), (None, None), (2, "lone-item " + "x " * 90), (2, whole), (1, "clean")]
    frame, bench = docs_frame(docs), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept, cut = ([rows(decontam.clean(frame, bench, action, max_windows=most)) for most in (decontam.MAX_WINDOWS, 3)] for action in ("drop", "cut"))
    assert kept[0] == kept[1] == sorted([d for d in docs if d[1] is None or whole not in d[1]], key=str)
    assert cut[0] == cut[1] and (1, "a  w37 w38 w39 z") in cut[0] and (2, " " + "x " * 90) in cut[0]
    assert decontam.clean(frame, bench, max_windows=3).columns == frame.columns
    assert sorted(map(tuple, decontam.report(frame, bench, max_windows=3).collect()), key=str) == brute(docs, items)


def test_one_block_is_held_at_a_time(spark, docs_frame, monkeypatch):
    """A block's windows are released before the next block's are made."""
    docs, bench = frames(spark, docs_frame)
    seen, make, destroy = [], decontam.WindowSet.__init__, decontam.Broadcast.destroy
    monkeypatch.setattr(decontam.WindowSet, "__init__", lambda self, *a: seen.append("made") or make(self, *a))
    monkeypatch.setattr(decontam.Broadcast, "destroy", lambda self, *a: seen.append("gone") or destroy(self, *a))
    assert sorted(map(tuple, decontam.report(docs, bench, max_windows=3).collect()), key=str) == brute(DOCS, ITEMS)
    assert len(seen) > 4 and seen == ["made", "gone"] * (len(seen) // 2)
