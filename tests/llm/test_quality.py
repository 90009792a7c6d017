import random
import re
from collections import Counter

from ledgerlens.llm import quality

SF = "/root/testdata/sf0.001"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    chars = sum(map(len, w))
    sym = len(re.findall(r"[#*$%&|<>]", t))
    ln = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(ln) - len(set(ln))
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {j for i in range(n - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = n < 50 or 100 * len(rep) > 50 * n
    caps = sum("A" <= c <= "Z" for x in w for c in x)
    lettered = sum(any(c.isalpha() for c in x) for x in w)
    rejected = failed or 4 * sym > n or 10 * dup > 4 * len(ln) or chars < 3 * n or chars > 12 * n or 10 * caps > 4 * chars or 10 * lettered < 7 * n
    return n, chars, sym, dup, len(rep), failed, not rejected


def some_docs():
    rng = random.Random(9)
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "a a a a"), (6, "a b c a b c"), (7, "é ü\x0bß\x0c漢 " * 40), (8, "# * $ words " * 30), (9, "A line\n" * 30), (10, "x" * 60000), (11, "a b " * 30000), (1, "twice"), (None, "no id " * 60), (12, "\n\n \nq\n q\nq\n"), (13, " nb sp x " * 20)]
    for i in range(40):
        v = [("".join(rng.choice("abcdEFG1") for _ in range(rng.randint(1, 9)))) for _ in range(rng.choice([3, 12, 400]))]
        docs.append((100 + i, "".join(rng.choice(v) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(1, 400)))))
    return docs


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_report_is_brute_force(docs_frame):
    docs = some_docs()
    assert rows(quality.report(docs_frame(docs))) == sorted([(i, *brute(t)) for i, t in docs], key=str)


def test_keep_and_any_order_give_the_same(docs_frame):
    docs = some_docs() + [(500 + i, f"some clean words number {i} that nobody would want to reject at all. " * 1 + " ".join(f"word{j}x{i}" for j in range(60))) for i in range(5)]
    frame = docs_frame(docs)
    kept = quality.keep(frame)
    assert kept.columns == frame.columns
    want = sorted((i, t) for i, t in docs if brute(t)[-1])
    assert len(want) >= 5 and sorted((r.doc_id, r.text) for r in kept.collect()) == want
    back = quality.keep(frame, quality.RULES[::-1], rows=1)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == want


def test_rules_are_ordered_by_rejection_per_cost(docs_frame):
    got = quality.measure(docs_frame(some_docs()))
    assert {m.rule.name for m in got} == {r.name for r in quality.RULES}
    assert [m.worth for m in got] == sorted((m.worth for m in got), reverse=True)
    assert quality.report(docs_frame([(1, "a")]).limit(0)).collect() == []


def test_no_python_in_the_plan(docs_frame):
    plan = quality.report(docs_frame(some_docs()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Physical Plan")[1])


def test_query(spark):
    import __spark_entry__ as e

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(e.queries()["op3_quality_cascade"](spark, SF)) == sorted([(i, *brute(t)) for i, t in docs], key=str)
