"""The streamed snapshot source against a JSON parser."""

import gzip
import json
import random

import pytest

from ledgerlens.operators import snapshots as S
from ledgerlens.plans.jobs import snapshot_refresh
from ledgerlens.sources import snapshot_files as SF
from ledgerlens.sources import snapshot_stream as ST


def pieces(text, size):
    it = iter([text[i : i + size] for i in range(0, len(text), size)])
    return lambda: next(it, "")


def walked(text, size):
    return list(ST.walk(pieces(text, size)))


def some_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind == 0:
        return rng.choice([0, -1, 12345678901234567890, 1.5e300, -0.25, 1e-7])
    if kind == 1:
        return rng.choice([True, False, None])
    if kind < 6:
        return "".join(rng.choice('ab"\\{}[],: \n\té漢\U0001f600') for _ in range(rng.randrange(12)))
    if kind == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": some_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_walk_equals_a_parser(size):
    rng = random.Random(size)
    for _ in range(150):
        doc = {f"d{i}\n\"": [some_value(rng) for _ in range(rng.randrange(5))] if rng.random() < 0.8 else some_value(rng) for i in range(rng.randrange(5))}
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        want = []
        for n, (k, v) in enumerate(doc.items()):
            want += [(n, k, "item", x) for x in ["", *v]] if isinstance(v, list) else [(n, k, "value", v)]
        got = [(n, k, kind, json.loads(x) if x else "") for n, k, kind, x in walked(text, size)]
        assert got == want


@pytest.mark.parametrize("text", ["", " ", "[]", "1", '"x"', "{", '{"a"', '{"a":', '{"a": [', '{"a": [1', '{"a": [1,', '{"a": [1]', '{"a": [1] "b": 2}', '{"a": [1 2]}', '{"a": tru}', "{1: 2}", "{} x", '{"a": "\n"}', '{"a": [}'])
def test_what_is_no_object_is_broken(text):
    for size in (1, 100):
        with pytest.raises(ST.Broken):
            walked(text, size)


def test_a_long_document_is_held_in_part():
    """Five million characters by pieces of a thousand: never more than a few are held."""
    element, most, total = json.dumps({"tenant": "t" * 50, "total": 1}), 0, 0
    text = ST._Text(pieces('{"2024-01-01": [' + ", ".join([element] * 60_000) + "]}", 1000))
    text.take("{"), text.value(), text.take(":"), text.take("[")
    while True:
        assert text.value()[1] == element
        total += 1
        most = max(most, len(text.held))
        if text.take(",]") == "]":
            break
    assert total == 60_000 and most < 5000


def test_rows_equal_those_of_the_whole_text_reader(spark, scratch):
    doc = '{"2024-01-01": [{"tenant": "a", "total": 5, "onboarded": 1}], "2024-01-02": [], "2024-01-03": 7, "2024-01-01": [{"tenant": "b", "total": 1e3, "total": "7", "onboarded": null}, 3, null, "x"]}'
    with open(f"{scratch}/p.json", "w") as f:
        f.write(doc)
    with gzip.open(f"{scratch}/q.json.gz", "wt") as f:
        f.write(doc)
    with gzip.open(f"{scratch}/hidden", "wt") as f:
        f.write(doc)
    with open(f"{scratch}/bad [1].json", "w") as f:
        f.write('{"2024-01-01": [{"tenant": "a"}], ')
    paths = {"s": [f"{scratch}/p.json", f"{scratch}/q.json.gz"], "t": [f"{scratch}/hidden", f"{scratch}/bad [1].json"]}
    key = lambda r: (r.source_backend, r.path.rsplit("/", 1)[-1].replace("%20", " "), r.top_is_object, r.date_text, r.value_is_list if r.top_is_object else None, r.row_is_object, str(r.row))
    got = sorted(map(key, SF.rows_of_items(ST.read_items(spark, paths)).collect()), key=str)
    want = sorted(map(key, SF.flatten(SF.read_texts(spark, {"s": paths["s"], "t": [paths["t"][0]]})).collect()), key=str)
    assert [g for g in got if g[1] != "bad [1].json"] == want and len(want) == 15
    assert [g[2:4] for g in got if g[1] == "bad [1].json"] == [(False, None)]


def test_batches_are_bounded(scratch):
    with open(f"{scratch}/p.json", "w") as f:
        json.dump({f"2024-01-{d:02d}": [{"tenant": f"t{i}", "total": i} for i in range(3000)] for d in range(1, 11)}, f)
    sizes = [len(b) for b in ST.batches("s", f"{scratch}/p.json")]
    assert sum(sizes) == 30_000 and max(sizes) <= ST.BATCH_ROWS and len(sizes) >= 7


def test_no_files(spark):
    assert ST.read_items(spark, {}).count() == 0 == ST.discover(spark, {}).count()


def _write(scratch, source, year, doc):
    import os

    path = f"{scratch}/{source}/year={year}/snap.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))


ROW = {"tenant": "a", "total": 2, "onboarded": 1}


@pytest.mark.parametrize(
    "one, two, message",
    [
        ({"2024-01-01": [ROW]}, "[1]", "must hold a JSON object"),
        ({"2024-01-01": [ROW, {"tenant": "b", "total": -1, "onboarded": 0}]}, {"x": [ROW]}, "invalid snapshot rows: bad_date=1, total_negative=1"),
        ({"2024-01-01": [ROW]}, {"2024-01-01": [ROW | {"total": 3}]}, "different values for one date/tenant: date=2024-01-01 tenant=a"),
        ({"2024-01-01": [ROW]}, {"2024-01-01": [ROW]}, "several snapshots for one date/tenant: date=2024-01-01 tenant=a"),
        ({"2024-01-01": [ROW]}, {"2025-01-01": [ROW]}, "year_mismatch=1"),
    ],
)
def test_a_load_that_breaks_a_rule_writes_nothing(spark, scratch, one, two, message):
    import os

    _write(scratch, "s", 2024, one)
    _write(scratch, "t", 2024, two)
    templates = {s: f"{scratch}/{s}/year={{year}}/snap.json" for s in "st"}
    with pytest.raises(ValueError, match=message):
        snapshot_refresh(spark, templates, f"{scratch}/out", 2024, 2024)
    assert os.listdir(f"{scratch}/out/_staging") == [] and not os.path.exists(f"{scratch}/out/_versions")


def test_the_checks_and_the_staging_write_are_one_job(spark, scratch):
    """One action on the files: the figures come from the write."""
    for s in "st":
        _write(scratch, s, 2024, {"2024-01-01": [ROW | {"tenant": s}], "2024-02-01": [ROW | {"tenant": s}]})
    items = ST.read_items(spark, {s: [f"{scratch}/{s}/year=2024/snap.json"] for s in "st"})
    gate = S.LoadGate(["s", "t"])
    validated = gate.rows(S.validate_rows(gate.files(SF.rows_of_items(items))))
    unique = gate.keys(S.one_per_key(S.normalize_snapshots(validated.where("reason IS NULL"))))
    spark.sparkContext.setJobGroup("gate", "")
    unique.write.parquet(f"{scratch}/staging")
    load = gate.check()
    spark.sparkContext.setJobGroup("other", "")
    stages = spark.sparkContext.statusTracker().getJobIdsForGroup("gate")
    assert load["rows"] == {"s": 2, "t": 2} and str(load["max_date"]) == "2024-02-01"
    assert 1 <= len(stages) <= 2  # the exchange's stage may be a job of its own
