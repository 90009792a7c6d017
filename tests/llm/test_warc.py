import gzip
import hashlib

import duckdb
import pytest

from ledgerlens.llm import warc
from ledgerlens.llm.queries import ORACLES

BIG = "<p>é</p>" * 200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, "small"), (4, "u\r\nEvil: 1 é", "small"), (5, "http://a/5", None), (6, "x", ""), (9, "b", BIG), (9, "b", BIG), (2, "other", BIG), (2, "other", "WARC/1.1\r\n\r\n" * 90), (None, "n", BIG), (None, "n", "z" * 999), (12, "l", "y" * 300_000), (13, "é", "é" * 500), (14, "é", "é" * 500)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, kind int, digest string")


def want(rows):
    last = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        top = last.get(h, i) if h and len(h.encode()) >= 1000 else i
        raw = (h or "").encode()
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("roll", [warc.ROLL_BYTES, 300])
def test_round_trip(spark, tmp_path, roll):
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(frame(spark, PAGES).repartition(3), folder, roll_bytes=roll)
    assert got(warc.read(spark, folder)) == want(PAGES)
    html = {(r.page_id, r.payload_digest): r.html for r in warc.read(spark, folder).where("record_type = 'response'").collect()}
    assert html[(12, hashlib.sha1(b"y" * 300_000).hexdigest())] == "y" * 300_000
    names = sorted(f.name for f in (tmp_path / "warc").iterdir())
    assert names == sorted([m["file"] for m in manifest] + ["manifest.json"])
    assert sum(m["records"] for m in manifest) == len(PAGES)
    if roll == 300:
        assert len(manifest) > 4 and all(m["records"] == 1 or m["bytes"] < 3000 for m in manifest)
    for m in manifest:
        raw = (tmp_path / "warc" / m["file"]).read_bytes()
        assert hashlib.sha1(raw).hexdigest() == m["sha1"] and len(raw) == m["bytes"]


def test_the_same_rows_give_the_same_bytes(spark, tmp_path):
    """However the rows are partitioned, with many shards and with adaptive plans or without."""
    rows = PAGES + [(i, f"p{i}", f"page {i} " * (i % 90)) for i in range(100, 900)]
    manifests = []
    for k, (parts, adaptive) in enumerate(((1, "true"), (3, "true"), (7, "false"))):
        old = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            manifests.append(warc.write(frame(spark, rows).repartition(parts), f"file://{tmp_path}/{k}", shard_bytes=20_000))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", old)
        assert got(warc.read(spark, f"file://{tmp_path}/{k}")) == want(rows)
    assert manifests[0] == manifests[1] == manifests[2] and len({m["part"] for m in manifests[0]}) > 8


def test_records_are_members_and_headers_are_safe(spark, tmp_path):
    manifest = warc.write(frame(spark, PAGES), f"file://{tmp_path}/w")
    ids, evil = set(), []
    for m in manifest:
        with open(tmp_path / "w" / m["file"], "rb") as f:
            for head, _ in warc.records(f):
                ids.add(head["warc-record-id"])
                evil.append("evil" in head)
        raw = (tmp_path / "w" / m["file"]).read_bytes()
        assert raw.count(b"\x1f\x8b\x08") >= m["records"] + 1 and gzip.decompress(raw)
    assert len(ids) == len(PAGES) + len(manifest) and not any(evil)


def test_a_damaged_file_is_refused(spark, tmp_path):
    manifest = warc.write(frame(spark, PAGES).coalesce(1), f"file://{tmp_path}/w")
    f = tmp_path / "w" / manifest[0]["file"]
    f.write_bytes(f.read_bytes()[:-40])
    with pytest.raises(Exception):  # noqa: B017
        warc.read(spark, f"file://{tmp_path}/w").collect()


def test_empty_table(spark, tmp_path):
    assert warc.write(frame(spark, PAGES).limit(0), f"file://{tmp_path}/w") == []
    assert warc.read(spark, f"file://{tmp_path}/w").collect() == []


def test_query(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    rows = got(e.queries()["op2_warc"](spark, sf))
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows == want(pages)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    c.execute(f"CREATE VIEW v AS {ORACLES['op2_warc']}")
    assert sorted(c.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM v").fetchall(), key=str) == rows
