import gzip
import hashlib
import random

import duckdb
import pytest

from kinsift.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, path int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


def test_names():
    for value in (0, 1, -5, 2**63 - 1, -(2**63), 123456789012345, None):
        assert W.page_id(W.record_id(value)) == value
    assert W.page_id("<urn:uuid:6c3b1a1e-0000-4000-8000-000000000000>") is None


def test_long_headers_and_large_members_are_read_back(monkeypatch):
    monkeypatch.setattr(W, "MOST", 50_000)
    rng = random.Random(7)
    payload = bytes(rng.randrange(256) for _ in range(200_000))
    records = [W.build(1, "é" * 30_000, b"x", None, "d"), W.build(2, "u", payload, None, "d"), W.build(3, "u", b"y", None, "d")]
    found = list(W.salvage(b"".join(map(W.member, records))))
    assert [(x.kind, x.page, x.payload) for x in found] == [("record", 1, b"x"), ("record", 2, payload), ("record", 3, b"y")]
    # What expands beyond what it declares is still refused.
    assert [x.reason for x in W.salvage(W.member(records[2] + bytes(200_000)))] == ["gzip member too large"]


def test_query_matches_sql(spark, medium):
    got = sorted(map(tuple, W.op6_warc(spark, medium).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{medium}/pages.parquet'")
    assert got == sorted(c.sql(W.OP6_SQL).fetchall())


def test_revisits(spark, tmp_path):
    big, small_ = "x" * 1500, "y" * 10
    rows = [(1, "http://a/é b\r\n", big), (5, "u", big), (3, None, big), (7, "u", small_), (8, "u", small_), (9, "u", None), (None, "u", big), (10, "u", "long " * 400_000)]
    path = f"file://{tmp_path}/w"
    W.write_warc(pages(spark, rows), path)
    out = {r.page_id: r for r in W.resolve(W.read_warc(spark, path)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None), 10: ("response", None), None: ("response", None),
    }
    for i, _, html in rows:
        assert out[i].payload_bytes == len(html or "") and out[i].payload_digest == hashlib.sha1((html or "").encode()).hexdigest()


def test_files_are_gzip_members(spark, tmp_path):
    W.write_warc(pages(spark, [(i, "u", f"page {i}") for i in range(20)]).coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*")
    raw = file.read_bytes()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 20
    assert [x.page for x in W.salvage(gzip.decompress(raw))] == [x.page for x in W.salvage(raw)]  # not compressed, too


def test_files_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", "".join(chr(rng.randrange(33, 127)) for _ in range(20_000 if i == 7 else 300))) for i in range(40)]
    W.write_warc(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w", file_bytes=3000)
    files = [x.read_bytes() for x in (tmp_path / "w").glob("part-*")]
    assert len(files) > 5 and all(len(x) <= 3000 or len(list(W.salvage(x))) == 1 for x in files) and max(map(len, files)) > 3000
    found = W.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(i, t) for i, _, t in rows} and len(found) == 40


def test_large_record_ends_in_a_zero_byte():
    record = W.build(1, "u", bytes(17 << 20), None, "2024-01-01T00:00:00Z")
    raw = W.member(record)
    assert raw[-1] == 0 and gzip.decompress(raw) == record
    assert [(x.kind, x.page) for x in W.salvage(raw)] == [("record", 1)]


def archive(n=12):
    return [W.member(W.build(i, f"http://h/{i}", (f"body {i} " * 50).encode(), None, "2024-01-01T00:00:00Z")) for i in range(n)]


def spread(found):
    """Everything found, in order: no byte is lost or counted twice."""
    return sorted({(x.offset, x.length) for x in found})


@pytest.mark.parametrize("seed", range(8))
def test_salvage_damage(seed):
    rng = random.Random(seed)
    parts = archive()
    broken = set(rng.sample(range(12), 3))
    data = b""
    for i, p in enumerate(parts):
        if i in broken:
            kind = rng.randrange(4)
            k = rng.randrange(20, len(p) - 10)
            p = [p[:k], p[:k] + bytes([p[k] ^ 255]) + p[k + 1 :], rng.randbytes(300), p[3:]][kind]
        data += p
    found = list(W.salvage(data))
    assert [x.page for x in found if x.kind == "record"] == [i for i in range(12) if i not in broken]
    assert all(x.reason for x in found if x.kind == "gap")
    at = 0
    for offset, length in spread(found):
        assert offset == at
        at += length
    assert at == len(data)


def test_salvage_plain_records():
    good = [W.build(i, "u", f"text {i}".encode(), None, "2024-01-01T00:00:00Z") for i in range(4)]
    wrong_length = good[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    wrong_digest = good[2].replace(b"text 2", b"texT 2")
    found = list(W.salvage(good[0] + wrong_length + wrong_digest + b"junk" + good[3] + b"WARC/1.1\r\nbroken"))
    assert [(x.kind, x.page) for x in found] == [("record", 0), ("gap", None), ("record", 3), ("gap", None)]
    assert list(W.salvage(b"")) == [] and [x.kind for x in W.salvage(b"\0\0")] == ["gap"]


def test_gaps_are_logged(spark, tmp_path):
    parts = archive(3)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(parts[0] + parts[1][:-20] + parts[2])
    rows = W.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.kind, r.page_id, r.offset) for r in rows if r.kind == "record") == [("record", 0, 0), ("record", 2, len(parts[0] + parts[1]) - 20)]
    (gap,) = [r for r in rows if r.kind == "gap"]
    assert (gap.offset, gap.length) == (len(parts[0]), len(parts[1]) - 20) and gap.path.endswith("a.warc.gz")


def test_empty(spark, tmp_path):
    W.write_warc(pages(spark, []), f"file://{tmp_path}/w")
    assert W.resolve(W.read_warc(spark, f"file://{tmp_path}/w")).count() == 0
