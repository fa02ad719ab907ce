import gzip
import hashlib
import io

import pytest

from riskloom.llm import warc

LONG = "x" * 3000 + "é日" * 2000
ROWS = [(1, "http://a/1", "<p>small</p>"), (2, "http://a/2", "<p>small</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", LONG),
        (6, "http://a/6?x=%20\r\ny", LONG), (7, "http://a/7", LONG), (7, "http://a/7", LONG), (8, "u", "é" * 500), (9, "u", "é" * 500),
        (10, "u", "é" * 499), (11, "u", "é" * 499), (None, "n", "z" * 1500), (None, "m", "z" * 1500), (None, None, None),
        (12, "t", "a\r\n\r\nWARC/1.1\r\n\r\n" * 300), (13, "v", "lonely" * 400)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "text", 3, "x") for r in ROWS], "page_id bigint, url string, html string, record_type string, chunk int, data string"
                                 ).repartition(3)


def brute():
    out = []
    raw = [(i, u, (h or "").encode()) for i, u, h in ROWS]
    for k, (i, u, p) in enumerate(raw):
        same = [(j is not None, j or 0, v is not None, v or "", -n) for n, (j, v, q) in enumerate(raw) if q == p]
        first = -max(same)[-1]
        revisit = len(p) >= 1000 and first != k
        out.append((i, u, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", raw[first][0] if revisit else None))
    return out


@pytest.mark.parametrize("chunk, roll", [(64, 500), (1 << 20, 1 << 30)])
def test_round_trip(spark, pages, tmp_path, chunk, roll):
    path = f"file:{tmp_path}/w"
    warc.write(pages, path, chunk=chunk, roll=roll)
    rows = warc.read(spark, path, chunk=chunk).collect()
    last = [(r.page_id, r.url, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in rows if r["last"]]
    assert sorted(last, key=repr) == sorted(brute(), key=repr)
    assert max(len(r.data) for r in rows) <= chunk
    whole = {r.record_id: bytes(r.payload) for r in warc.payloads(warc.read(spark, path, chunk=chunk)).collect()}
    digests = {r.record_id: r.digest for r in rows if r["last"] and r.record_type == "response"}
    assert all(hashlib.sha1(whole[i]).hexdigest() == d for i, d in digests.items())
    # each chunk carries the digest of all before it and itself
    for r in rows:
        if r.record_type == "response":
            assert r.digest == hashlib.sha1(whole[r.record_id][:r.chunk * chunk + len(r.data)]).hexdigest()
    assert all(r.refers_record in digests for r in rows if r.record_type == "revisit")
    short = warc.read(spark, path, contents=False).collect()
    assert len(short) == len(ROWS) and all(r.data is None for r in short)


def test_files_are_gzip_members_of_warc(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    manifest = spark.read.parquet(str(tmp_path / "w" / "manifest")).collect()
    assert sum(m.records for m in manifest) == len(ROWS)
    for m in manifest:
        raw = (tmp_path / "w" / m.file).read_bytes()
        assert len(raw) == m.bytes
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")


def test_damage_is_found(spark, pages, tmp_path):
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    file = max((tmp_path / "w").glob("*.warc.gz"), key=lambda f: f.stat().st_size)
    text = gzip.decompress(file.read_bytes())
    list(warc.records_of(io.BytesIO(gzip.compress(text))))
    at = text.index(b"zzzz")
    with pytest.raises(ValueError, match="digest"):
        list(warc.records_of(io.BytesIO(gzip.compress(text[:at] + b"y" + text[at + 1:]))))
    with pytest.raises(ValueError, match="shorter|header|end"):
        list(warc.records_of(io.BytesIO(gzip.compress(text[:-2]))))


def test_empty_table(spark, pages, tmp_path):
    warc.write(pages.where("false"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []


def test_inflate_holds_a_piece_at_a_time():
    source = warc.Inflate(io.BytesIO(gzip.compress(b"a" * 10_000_000) + gzip.compress(b"b" * 5)), 4096)
    assert source.take(9_999_000) == b"a" * 9_999_000
    held = warc.Inflate(io.BytesIO(gzip.compress(b"a" * 10_000_000)), 4096)
    held.take(10)
    assert len(held.held) <= 4096
    assert source.take(1005) == b"a" * 1000 + b"b" * 5
