from __future__ import annotations

import base64
import gzip
import hashlib
import io

import oracle
from pyarrow import fs

from tessera.llm import queries, warc
from tessera.llm.common import fresh_path, read

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, digest string, payload string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def check(rows, pages, least=0):
    first = {}
    for p, _, html, *_ in pages:
        if p is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", p), p)
    want = []
    for p, _, html, *_ in pages:
        html = html or ""
        again = html in first and p is not None and p != first[html]
        want.append((p, len(html.encode()), digest(html), "revisit" if again else "response", first[html] if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_whole_table(spark):
    pages = read(spark, SF, "pages")
    check(warc.round_trip(pages).collect(), [tuple(r) for r in pages.collect()])


def test_sql(spark):
    sql = queries.oracle_sql()["op6_warc_chunks"]
    assert oracle.compare(queries.op6_warc_chunks(spark, SF), oracle.connect(SF), sql) is None


def test_edge_rows(spark):
    big = "é<p>" * 100_000
    rows = [(5, None, None, "", ""), (2, "http://a b\r\nc/", "", "", ""), (3, "u", big, "", ""), (1, "u", big, "", ""), (8, "u", big, "", ""), (9, "u", "x\r\n\r\nWARC/1.1\r\n", "", ""), (9, "u", "x\r\n\r\nWARC/1.1\r\n", "", ""), (None, "u", "alone", "", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    check(warc.round_trip(pages, chunk_bytes=1000).collect(), rows)
    check(warc.round_trip(pages, least_bytes=10).collect(), rows, 10)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_chunks_carry_incremental_digests(spark):
    text = "abcdefghij" * 1000
    pages = spark.createDataFrame([(1, "u", text, "", "")], SCHEMA)
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(warc.chunk_table(warc.record_roles(pages), 777), folder)
    chunks = sorted(warc.read_archives(spark, manifest, folder, chunk_bytes=999).collect(), key=lambda r: r["chunk"])
    assert [r["chunk"] for r in chunks] == list(range(11)) and chunks[-1]["last"]
    so_far = b""
    for r in chunks:
        so_far += bytes(r["data"])
        assert r["bytes_so_far"] == len(so_far) and r["digest_so_far"] == digest(so_far.decode())
    assert so_far.decode() == text
    (path,) = [r["path"] for r in manifest.collect()]
    store, _ = fs.FileSystem.from_uri(folder)
    raw = gzip.decompress(store.open_input_stream(path, compression=None).read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(text.encode() + b"\r\n\r\n")


def test_broken_records_are_refused():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:x>\r\nContent-Length: 5\r\nWARC-Payload-Digest: sha1:AAAA\r\n\r\n"
    for data in (head + b"abc", head + b"abcde\r\n\r\n", b"nonsense\r\n"):
        try:
            list(warc.read_records(io.BytesIO(data)))
            raise AssertionError("not refused")
        except ValueError:
            pass
