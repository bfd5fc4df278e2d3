"""Archives written and read back: exact round trips, an independent parse of the files, and odd pages."""

import base64
import collections
import gzip
import hashlib
import io
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimloom.llm import store, warc


def brute(rows):
    groups = collections.defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((page is not None, page or 0, i, page))
    out = []
    for body, members in groups.items():
        best = max(members)
        for m in members:
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            out.append((m[3], len(body), digest, *(("response", None) if m == best else ("revisit", best[3]))))
    return collections.Counter(out)


def answer(df):
    return collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, table):
    t = pq.read_table(f"/root/testdata/{table}/pages.parquet").to_pylist()
    assert answer(warc.op11_warc(spark, f"/root/testdata/{table}")) == brute([(r["page_id"], r["url"], r["html"]) for r in t])


SCHEMA = "page_id long, url string, html string"
LONG = "Ünï\r\n\r\nWARC/1.1\r\n" * 40_000
ODD = [
    (1, "http://a/\r\nX: y z", "same"), (2, None, "same"), (2, "http://b", "same"), (9, "http://ü/%20", "same "), (None, "http://c", "same"), (None, "d", None), (3, "e", ""), (11, "e", ""), (-4, "f", ""),
    (5, "g", LONG), (6, "h", LONG), (7, "i", "\r\n"), (8, "j", "x" * warc.CHUNK), (10, "k", "x" * (warc.CHUNK + 1)), *[(100 + i, "hot", "copy") for i in range(300)],
]


@pytest.mark.parametrize("rows", [ODD, [(None, None, None)], []])
def test_odd_pages(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("record", "id", "chunk", "chunk_no", "body", "kind", "bytes"):
        df = df.withColumn(c, F.lit(1))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert answer(warc.op11_warc(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("chunk, least, size", [(97, 0, None), (1000, 5, 2000), (1 << 16, 10**9, 1)])
def test_round_trip(spark, chunk, least, size, monkeypatch):
    """Payloads come back to the byte, whatever the chunks, ranges and files; chunks carry the digests of prefixes."""
    rows = [(i, f"http://h/{i}", ("é" * (i % 90) + "ab" * (i % 7)) if i % 4 else "copy") for i in range(200)] + [(1000, "http://long", LONG)]
    if size:
        monkeypatch.setattr(warc, "RANGE", size)
    table = store.stored(warc.chunked(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk), "test")
    index = warc.write(table, warc.folder(spark), least=least)
    got = collections.defaultdict(list)
    for r in warc.read(index).collect():
        got[int(r.id)].append(r)
    full = {}
    for i, parts in got.items():
        parts.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in parts] == list(range(len(parts))) and [r.last for r in parts] == [False] * (len(parts) - 1) + [True]
        if parts[0].kind == "response":
            body = b"".join(r.chunk for r in parts)
            at = 0
            for r in parts:
                at += len(r.chunk)
                assert len(r.chunk) <= warc.CHUNK and r.bytes == at and r.digest == base64.b32encode(hashlib.sha1(body[:at]).digest()).decode()
            assert parts[-1].intact
            full[i] = body
    for i, url, html in rows:
        last = got[i][-1]
        ref = i if last.kind == "response" else int(last.refers_to)
        assert full[ref] == html.encode() and last.bytes == len(html.encode()) and last.url == url
        assert last.kind == "response" or len(html.encode()) >= least
    # the copies have four bytes, and nothing else is repeated
    assert sum(k[-1].kind == "revisit" for k in got.values()) == (49 if least == 0 else 0)


def test_files_are_plain_archives(spark):
    """Every indexed range is one gzip member with a record whose stated length is right, by the standard library alone."""
    rows = [(i, f"http://h/{i}", "p" * (i * 131 % 5000)) for i in range(60)]
    where = warc.folder(spark)
    index = warc.write(store.stored(warc.chunked(spark.createDataFrame(rows, SCHEMA)), "test"), where).collect()
    assert len(index) == 60
    for r in index:
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.start)
            data = gzip.GzipFile(fileobj=io.BytesIO(f.read(r.length))).read()
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        payload = rest[:-4].partition(b"\r\n\r\n")[2]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_broken_archives_are_refused():
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:=1:0>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n") + whole.flush()
    assert [r["chunk"] for r in warc.records(warc._Source(warc.inflated(io.BytesIO(data), len(data))))] == [b"hello"]
    for bad in (data[:-9], data[: len(data) // 2]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(warc._Source(warc.inflated(io.BytesIO(bad), len(bad)))))
