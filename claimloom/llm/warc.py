"""WARC archives through a chunked record table.

A payload travels as rows ``(record, chunk_no, chunk)`` of at most ``CHUNK`` bytes; each row carries the bytes and the SHA-1 of
the payload up to its end, so the last one has the record's.  Python sees batches of chunks and never a whole payload, on
the way in (a JVM ``posexplode``), into the archive (header row and chunks, sorted behind a shuffle by record) and out of it
(a streaming reader that inflates ``CHUNK`` bytes at a time).

Of records with equal payloads (by SHA-256 and length) of at least ``least`` bytes the one of the largest id is written as
``response``, the others as ``revisit`` that refer to it and hold no payload; smaller ones are all responses.  Archives are
WARC/1.1, a gzip member for each record, and each attempt of a task writes files of its own; the index names those of the
attempts that count, so a lost executor leaves stray files and no wrong ones.  Readers take ranges of about ``RANGE`` bytes
between records, so a large file is read by many tasks.  Files go through ``pyarrow.fs``, to any folder it and the executors reach.

A null payload is an empty one; null ids count as smaller than all others and are read back as null; of rows that share the
largest id one is the response; a null address is left out of the header, blanks and control characters in one are
percent-encoded; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.store import discard, shared_dir, small_batches, stored, temporary

CHUNK = 1 << 16
#: Compressed bytes after which a writer begins another file, and which a reader takes at once.
FILE, RANGE = 1 << 29, 1 << 25
_BLOCK = 1 << 18


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


_CHUNKS = "record long, id string, url string, chunk_no int, chunk binary, last boolean"


def _running(schema: pa.Schema):
    """Adds to each chunk the bytes and digest of its payload so far; chunks of a record come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            sizes, digests, same = [], [], []
            for no, chunk, last in zip(*(batch.column(c).to_pylist() for c in ("chunk_no", "chunk", "last"))):
                if no == 0:
                    sha1, sha256, size = hashlib.sha1(), hashlib.sha256(), 0
                sha1.update(chunk)
                sha256.update(chunk)
                size += len(chunk)
                sizes.append(size)
                digests.append(_base32(sha1))
                same.append(sha256.digest() if last else None)
            more = [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=schema)

    return run


def chunked(rows: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of ``rows``: ``record, id, url, chunk_no, chunk, last, bytes, digest`` (of the payload to the chunk's end), and on last rows ``same`` (SHA-256)."""
    small_batches(rows.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    out = rows.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("string").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    # an empty payload has one empty chunk
    ends = F.expr(f"transform(sequence(0, cast(greatest(octet_length(body) - 1, 0) div {chunk} as int)), k -> substring(body, k * {chunk} + 1, {chunk}))")
    out = out.select("record", "id", "url", F.expr(f"cast(greatest(octet_length(body) - 1, 0) div {chunk} as int)").alias("final"), F.posexplode(ends).alias("chunk_no", "chunk"))
    out = out.select("record", "id", "url", "chunk_no", "chunk", (F.col("chunk_no") == F.col("final")).alias("last"))
    schema = _schema(f"{_CHUNKS}, bytes long, digest string, same binary")
    return out.mapInArrow(_running(_arrow(schema)), schema)


def decided(heads: DataFrame, least: int) -> DataFrame:
    """``heads`` (last rows of records) with ``kind`` and, for revisits, ``ref_id`` and ``ref_record`` of the response."""
    number = F.col("id").try_cast("decimal(38,0)")  # ids that are numbers by value, before all others by name
    order = F.struct(F.col("id").isNotNull().alias("given"), number.isNull().alias("named"), number.alias("number"), "id", "record")
    groups = heads.filter(F.col("bytes") >= least).groupBy("same", "bytes").agg(F.max(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("same", "bytes", F.col("best.id").alias("ref_id"), F.col("best.record").alias("ref_record"))
    out = heads.join(groups, ["same", "bytes"], "left")
    copy = F.col("ref_record").isNotNull() & (F.col("ref_record") != F.col("record"))
    return out.withColumns({"kind": F.when(copy, "revisit").otherwise("response"), "ref_id": F.when(copy, F.col("ref_id")), "ref_record": F.when(copy, F.col("ref_record"))})


def _urn(id_: str | None, record: int) -> str:
    return f"<urn:row:{'' if id_ is None else '=' + quote(id_, safe='')}:{record}>"


def _urn_id(urn: str) -> str | None:
    said = urn.strip("<>").split(":")[2]
    return unquote(said[1:]) if said else None


def _head(r: dict, date: str) -> bytes:
    """WARC and HTTP headers of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {r['kind']}", f"WARC-Record-ID: {_urn(r['id'], r['record'])}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{r['digest']}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]))
    if r["kind"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(r['ref_id'], r['ref_record'])}"]
    body = len(http) + (r["bytes"] if r["kind"] == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + http


_INDEX = "path string, start long, length long, record long, kind string"


def _writing(where: str, date: str, level: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, folder = fs.FileSystem.from_uri(where)
        out, path, file, at, start = [], "", None, 0, 0
        now = pack = None

        def opened() -> None:
            nonlocal path, file, at
            path, at = f"{where}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
            files.create_dir(folder, recursive=True)
            file = files.open_output_stream(folder + path[len(where) :], compression=None)

        def put(data: bytes) -> None:
            nonlocal at
            file.write(data)
            at += len(data)

        def closed() -> None:
            put(pack.compress(b"\r\n\r\n") + pack.flush())
            out.append({"path": path, "start": start, "length": at - start, "record": now["record"], "kind": now["kind"]})

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] < 0:
                    if now is not None:
                        closed()
                    if file is not None and at >= FILE:
                        file.close()
                        file = None
                    if file is None:
                        opened()
                    now, start, pack = r, at, zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(pack.compress(_head(r, date)))
                elif now["kind"] == "response":
                    put(pack.compress(r["chunk"]))
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now is not None:
            closed()
            file.close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def write(table: DataFrame, where: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes the chunked record table as archives below ``where`` and returns the index: ``path, start, length, record, kind``."""
    heads = decided(table.filter("last").drop("chunk", "chunk_no", "last"), least)
    heads = heads.select("record", F.lit(-1).alias("chunk_no"), "id", "url", "bytes", "digest", "kind", "ref_id", "ref_record")
    rows = heads.unionByName(table.select("record", "chunk_no", "chunk"), allowMissingColumns=True)
    rows = rows.repartition("record").sortWithinPartitions("record", "chunk_no")
    schema = _schema(_INDEX)
    return stored(rows.mapInArrow(_writing(where, date, level, _arrow(schema)), schema), "warc-index")


def inflated(file, left: int) -> Iterator[bytes]:
    """At most ``CHUNK`` bytes at a time of the gzip members in the next ``left`` bytes of ``file``."""
    member, data, begun = zlib.decompressobj(31), b"", False
    while True:
        if not data:
            data = file.read(min(_BLOCK, left))
            left -= len(data)
            if not data:
                break
        piece = member.decompress(data, CHUNK)
        begun, data = True, member.unconsumed_tail
        if piece:
            yield piece
        if member.eof:
            data, member, begun = member.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends inside a record")


class _Source:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def line(self) -> bytes | None:
        """The next line without its end; None behind the last."""
        while (end := self.held.find(b"\r\n")) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return None
            self.held += piece
        out, self.held = self.held[:end], self.held[end + 2 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise ValueError("the archive ends inside a payload")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def headers(self) -> tuple[dict[str, str], int]:
        """Named fields up to the blank line, and the bytes they took."""
        out, took = {}, 0
        while text := self.line():
            took += len(text) + 2
            name, _, value = text.decode("utf-8", "surrogatepass").partition(":")
            out[name.strip().lower()] = value.strip()
        return out, took + 2


def records(source: _Source) -> Iterator[dict]:
    """Chunk rows of the records: of a revisit one without a payload, which states the bytes and digest of the full one."""
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        said, _ = source.headers()
        left, http = int(said["content-length"]), {}
        if said.get("content-type", "").startswith("application/http"):
            status = source.line()
            http, took = source.headers()
            left -= len(status) + 2 + took
        refers = said.get("warc-refers-to")
        urn = said["warc-record-id"]
        base = {"record_id": urn, "id": _urn_id(urn), "kind": said["warc-type"], "url": said.get("warc-target-uri"), "refers_to": refers and _urn_id(refers)}
        stated = said.get("warc-payload-digest", "").removeprefix("sha1:")
        if said["warc-type"] == "revisit":
            for _ in source.take(left):
                pass
            yield base | {"chunk_no": 0, "chunk": None, "last": True, "bytes": int(http["content-length"]), "digest": stated, "intact": None}
        else:
            sha1, size, no = hashlib.sha1(), 0, 0
            pieces = source.take(left) if left else [b""]
            for no, piece in enumerate(pieces):
                sha1.update(piece)
                size += len(piece)
                last = size == left
                digest = _base32(sha1)
                yield base | {"chunk_no": no, "chunk": piece, "last": last, "bytes": size, "digest": digest, "intact": digest == stated if last else None}
        if source.line() or source.line():
            raise ValueError("a record is longer than it says")


_READ = "record_id string, id string, kind string, url string, refers_to string, chunk_no int, chunk binary, last boolean, bytes long, digest string, intact boolean"


def _reading(payload: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(r["path"])
                with files.open_input_file(path) as file:
                    file.seek(r["start"])
                    for row in records(_Source(inflated(file, r["length"]))):
                        if not payload:
                            if not row["last"]:
                                continue
                            row["chunk"] = None
                        out.append(row)
                        held += len(row["chunk"] or b"")
                        if held > CHUNK * 32 or len(out) >= 512:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``index``; without ``payload`` only each record's last row, its payload read and digested all the same."""
    small_batches(index.sparkSession)
    part = F.floor(F.col("start") / RANGE)
    ranges = index.groupBy("path", part.alias("part")).agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    most = 8 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.drop("part").repartition(max(1, min(most, ranges.count())))
    schema = _schema(_READ)
    return ranges.mapInArrow(_reading(payload, _arrow(schema)), schema)


def folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one, removed when the driver's JVM ends."""
    where = re.sub("^file:/(?!/)", "file:///", f"{shared_dir(spark)}/claimloom/warc-{uuid.uuid4().hex}")
    temporary(spark, where)
    return where


def op11_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table = stored(chunked(pages), "warc-chunks")
    index = write(table, folder(spark))
    discard(table)
    kind = pages.schema["page_id"].dataType
    return read(index, payload=False).select(F.col("id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


#: Base 32 of a SHA-1 in hex: five hex digits are four letters.
_B32 = "list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::bigint >> (5 * (3 - i % 4))::bigint) & 31), 1)), lambda a, b: a || b)"
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) = 1 AS first, max(page_id) OVER (PARTITION BY h) AS ref FROM p)
SELECT page_id, strlen(h) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN ref END AS refers_to FROM r
"""
