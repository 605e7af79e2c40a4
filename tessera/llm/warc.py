"""WARC archives written and read through a chunked record table.

A payload travels as rows of record identifier, chunk number and bytes; each row
carries the digest and the length of the payload up to and including it, so a
consumer needs one chunk at a time and a payload of any size is never put
together.  ``chunk_table`` cuts payloads natively.  The writer streams the
chunks of a partition into gzip members, one a record, and names its file after
what it wrote; a file is complete once its name is in the manifest that the
tasks return, so files of lost or repeated attempts are never read.  The reader
streams members back into the same chunk rows, verifying lengths and digests.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with
the smallest id is a ``response`` and the others are ``revisit`` records that
refer to it and hold no payload; smaller payloads are all responses.

Defined cases: a null payload is an empty one; a null url is an empty target;
records with a null id are written with an empty id and never referred to if
another has an id; rows repeated with the smallest id are all responses; an
empty table gives no archive and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, stash

CHUNK_BYTES = 1 << 16
READ_BYTES = 1 << 16
#: Bytes of an archive after which a writer starts the next.
ARCHIVE_BYTES = 1 << 28
CHUNK_SCHEMA = "record_id string, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean, record_type string, page_id long, refers_to long, target string"
CRLF = b"\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``payload`` (UTF-8), ``digest``, ``record_type`` and ``refers_to``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("target"), payload.alias("payload"))
    keys = rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n"))
    keys = stash(keys, "digests")
    first = keys.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    roles = keys.join(first, "digest", "left").filter(F.col("page_id") != F.col("first"))
    roles = roles.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    joined = rows.join(roles, (rows["page_id"] == roles["id"]) & (rows["digest"] == roles["d"]), "left").drop("id", "d")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``(record_id, chunk, data, size, digest, record_type, page_id, refers_to, target)``.

    ``size`` and ``digest`` are the whole payload's.  A revisit has one chunk without data.
    """
    size = F.octet_length("payload")
    n = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(size / chunk_bytes))).cast("int")
    number = F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk", "__n")
    rows = records.select("*", number)
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("digest")))
    return rows.select(
        name.alias("record_id"), "chunk", data.alias("data"), size.cast("long").alias("size"), "digest", "record_type",
        "page_id", "refers_to", "target", (F.col("chunk") == n - 1).alias("last"),
    )


def _header(row: dict) -> bytes:
    kind = row["record_type"]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(row["target"].split()), f"WARC-Payload-Digest: sha1:{base32_sha1(row['digest'])}",
    ]
    if kind == "revisit":
        lines += [
            f"WARC-Refers-To: <urn:page:{row['refers_to']}:{row['digest'].hex()}>", f"X-Payload-Length: {row['size']}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Length: 0",
        ]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {row['size']}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF


class _Member:
    """One gzip member of an open file, fed chunk by chunk."""

    def __init__(self, file, level: int):
        self.file, self.deflate, self.size = file, zlib.compressobj(level, wbits=31), 0

    def put(self, data: bytes) -> None:
        self._out(self.deflate.compress(data))

    def close(self) -> int:
        self._out(self.deflate.flush())
        return self.size

    def _out(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)


def write_archives(chunks: DataFrame, folder: str, level: int = 2) -> DataFrame:
    """Write chunk rows (a record's in order, in one partition) as ``.warc.gz`` files.

    Returns the manifest ``(path, records, bytes)``, already written to the shared folder.
    """
    names = ["record_id", "chunk", "data", "size", "digest", "record_type", "page_id", "refers_to", "target", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        file = member = None
        path, records, size = "", 0, 0
        for batch in batches:
            columns = [batch.column(n) for n in names]
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}
                if file is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(path, compression=None)
                if member is None:
                    member = _Member(file, level)
                    member.put(_header(row))
                if row["data"]:
                    member.put(row["data"])
                if row["last"]:
                    member.put(CRLF + CRLF)
                    size += member.close()
                    records, member = records + 1, None
                    if size >= ARCHIVE_BYTES:
                        file.close()
                        done.append((path, records, size))
                        file = None
        if file is not None:
            file.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return stash(chunks.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_records(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of the WARC records of an uncompressed byte stream, in the order of ``CHUNK_SCHEMA``."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        left, chunk, so_far, sha = int(head["content-length"]), 0, 0, hashlib.sha1()
        record_id = head["warc-record-id"].strip("<>")
        kind, target = head["warc-type"], head.get("warc-target-uri", "")
        page = record_id.split(":")[2]
        said = head.get("warc-payload-digest", "").removeprefix("sha1:")
        common = (kind, int(page) if page else None)
        if kind == "revisit":
            other = head["warc-refers-to"].strip("<>").split(":")[2]
            stream.read(left)
            yield record_id, 0, b"", int(head.get("x-payload-length", 0)), said, True, *common, int(other), target
            continue
        while True:
            data = stream.read(min(left, chunk_bytes))
            if left and not data:
                raise ValueError(f"{record_id} is cut short")
            left, so_far = left - len(data), so_far + len(data)
            sha.update(data)
            digest = base32_sha1(sha.copy().digest())
            if not left and said and digest != said:
                raise ValueError(f"{record_id}: payload digest {digest}, header {said}")
            yield record_id, chunk, data, so_far, digest, not left, *common, None, target
            chunk += 1
            if not left:
                break


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the manifest's archives; each file is one unit of work."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_ARROW[x.split()[1]] for x in CHUNK_SCHEMA.split(", ")]
        store, _ = fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in read_records(stream, chunk_bytes):
                        size += len(row[2])
                        held.append(row if with_data else (*row[:2], None, *row[3:]))
                        if len(held) >= 4096 or size >= 1 << 23:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    paths = manifest.select("path").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    return paths.mapInArrow(run, CHUNK_SCHEMA)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record for each page and read the archives back: a row for each record."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(chunk_table(record_roles(pages, least_bytes), chunk_bytes), folder)
    chunks = read_archives(spark, manifest, folder, with_data=False, chunk_bytes=chunk_bytes)
    return chunks.filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )
