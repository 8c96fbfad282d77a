"""WARC archives written from and read into a table of chunks.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes: the writer appends each to its archive, the reader
emits each with the SHA-1 of all bytes so far. Neither Python side ever holds a whole record. Payloads that occur more than once
are stored once; the other records revisit it.

Archives are WARC/1.1 files with a gzip member for each record, below the shared folder, one or more for each task under names of
its own; the table of archives, written by Spark, lists those of tasks that succeeded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.session import scratch_dir

CHUNK = 1 << 20
#: smaller payloads are never revisits
LEAST_SHARED = 1000
ARCHIVE_BYTES = 1 << 30
#: of gzip
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, records long, bytes long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, chunk int, size int, so_far long, digest_so_far string,"
    " last boolean, data binary"
)
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
NAMES = [f.split()[0] for f in CHUNKS.split(", ")]


# --- writing ---


def chunk_table(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, digest, bytes, refers_to, chunk, data): the records in rows of at most ``CHUNK`` bytes.

    Of equal payloads of at least ``least_shared`` bytes the largest page_id holds the bytes; the others refer to it and
    have one row without data. Only groups that occur twice are joined, so unshared payloads meet nothing.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    shared = rows.where(f"bytes >= {least_shared}").groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b"))
    shared = shared.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").drop("n")
    rows = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    pieces = F.expr(
        f"transform(sequence(0L, greatest(0L, (bytes - 1) div {CHUNK})), i -> substring(payload, cast(i * {CHUNK} + 1 AS int), {CHUNK}))"
    )
    rows = rows.withColumn("refers_to", refers).withColumn("pieces", F.when(F.col("refers_to").isNull(), pieces).otherwise(F.array(F.lit(b""))))
    return rows.select("page_id", "url", "digest", "bytes", "refers_to", F.posexplode("pieces").alias("chunk", "data"))


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def opening(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """All of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


#: left as they are in a target URI; the percent sign among them, as the URI may be encoded already
SAFE = "%/:?#[]@!$&'()*+,;=-._~"


class Archive:
    """An archive being written, a gzip member for each record."""

    def __init__(self, store: fs.FileSystem, folder: str):
        self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out = store.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.member = None

    def start(self, head: bytes) -> None:
        self.finish()
        self.member = zlib.compressobj(LEVEL, wbits=31)
        self.records += 1
        self.add(head)

    def add(self, data) -> None:
        self.size += self.out.write(self.member.compress(data))

    def finish(self) -> None:
        if self.member is not None:
            self.add(b"\r\n\r\n")
            self.size += self.out.write(self.member.flush())
            self.member = None

    def closed(self) -> pa.RecordBatch:
        self.finish()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.records]), pa.array([self.size])], ["path", "records", "bytes"])


def written_batches(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    archive = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "bytes", "refers_to", "chunk")]
        for page_id, url, digest, length, refers_to, chunk, data in zip(*columns, batch.column("data")):
            if chunk == 0:
                if archive is not None and archive.size >= ARCHIVE_BYTES:
                    yield archive.closed()
                    archive = None
                archive = archive or Archive(store, folder)
                archive.start(opening(page_id, url, digest, length, refers_to))
            archive.add(data.as_buffer())
    if archive is not None:
        yield archive.closed()


def write(pages: DataFrame) -> tuple[str, DataFrame]:
    """Writes the pages' archives; returns their folder and the table (path, records, bytes) of archives.

    A null html is an empty payload, a null url leaves out the target, a null page_id its header; repeated rows are
    written each. Other columns are ignored. No pages give no archive.
    """
    root = scratch_dir(pages.sparkSession, "warc")
    if "://" not in root:
        root = "file://" + root
    return root, stored(chunk_table(pages).mapInArrow(lambda it: written_batches(it, root), WRITTEN), "warc-archives")


# --- reading ---


def headers(stream: io.BufferedReader) -> dict[str, str]:
    """Header fields up to the empty line, names in lower case."""
    out = {}
    for line in iter(stream.readline, b"\r\n"):
        if not line.endswith(b"\r\n"):
            raise ValueError("an archive ends inside a header")
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def chunks_of(stream: io.BufferedReader, chunk: int, with_data: bool) -> Iterator[tuple]:
    """The rows of every record in an archive, in order."""
    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {version[:40]!r}")
        head = headers(stream)
        left = int(head["content-length"])
        at = stream.tell()
        stream.readline()
        http = headers(stream)
        left -= stream.tell() - at
        page_id, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        front = (page_id and int(page_id), head.get("warc-target-uri"), head["warc-type"], refers and int(refers))
        if head["warc-type"] == "revisit":
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            yield (*front, 0, 0, int(http["content-length"]), digest, True, None)
        else:
            sha, done, number = hashlib.sha1(), 0, 0
            while left or not number:
                data = stream.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError("an archive ends inside a record")
                sha.update(data)
                left, done = left - len(data), done + len(data)
                yield (*front, number, len(data), done, sha.copy().hexdigest(), not left, data if with_data else None)
                number += 1
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its length says")


def read_batches(batches: Iterator[pa.RecordBatch], root: str, chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    store, folder = fs.FileSystem.from_uri(root)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with store.open_input_file(f"{folder}/{path}") as raw:
                rows, held = [], 0
                for row in chunks_of(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20), chunk, with_data):
                    rows.append(row)
                    held += row[5] if with_data else 100
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)


def read(root: str, archives: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of all records in the archives: bytes, and length and SHA-1 of the payload so far. A revisit has one
    row, with the length and digest of the payload that it refers to and no bytes. Damaged archives fail."""
    files = archives.count()
    listed = archives.select("path").repartition(max(1, files))
    return listed.mapInArrow(lambda it: read_batches(it, root, chunk, with_data), CHUNKS)


def written_and_read(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the archives."""
    root, archives = write(pages)
    done = read(root, archives, with_data=False).where("last")
    return done.selectExpr("page_id", "so_far AS payload_bytes", "digest_so_far AS payload_digest", "record_type", "refers_to")
