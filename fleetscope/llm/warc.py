"""Web archives: chunked record table -> WARC files -> records, with revisits for repeated payloads.

``chunk_records`` turns each row into chunk rows (record number, chunk number,
at most ``chunk_bytes`` of the payload, the SHA-1 of the payload up to the end of
the chunk, and the digest and length of the whole payload). Slices of the Arrow
buffer are hashed and handed on one by one, so no record is copied as a whole.
``write_archives`` decides which records are responses and which are revisits,
sorts the chunk rows by record and streams them, one after the other, into
gzip-per-record WARC/1.1 files in a shared folder. ``read_archives`` streams the
files back piece by piece and recomputes every digest.

Recovery: a task writes files whose names hold its attempt and a random part
and returns their names; only names that a successful task returned are in the
manifest (a Parquet table, committed by Spark). Files of lost attempts are never read.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes those with
the smallest id are responses, all others are revisits that refer to that id.
Null payloads are empty; null ids stay null and are never referred to while
another id has the payload; rows repeated with the same id and payload are both
written; null urls leave out the target header; line breaks in urls are percent-encoded. Other columns are not
carried. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, scratch_path, stage

CHUNK_BYTES = 64 * 1024
CHUNK_SCHEMA = ("record_no long, page_id long, url string, payload_bytes long, payload_digest string, "
                "chunk_no int, chunk binary, running_digest string")
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _pieces(payload: memoryview, size: int):
    for at in range(0, max(len(payload), 1), size):
        yield payload[at:at + size]


def _chunker(chunk_bytes: int, digests_only: bool):
    def run(batches):
        schema = _arrow(CHUNK_SCHEMA)
        for batch in batches:
            ids, nos, urls, htmls = (batch.column(c) for c in ("page_id", "record_no", "url", "html"))
            rows, held = [], 0
            for i in range(batch.num_rows):
                buf = htmls[i].as_buffer() if htmls[i].is_valid else None
                payload = memoryview(buf) if buf is not None else memoryview(b"")
                sha, running = hashlib.sha1(), []
                for piece in _pieces(payload, chunk_bytes):
                    sha.update(piece)
                    running.append(sha.copy().digest())
                whole = _base32(running[-1])
                head = (nos[i].as_py(), ids[i].as_py(), urls[i].as_py(), len(payload), whole)
                if digests_only:
                    rows.append((*head, len(running) - 1, None, whole))
                    continue
                for k, piece in enumerate(_pieces(payload, chunk_bytes)):
                    rows.append((*head, k, bytes(piece), _base32(running[k])))
                    held += len(piece)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def chunk_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html",
                  chunk_bytes: int = CHUNK_BYTES, digests_only: bool = False) -> DataFrame:
    """The chunked record table; ``digests_only``: the last chunk of each record, without its bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        (F.lit(None).cast("string") if digests_only else F.col(url_col)).alias("url"),
                        F.col(payload_col).alias("html"), F.monotonically_increasing_id().alias("record_no"))
    return rows.mapInArrow(_chunker(chunk_bytes, digests_only), CHUNK_SCHEMA)


def decide(digests: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, record_type, refers_to) per different record."""
    key = ["payload_digest", "payload_bytes"]
    recs = digests.select("page_id", *key).distinct()
    firsts = recs.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy(*key).agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return recs.join(firsts, key, "left").select(
        "page_id", *key, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def _warc_head(row: dict, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>",
            f"WARC-Date: {date}"]
    if row["url"] is not None:
        url = row["url"].replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {url}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    length = len(http) + (0 if revisit else row["payload_bytes"])
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + http


def _writer(folder: str, date: str, level: int, max_archive_bytes: int):
    def run(batches):
        ctx = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        state = {"out": None, "gz": None, "done": [], "name": None, "n": 0}

        def finish_record():
            if state["gz"] is not None:
                state["out"].write(state["gz"].compress(b"\r\n\r\n") + state["gz"].flush())
                state["gz"] = None

        def finish_file():
            finish_record()
            if state["out"] is not None:
                size = state["out"].tell()
                state["out"].close()
                state["done"].append((state["name"], state["n"], size))
                state["out"] = None

        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                if cols["chunk_no"][i].as_py() == 0:
                    finish_record()
                    if state["out"] is not None and state["out"].tell() > max_archive_bytes:
                        finish_file()
                    if state["out"] is None:
                        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{len(state['done'])}.warc.gz"
                        state.update(name=f"{folder}/{name}", out=store.open_output_stream(f"{root}/{name}", compression=None), n=0)
                    row = {c: cols[c][i].as_py() for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                    revisit = row["record_type"] == "revisit"
                    state["gz"] = zlib.compressobj(level, zlib.DEFLATED, 31)
                    state["out"].write(state["gz"].compress(_warc_head(row, date)))
                    state["n"] += 1
                if not revisit:
                    state["out"].write(state["gz"].compress(memoryview(cols["chunk"][i].as_buffer())))
        finish_file()
        if state["done"]:
            paths, n, size = zip(*state["done"])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                                             names=["path", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html",
                   min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z",
                   level: int = 1, max_archive_bytes: int = 1 << 30) -> DataFrame:
    """Write all rows as WARC records below ``folder`` (shared); returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    decisions = decide(chunk_records(pages, id_col, url_col, payload_col, chunk_bytes, digests_only=True), min_revisit_bytes)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    chunks = chunk_records(pages, id_col, url_col, payload_col, chunk_bytes).drop("running_digest").alias("c")
    d = decisions.alias("d")
    same = F.col("c.page_id").eqNullSafe(F.col("d.page_id")) & (F.col("c.payload_digest") == F.col("d.payload_digest")) & (
        F.col("c.payload_bytes") == F.col("d.payload_bytes"))
    rows = (chunks.join(d, same, "left").select("c.*", "record_type", "refers_to")
            .sortWithinPartitions("record_no", "chunk_no"))
    manifest = rows.mapInArrow(_writer(folder, date, level, max_archive_bytes), "path string, records long, bytes long")
    return stage(manifest, "warc-manifest")


class _Stream:
    """Bytes of a multi-member gzip file, piece by piece."""

    def __init__(self, raw):
        self.raw, self.gz, self.buf = raw, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            data = self.gz.unused_data if self.gz.eof else b""
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            if not data:
                data = self.raw.read(CHUNK_BYTES)
            if not data:
                return False
            got = self.gz.decompress(data)
            if got:
                self.buf = self.buf + got if self.buf else got
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.buf:
            if not self.more():
                return None
        out, _, self.buf = self.buf.partition(b"\r\n")
        return out

    def take(self, n: int):
        while n:
            if not self.buf and not self.more():
                raise ValueError("archive ends within a record")
            piece, self.buf = self.buf[:n], self.buf[n:]
            n -= len(piece)
            yield piece


def _headers(stream: _Stream) -> tuple[dict, int]:
    out, size = {}, 0
    while line := stream.line():
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode()
        size += len(line) + 2
    return out, size + 2


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _records(stream: _Stream):
    while True:
        line = stream.line()
        while line == b"":
            line = stream.line()
        if line is None:
            return
        head, _ = _headers(stream)
        stream.line()                                       # the HTTP status line
        http, size = _headers(stream)
        size += len(b"HTTP/1.1 200 OK\r\n")
        sha, n = hashlib.sha1(), 0
        for piece in stream.take(int(head["content-length"]) - size):
            for part in _pieces(memoryview(piece), CHUNK_BYTES):
                sha.update(part)
                n += len(part)
        said = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and (_base32(sha.digest()) != said or n != int(http["content-length"])):
            raise ValueError(f"record {head['warc-record-id']}: payload and digest differ")
        yield (_page(head["warc-record-id"]), int(http["content-length"]), said if revisit else _base32(sha.digest()),
               head["warc-type"], _page(head["warc-refers-to"]) if revisit else None, head.get("warc-target-uri"))


def _reader(batches):
    schema = _arrow(RECORD_SCHEMA)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at = pafs.FileSystem.from_uri(path)
            rows = []
            with store.open_input_stream(at, compression=None) as raw:
                for row in _records(_Stream(raw)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's files; response digests are those of the bytes read back."""
    n = max(1, min(manifest.count(), 64 * parts(manifest.sparkSession)))
    return manifest.select("path").repartition(n).mapInArrow(_reader, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(pages, folder, **options))


def oracle_sql(min_revisit_bytes: int = 0) -> str:
    return f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) b FROM pages),
f AS (SELECT *, CASE WHEN octet_length(b) >= {min_revisit_bytes} THEN min(page_id) OVER (PARTITION BY b) END first FROM p),
-- bare upper-case base32 of the SHA-1: 160 bits in groups of five
s AS (SELECT *, lpad(list_reduce(list_transform(range(1, 41), lambda i:
  right('000' || bin(instr('0123456789abcdef', sha1(b)[i]) - 1), 4)), lambda x, y: x || y), 160, '0') bits FROM f)
SELECT page_id, octet_length(b)::BIGINT payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * (bits[5 * i + 1])::INT + 8 * (bits[5 * i + 2])::INT + 4 * (bits[5 * i + 3])::INT
     + 2 * (bits[5 * i + 4])::INT + (bits[5 * i + 5])::INT), 1)), lambda x, y: x || y) payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN first END refers_to, url target_uri
FROM s"""
