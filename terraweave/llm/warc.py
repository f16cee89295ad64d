"""WARC archives with revisit records.

Only headers (id, address, digest, size) are shuffled by payload digest. Of equal
payloads the record with the smallest id stays a response; the others become
revisits that refer to it. Archives are then written with fresh headers, one
gzip member per record, in files of bounded size, and can be read back, where
revisits are joined to their responses by record id.

Null payloads count as empty. Payloads below ``min_bytes`` are always responses.
A null id is never the original of a group that has other ids; in a group of null
ids alone all are responses. Rows that repeat the smallest id are responses, too.
A null address gives a record without target address; control characters in an
address are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraweave.llm.store import column_values, read_files, write_file

MIN_BYTES = 100
FILE_BYTES = 24 << 20
PIECE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2025-01-01T00:00:00Z"


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest) without the payloads."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.sha2(body, 256).alias("payload_digest"))


def resolve(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``heads`` with ``record_type`` and, for revisits, ``refers_to`` and ``refers_to_url``."""
    first = (
        heads.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("_first"))
        .select(F.col("payload_digest").alias("_digest"), "_first")
    )
    joined = heads.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & (
        F.col("page_id").isNull() | (F.col("page_id") != F.col("_first.page_id")))
    return joined.select(
        *heads.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first.page_id")).alias("refers_to"),
        F.when(again, F.col("_first.url")).alias("refers_to_url"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def _address(url: str) -> bytes:
    return quote(url, safe="".join(map(chr, range(33, 127)))).encode()


def _record(row: tuple, payload: bytes, date: str) -> bytes:
    page_id, url, size, digest, kind, refers_to, refers_url = row
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _record_id(page_id, digest).encode(),
            b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _address(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if page_id is not None:
        head.append(b"WARC-X-Page-ID: " + str(page_id).encode())
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE.encode(),
                 b"WARC-Refers-To: " + _record_id(refers_to, digest).encode(),
                 b"WARC-Refers-To-Date: " + date.encode()]
        if refers_url is not None:
            head.append(b"WARC-Refers-To-Target-URI: " + _address(refers_url))
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(size).encode() + b"\r\n\r\n")
    block = http + (payload if kind == "response" else b"")
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, resolved: DataFrame, folder: str, key: str = "page_id", url: str = "url",
                   payload: str = "html", file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per page into ``folder``; lazy: (file, records, bytes) of each archive."""
    kinds = resolved.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"),
                            "record_type", "refers_to", "refers_to_url").dropDuplicates(["_id", "_digest"])
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"),
                        body.alias("payload"))
    joined = (
        rows.join(kinds, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
        .withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
        .select("page_id", "url", "size", "digest", "record_type", "refers_to", "refers_to_url", "payload")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, size, n = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{n:06d}.warc.gz"
            written = write_file(folder, name, parts)
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(parts)], "bytes": [written]})

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *row, content in zip(*columns):
                member = gzip.compress(_record(tuple(row), content or b"", date), 1, mtime=0)
                parts.append(member)
                size += len(member)
                if size >= file_bytes:
                    yield close()
                    parts, size, n = [], 0, n + 1
        if parts:
            yield close()

    return joined.mapInArrow(write, "file string, records long, bytes long")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzipped archive."""
    at, view = 0, memoryview(content)
    while at < len(content):
        inflate = zlib.decompressobj(31)
        pieces = []
        while not inflate.eof and at < len(content):  # in pieces: what is left over is copied each time
            pieces.append(inflate.decompress(view[at:at + PIECE]))
            at += min(PIECE, len(content) - at) - len(inflate.unused_data)
        if not inflate.eof:
            raise ValueError("archive ends inside a record")
        record = b"".join(pieces)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; ``payload`` is null for revisits, whose size and digest are those of the full payload.

    A payload that does not match its digest fails the job.
    """
    schema = ("page_id long, url string, record_type string, record_id string, refers_record string, "
              "payload_bytes long, payload_digest string, payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            names = ["page_id", "url", "record_type", "record_id", "refers_record", "payload_bytes",
                     "payload_digest", "payload"]
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, size = [], 0
        for batch in batches:
            for content in column_values(batch, "content"):
                for fields, block in parse_archive(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    page = fields.get("WARC-X-Page-ID")
                    rows.append((None if page is None else int(page), fields.get("WARC-Target-URI"), kind,
                                 fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), length, digest,
                                 payload if kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return read_files(spark, folder, "*.warc.gz").mapInArrow(read, schema)


def link_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit names, null for responses."""
    originals = (records.where("record_type = 'response' and page_id is not null")
                 .select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")).distinct())
    return records.join(originals, F.col("refers_record") == F.col("_id"), "left").drop("_id")
