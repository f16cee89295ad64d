"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
id, level k the k-th chunk of those ids that need it. A bitmap per level says
which ids go on, and a rank directory (set bits before each block of 512) turns
a position of one level into that of the next. Any id, or any range of ids, is
read from these arrays directly: nothing before it is decoded.

Documents are dealt to files by ranges of their id; files are of bounded size
(one document is never split), and their names sort in document order.

Null texts count as empty: the document consists of its end id. Documents with a
null id come first. Repeated ids stay separate documents, ordered by their token
bytes. Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terraweave.llm.common import new_folder
from terraweave.llm.store import column_values, read_files, write_file
from terraweave.llm.unit_cache import UnitCache
from terraweave.session import cut

MAGIC = b"TWDAC001"
BLOCK = 512  # bits per entry of a rank directory
FILE_IDS = 1 << 20
ENCODE_ROWS = 128  # texts that share calls of the tokenizer
CACHE_BYTES = 48 << 20  # of the units that a worker keeps

# Units: places where byte-level pre-tokenization always cuts. A Latin word before white space or ASCII punctuation,
# such punctuation before white space or a Latin letter, else a run of non-spaces, each with the one space before it;
# or a run of white space. Texts with rarer white space or with added tokens are encoded in one piece.
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r'.,!?;:"()|*$%&#<>/=\-'
UNITS = re.compile(rf" ?[{_LATIN}]++(?![^{_MARKS}\s])| ?[{_MARKS}]++(?![^{_LATIN}\s])| ?\S+|\s+(?=\s\S)|\s+")
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Whole texts to little-endian ids of 2 bytes, or 4 for large vocabularies; ids of repeated units are remembered."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = self._cuts_at_units()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = special[0] if special else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = UnitCache(cache_bytes, self.dtype)

    def _cuts_at_units(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        return bool(plain and not spec.get("normalizer"))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; short texts share calls, held apart by a special token."""
        if self.mark is None or any(self.mark[0] in t for t in texts):
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype=self.dtype) for e in found]
        if not texts:
            return []
        joined = self.tokenizer.encode_batch_fast([self.mark[0].join(texts)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, dtype=self.dtype)
        cuts = np.flatnonzero(ids == self.mark[1]).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, in ``dtype``."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_unit or RARE_SPACE.search(t) or any(a in t for a in self.added)]
        for i in whole:
            out[i] = self._ids([texts[i]])[0].tobytes()
        rest = sorted(set(range(len(texts))) - set(whole))
        rows = [UNITS.findall(texts[i]) for i in rest]
        ids, sizes = self.cache.encode(list(chain.from_iterable(rows)), self._ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, rows)])]
        for i, lo, hi in zip(rest, ends, ends[1:]):
            out[i] = ids[lo:hi].tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")


def dac_bytes(ids: np.ndarray) -> bytes:
    """Levels of one id array: for each, its length, chunks, continuation bitmap and rank directory."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = (rest >> 8) > 0
        last = not more.any()
        levels.append(np.array([len(rest), last], dtype="<u8").tobytes() + (rest & 255).astype(np.uint8).tobytes())
        if last:
            return b"".join(levels)
        levels.append(np.packbits(more, bitorder="little").tobytes() + _rank_directory(more).tobytes())
        rest = rest[more] >> 8


class Codes:
    """Random access to the ids of one ``dac_bytes``."""

    def __init__(self, content: bytes | memoryview, at: int = 0) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        while True:
            n, last = (int(x) for x in np.frombuffer(content, "<u8", 2, at))
            chunks = np.frombuffer(content, np.uint8, n, at + 16)
            at += 16 + n
            if last:
                self.levels.append((chunks, None, None))
                break
            bitmap = np.frombuffer(content, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(content, "<u8", -(-n // BLOCK) + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before position ``i``."""
        block = i // BLOCK
        start = block * BLOCK // 8
        bits = np.unpackbits(bitmap[start:i // 8 + 1], bitorder="little")[:i - block * BLOCK]
        return int(ranks[block]) + int(bits.sum())

    def id_at(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(bitmap, ranks, i)
        return value

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1; touches only their own chunks."""
        out, at, shift = np.zeros(hi - lo, dtype=np.uint32), np.arange(hi - lo), 0
        for chunks, bitmap, ranks in self.levels:
            if lo >= hi:
                break
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            if bitmap is None:
                break
            bits = np.unpackbits(bitmap[lo // 8:(hi - 1) // 8 + 1], bitorder="little")[lo % 8:lo % 8 + hi - lo]
            at, shift = at[bits.astype(bool)], shift + 8
            lo, hi = self._rank(bitmap, ranks, lo), self._rank(bitmap, ranks, lo) + int(bits.sum())
        return out


def file_bytes(bucket: int, start: int, doc_ids: list[int | None], ids: list[bytes], dtype: str = "<u4") -> bytes:
    """A file: magic, bucket, position of its first id in the bucket, documents, ends, codes."""
    flat = np.frombuffer(b"".join(ids), dtype)
    sizes = np.array([len(x) // flat.itemsize for x in ids], dtype=np.int64)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = np.array([bucket, start, len(doc_ids)], dtype="<i8").tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
    return MAGIC + head + keys.tobytes() + ends + known.tobytes() + dac_bytes(flat)


class TokenFile:
    """Reads one file: ``doc_ids``, ``ends`` and ``codes``."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bucket, self.start, n = (int(x) for x in np.frombuffer(content, "<i8", 3, 8))
        keys = np.frombuffer(content, "<i8", n, 32)
        self.ends = np.frombuffer(content, "<u8", n + 1, 32 + 8 * n)
        known = np.frombuffer(content, np.uint8, n, 40 + 16 * n)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.codes = Codes(content, 40 + 17 * n)

    def document(self, i: int) -> np.ndarray:
        return self.codes.ids(int(self.ends[i]), int(self.ends[i + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, buckets: int | None = None,
                 file_ids: int = FILE_IDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents; lazy: (file, bucket, docs, tokens) of each file.

    ``buckets`` is the number of id ranges, four per shuffle partition by default: quantiles of the ids, which alone
    are read for them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    ids = docs.select(F.col(key).cast("long").alias("_id"))
    cuts = ids.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)] or [0.5], 100_000)).first()[0]
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=encoder(tokenizer).dtype).tobytes()
        for batch in batches:
            keys = column_values(batch, "doc_id")
            ranges = np.searchsorted(cuts, np.array([k if k is not None else 0 for k in keys], dtype=np.int64), "right")
            for lo in range(0, len(keys), ENCODE_ROWS):
                found = encoder(tokenizer).encode(
                    [t or "" for t in column_values(batch.slice(lo, ENCODE_ROWS), "text")])
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1 if k is None else int(r) for k, r in zip(keys[lo:lo + ENCODE_ROWS], ranges[lo:lo + ENCODE_ROWS])], pa.int32()),
                    pa.array(keys[lo:lo + ENCODE_ROWS], pa.int64()),
                    pa.array([x + end for x in found], pa.binary())], ["bucket", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, start, seq, bucket = ([], []), 0, 0, 0, None
        dtype = encoder(tokenizer).dtype

        def close() -> pa.RecordBatch:
            name = f"{bucket + 1:06d}-{seq:06d}.dac"
            write_file(folder, name, [file_bytes(bucket, start, *held, dtype)])
            return pa.RecordBatch.from_pydict({"file": [name], "bucket": pa.array([bucket], pa.int32()),
                                               "docs": [len(held[0])], "tokens": [size]})

        for batch in batches:
            for b, k, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held[0] and (b != bucket or size + len(ids) // dtype.itemsize > file_ids):
                    yield close()
                    held, start, seq, size = ([], []), start + size, seq + 1, 0
                if b != bucket:
                    bucket, start, seq = b, 0, 0
                held[0].append(k)
                held[1].append(ids)
                size += len(ids) // dtype.itemsize
        if held[0]:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return (
        rows.mapInArrow(encode, "bucket int, doc_id long, ids binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(write, "file string, bucket int, docs long, tokens long")
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, bucket, start in the bucket, ids as little-endian bytes) of every document in the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column_values(batch, "content"):
                held = TokenFile(content)
                for lo in range(0, len(held.doc_ids), 500):
                    hi = min(lo + 500, len(held.doc_ids))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(held.doc_ids[lo:hi], pa.int64()), pa.array([held.bucket] * (hi - lo), pa.int32()),
                        pa.array([held.start + int(e) for e in held.ends[lo:hi]], pa.int64()),
                        pa.array([held.document(i).astype("<u4").tobytes() for i in range(lo, hi)], pa.binary()),
                    ], ["doc_id", "bucket", "start", "ids"])
    return read_files(spark, folder, "*.dac").mapInArrow(read, "doc_id long, bucket int, start long, ids binary")


def digests(documents: DataFrame) -> DataFrame:
    """``read_documents`` with n_tokens and ids_crc32 in place of the ids."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_values(batch, "ids")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["doc_id", "bucket", "start", "n_tokens", "ids_crc32"])
    return documents.mapInArrow(digest, "doc_id long, bucket int, start long, n_tokens long, ids_crc32 long")


def with_global_start(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """``start`` counted over all buckets; there are as many sums to run through as buckets."""
    sums = manifest.groupBy(F.col("bucket").alias("_bucket")).agg(F.sum("tokens").alias("_tokens"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    return (documents.join(offsets, F.col("bucket") == F.col("_bucket"))
            .withColumn("start", F.col("start") + F.col("_before")).drop("bucket", "_bucket", "_before"))


def store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> tuple[str, DataFrame]:
    """Write all documents into a new folder: the folder and the written manifest."""
    folder = new_folder(docs.sparkSession, "tokens")
    return folder, cut(write_tokens(docs, tokenizer, folder, end_id))
