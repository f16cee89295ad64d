"""Which documents share keys: a filter before joins over shingles.

Every document has a set of 64-bit keys. Tasks send their keys in packed arrays
to fragments of the key range, a key only once per array; each fragment finds the
keys of two or more documents. A fragment holds a bounded number of keys on
average: there are as many fragments as the texts need. Inside a fragment 32 bits
of a key are compared, which lets through about one key in a thousand too many
and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraweave.llm.tokens import CHUNK_BYTES, chunks, distinct_by_text

FRAGMENT_KEYS = 4 << 20
ROW = "frag int, docs binary, keys binary, owner binary"
NOBODY = np.uint32(2 ** 32 - 1)  # has the keys of several documents that know of it already
PACKED = ["bucket", "uids", "rows", "n_keys", "n_shared"]

# texts -> (keys, text indexes)
Keys = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]


def fragments_for(docs: DataFrame, text: str, bytes_per_key: float) -> int:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(parts, int(total / bytes_per_key / FRAGMENT_KEYS) + 1)


def _packed(frag: list[int], docs: list[bytes], keys: list[bytes], owner: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(frag, pa.int32()), *(pa.array(x, pa.binary()) for x in (docs, keys, owner))],
        ["frag", "docs", "keys", "owner"])


def _fragment(keys: np.ndarray, fragments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _by_bucket(ids: np.ndarray, values: tuple[np.ndarray, ...], buckets: int, names: list[str]) -> pa.RecordBatch:
    """(bucket, ids, values): a row for each bucket of ids, with the numbers of its ids in packed arrays."""
    bucket = (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed = []
    for v in (ids, *values):
        v = v[order].astype("<i8" if v.dtype.kind == "i" else "<u8")
        packed.append(pa.array([v[cuts[b]:cuts[b + 1]].tobytes() for b in used], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], names)


def _shared(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all documents, index of the document, key) of the keys that several rows of a fragment have, by key.

    A key and its document are one number that is sorted in place, so a fragment takes about 8 bytes a key on top of
    what it was sent.
    """
    sizes = [len(keys) for _, keys, _ in held]
    both = np.empty((sum(sizes), 2), dtype="<u4")
    ids, at, base = np.concatenate([table for table, _, _ in held]), 0, 0
    for (table, keys, owner), n in zip(held, sizes):
        both[at:at + n, 1] = keys
        both[at:at + n, 0] = np.where(owner == 65535, NOBODY, owner + np.uint32(base))
        at, base = at + n, base + len(table)
    both.view("<u8")[:, 0].sort()
    doc, low = both[:, 0], both[:, 1]
    same = low[1:] == low[:-1]
    several = np.zeros(len(low), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    several &= doc != NOBODY
    return ids, doc[several], low[several]


def count_shared(docs: DataFrame, keys_of: Keys, fragments: int, uid: str = "uid", text: str = "text") -> DataFrame:
    """(uid, rows, n_keys, n_shared) of every document: its rows, distinct keys, and those (nearly) of other rows, too."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            ids = batch.column(batch.schema.get_field_index(uid)).to_numpy(zero_copy_only=False).astype("<i8")
            keys, owner = distinct_by_text(*keys_of(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            n = np.bincount(owner, minlength=len(ids)).astype("<i4")
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            many = (np.bincount(group) > 1) if len(keys) else np.zeros(0, bool)
            local = many[group] if len(keys) else many
            shared = np.bincount(owner[local], minlength=len(ids)).astype("<i4")
            # one of many is sent under the index 65535: the others know already
            sent, own = keys[first], np.where(local[first], 65535, owner[first]).astype("<u2")
            frag = _fragment(sent, fragments)
            cuts = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            low = (sent & np.uint64(0xFFFFFFFF)).astype("<u4")
            table = ids.tobytes()
            rows = [(int(f), table, low[cuts[f]:cuts[f + 1]].tobytes(), own[cuts[f]:cuts[f + 1]].tobytes()) for f in used]
            rows.append((-1 - int(ids[0]) % fragments, table, n.tobytes(), shared.tobytes()))
            yield _packed(*map(list, zip(*rows)))

    def dealt(ids: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        """Rows of numbers per document, packed by the bucket that adds them up."""
        return _by_bucket(ids, values, fragments, PACKED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, doc, _ = _shared(held)
            n = np.bincount(doc, minlength=len(ids))
            found, which = np.unique(ids[n > 0], return_inverse=True)
            counts = np.bincount(which, weights=n[n > 0], minlength=len(found)).astype(np.int64)
            zero = np.zeros(len(found), np.int64)
            return dealt(found, zero, zero, counts)

        held, current = [], None
        for batch in batches:
            for f, d, k, o in zip(*(c.to_pylist() for c in batch.columns)):
                table = np.frombuffer(d, "<i8")
                if f < 0:
                    yield dealt(table, np.ones(len(table), np.int64), np.frombuffer(k, "<i4"), np.frombuffer(o, "<i4"))
                    continue
                if f != current and held:
                    yield solve(held)
                    held = []
                current = f
                held.append((table, np.frombuffer(k, "<u4"), np.frombuffer(o, "<u2")))
        if held:
            yield solve(held)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            ids, rows, n, shared = map(np.concatenate, zip(*held))
            uids, doc = np.unique(ids, return_inverse=True)
            most = np.zeros(len(uids), np.int64)
            np.maximum.at(most, doc, n)
            sums = [np.bincount(doc, weights=v).astype(np.int64) for v in (rows, shared)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (uids, sums[0], most, sums[1])],
                                              ["uid", "rows", "n_keys", "n_shared"])

        held, current = [], None
        for batch in batches:
            for b, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current and held:
                    yield close()
                    held = []
                current = b
                held.append(tuple(np.frombuffer(x, "<i8") for x in packed))
        if held:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, fragments)
    return (
        docs.select(uid, text).mapInArrow(send, ROW)
        .repartition(tasks, "frag").sortWithinPartitions("frag")
        .mapInArrow(meet, "bucket int, uids binary, rows binary, n_keys binary, n_shared binary")
        .repartition(tasks, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(add_up, "uid long, rows long, n_keys long, n_shared long")
    )


def codes(keys: np.ndarray, fragments: int) -> np.ndarray:
    """What ``shared_lists`` lists for a key: its fragment and the 32 bits compared there."""
    return (_fragment(keys, fragments) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def shared_lists(docs: DataFrame, keys_of: Keys, fragments: int, uid: str = "uid", text: str = "text",
                 size: int = CHUNK_BYTES) -> DataFrame:
    """(uid, codes): packed codes of those keys of a document that (nearly) surely other rows have, too; one row each.

    Fragments send what they found packed by buckets of documents, not a row for each document: their number grows with
    the texts, too.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, size):
            ids = batch.column(batch.schema.get_field_index(uid)).to_numpy(zero_copy_only=False).astype("<i8")
            keys, owner = distinct_by_text(*keys_of(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            if not len(keys):
                continue
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = np.cumsum(first) - 1
            local = (np.bincount(group) > 1)[group]
            sent, own = keys[first], np.where(local[first], 65535, owner[first]).astype("<u2")
            frag = _fragment(sent, fragments)
            cuts = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
            low, table = (sent & np.uint64(0xFFFFFFFF)).astype("<u4"), ids.tobytes()
            rows = [(int(f), table, low[cuts[f]:cuts[f + 1]].tobytes(), own[cuts[f]:cuts[f + 1]].tobytes())
                    for f in np.flatnonzero(np.diff(cuts))]
            if local.any():  # known already: by document
                by_doc = np.argsort(owner[local], kind="stable")
                rows.append((-1 - int(ids[0]) % fragments, table, codes(keys[local][by_doc], fragments).astype("<u8").tobytes(),
                             owner[local][by_doc].astype("<u2").tobytes()))
            yield _packed(*map(list, zip(*rows)))

    def listed(ids: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        return _by_bucket(ids, (found,), fragments, ["bucket", "uids", "codes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(frag: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            table, doc, low = _shared(held)
            return listed(table[doc], low.astype(np.uint64) | (np.uint64(frag) << np.uint64(32)))

        held, current = [], None
        for batch in batches:
            for f, d, k, o in zip(*(c.to_pylist() for c in batch.columns)):
                table = np.frombuffer(d, "<i8")
                if f < 0:
                    yield listed(table[np.frombuffer(o, "<u2")], np.frombuffer(k, "<u8"))
                    continue
                if f != current and held:
                    yield solve(current, held)
                    held = []
                current = f
                held.append((table, np.frombuffer(k, "<u4"), np.frombuffer(o, "<u2")))
        if held:
            yield solve(current, held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            ids, found = map(np.concatenate, zip(*held))
            order = np.argsort(ids, kind="stable")
            ids, raw = ids[order], found[order].tobytes()
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ends = [*cuts[1:].tolist(), len(ids)]
            return pa.RecordBatch.from_arrays([
                pa.array(ids[cuts], pa.int64()),
                pa.array([raw[8 * lo:8 * hi] for lo, hi in zip(cuts.tolist(), ends)], pa.binary())], ["uid", "codes"])

        held, current = [], None
        for batch in batches:
            for b, d, k in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current and held:
                    yield close()
                    held = []
                current = b
                held.append((np.frombuffer(d, "<i8"), np.frombuffer(k, "<u8")))
        if held:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.select(uid, text).mapInArrow(send, ROW)
        .repartition(max(parts, fragments), "frag").sortWithinPartitions("frag")
        .mapInArrow(meet, "bucket int, uids binary, codes binary")
        .repartition(max(parts, fragments), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(gather, "uid long, codes binary")
    )
