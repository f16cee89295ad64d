"""Removal of long byte strings that occur in an earlier document, with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id; all strings are judged on the input.

1. Rows whose whole text is that of a smaller id lose everything.
2. Each string of ``length`` bytes has an anchor: the 24-byte piece with the least
   hash. Equal strings have equal anchors, so only anchors of two or more
   documents matter (``shared_keys``).
3. The surroundings of such an anchor, as wide as strings around it reach, go to
   the shard of the anchor. Equal surroundings become one, with the smallest id
   they occur in. They are cut to what others of the anchor share on either
   side, which makes most of them equal; those left are joined to one text per
   anchor; its
   suffixes are sorted (``suffix_arrays``: by induction) and its permuted common prefixes give
   the runs of suffixes that start with equal strings. The smallest id of a run
   is the first document of its string.
4. Spans go back to their documents.

Texts are UTF-8 bytes; null is empty. A null id counts as greater than all
others. Rows with equal ids never remove each other's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraweave.llm import shared_keys
from terraweave.llm.common import bounded_batches
from terraweave.llm.shared_keys import _fragment as fragment_of
from terraweave.llm.store import column_values
from terraweave.llm.suffix_arrays import CELLS, permuted_prefixes, sorted_suffixes
from terraweave.llm.tokens import chunks, mix, slide
from terraweave.session import cut

LENGTH = 50
PIECE = 24  # bytes of an anchor
CHUNK = 1 << 20
BLOCK = 1 << 14  # rows of a shard that are compared at once
RANGE = 1 << 16  # surroundings and occurrences of a shard that are worked on at once
LAST = np.int64(2 ** 63 - 1)
NONE = np.uint64(2 ** 64 - 1)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the joined bytes, part indexes, keys) of the anchors of all strings of ``length`` bytes.

    Least hashes crowd at the low end of their range, which fragments of keys divide; so they are mixed once more.
    """
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    n, reach = int(sizes.sum()), length - PIECE + 1
    none = np.zeros(0, np.int64)
    if n < length or sizes.max() < length:
        return none, none, np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(parts) + bytes(length), dtype=np.uint8)
    loads = np.ndarray((n + length - 7,), dtype="<u8", buffer=data, strides=(1,))
    key = mix(mix(mix(np.full(n, 7, np.uint64), loads[:n]), loads[8:n + 8]), loads[16:n + 16]) | np.uint64(1)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes to the end of the own part
    key[left < PIECE] = NONE
    least = slide(np.concatenate([key, np.full(reach - 1, NONE)]), reach, np.minimum)
    least[left < length] = 0  # no string starts here
    greatest = slide(np.concatenate([np.zeros(reach - 1, np.uint64), least]), reach, np.maximum)
    place = np.flatnonzero((greatest == key) & (key != NONE))
    return place, np.repeat(np.arange(len(parts)), sizes)[place], mix(key[place], np.uint64(1))


def _anchor_keys(length: int):
    def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        _, owner, keys = anchors(_encoded(texts), length)
        return keys, owner
    return keys_of


def _first_documents(groups: np.ndarray, texts: np.ndarray, sizes: np.ndarray, least: np.ndarray,
                     length: int) -> np.ndarray:
    """For each surrounding and string in it, the smallest id that has the string.

    ``groups`` (sorted) says which surroundings share an anchor, ``texts`` holds their bytes (padded), ``sizes`` their
    lengths and ``least`` the smallest id of each.
    """
    strings = texts.shape[1] - length + 1
    exists = np.arange(strings) < (sizes - length + 1)[:, None]
    out = np.where(exists, least[:, None], LAST)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else groups
    counts = np.diff(np.append(starts, len(groups)))
    many = np.flatnonzero(counts > 1)
    totals = np.array([sizes[starts[g]:starts[g] + counts[g]].sum() + counts[g] for g in many], dtype=np.int64)
    many = many[np.argsort(totals, kind="stable")]
    totals = np.sort(totals)
    lo = 0
    while lo < len(many):
        hi = lo + 1
        while hi < len(many) and (hi - lo + 1) * totals[hi] <= CELLS and totals[hi] <= 1.5 * totals[lo] + 64:
            hi += 1
        width = int(totals[hi - 1])
        text = np.zeros((hi - lo, width), dtype=np.int32)
        owner = np.full((hi - lo, width), -1, dtype=np.int64)
        offset = np.zeros((hi - lo, width), dtype=np.int64)
        for r, g in enumerate(many[lo:hi]):
            at = 0
            for i in range(starts[g], starts[g] + counts[g]):
                size = int(sizes[i])
                text[r, at:at + size] = texts[i, :size].astype(np.int32) + 2
                text[r, at + size] = 1  # between surroundings
                whole = size - length + 1
                if whole > 0:
                    owner[r, at:at + whole] = i
                    offset[r, at:at + whole] = np.arange(whole)
                at += size + 1
            text[r, at - 1] = 0
        order = sorted_suffixes(text, totals[lo:hi], length)
        prefix = permuted_prefixes(text, order, length)
        row, rank = np.nonzero(order >= 0)
        place = order[row, rank]
        new = (prefix[row, place] < length) | (rank == 0)
        run = np.cumsum(new) - 1
        who, where = owner[row, place], offset[row, place]
        ids = np.where(who >= 0, least[who], LAST)
        first = np.minimum.reduceat(ids, np.flatnonzero(new))[run]
        real = who >= 0
        out[who[real], where[real]] = first[real]
        lo = hi
    return out


def _common(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each row of symbols (0: none) the longest prefix it shares with another row of its group."""
    keyed = np.concatenate([groups.astype(">u8").view(np.uint8).reshape(-1, 8),
                            rows.astype(">u2").view(np.uint8).reshape(len(rows), -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}")[:, 0], kind="stable")
    a, g = rows[order], groups[order]
    same = (a[1:] == a[:-1]) & (a[1:] != 0)
    length = np.where(g[1:] == g[:-1], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1), 0)
    best = np.maximum(np.concatenate([[0], length]), np.concatenate([length, [0]]))
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = best
    return out


def _cut_out(texts: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """texts[start:stop] of each row as symbols from 1, padded with 0; backwards if ``back``."""
    step = np.arange(width)
    out = np.zeros((len(texts), width), dtype=np.uint16)
    for k in range(0, len(texts), BLOCK):
        lo, hi = start[k:k + BLOCK, None], stop[k:k + BLOCK, None]
        at = hi - 1 - step if back else lo + step
        inside = (at >= lo) & (at < hi)
        rows = np.take_along_axis(texts[k:k + BLOCK], np.where(inside, at, 0), axis=1)
        out[k:k + BLOCK] = np.where(inside, rows.astype(np.uint16) + 1, 0)
    return out


def _trimmed_first_documents(groups: np.ndarray, texts: np.ndarray, sizes: np.ndarray, lefts: np.ndarray,
                             least: np.ndarray, length: int) -> np.ndarray:
    """``_first_documents`` over surroundings cut to what others of their anchor share on either side.

    No shared string reaches beyond; surroundings that differ only there become one.
    """
    strings = texts.shape[1] - length + 1
    out = np.where(np.arange(strings) < (sizes - length + 1)[:, None], least[:, None], LAST)
    if not len(groups):
        return out
    several = np.concatenate([groups[1:] == groups[:-1], [False]]) | np.concatenate([[False], groups[1:] == groups[:-1]])
    some = np.flatnonzero(several)
    if not len(some):
        return out
    g, t, left, size = groups[some], texts[some], lefts[some], sizes[some]
    zero = np.zeros(len(some), np.int64)
    start = left - _common(_cut_out(t, zero, left, max(int(left.max()), 1), back=True), g)
    stop = left + _common(_cut_out(t, left, size, length), g)
    wide = stop - start >= length
    some, g, t, start, stop = some[wide], g[wide], t[wide], start[wide], stop[wide]
    if not len(some):
        return out
    short = _cut_out(t, start, stop, texts.shape[1])
    new_size = stop - start
    code = new_size.astype(np.uint64)
    padded = np.zeros((len(short), -(-short.shape[1] // 4) * 4), np.uint16)
    padded[:, :short.shape[1]] = short
    for k in range(0, padded.shape[1], 4):
        code = mix(code, np.ascontiguousarray(padded[:, k:k + 4]).view("<u8")[:, 0])
    order = np.lexsort((code, g))
    new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (code[order][1:] != code[order][:-1])])
    number = np.empty(len(some), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first_of = order[new]
    smallest = np.full(len(first_of), LAST)
    np.minimum.at(smallest, number, least[some])
    found = _first_documents(g[first_of], (np.maximum(short[first_of], 1) - 1).astype(np.uint8), new_size[first_of], smallest, length)
    row, offset = np.nonzero(np.arange(strings) < (new_size - length + 1)[:, None])
    place = start[row] + offset
    out[some[row], place] = np.minimum(out[some[row], place], found[number[row], offset])
    return out


def _ranges(held: list[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The rows of a shard in ranges of anchors with about ``RANGE`` surroundings and occurrences each.

    Keys and entries of a part ascend. An anchor is never split.
    """
    every = np.sort(np.concatenate([k for part in held for k in (part[0], part[0][part[4]])]))
    starts = np.unique(every[np.arange(0, len(every), RANGE)])
    for k, low in enumerate(starts):
        out = []
        for keys, sizes, lefts, matrix, entries, uids, ranks, places in held:
            i = int(np.searchsorted(keys, low))
            j = int(np.searchsorted(keys, starts[k + 1])) if k + 1 < len(starts) else len(keys)
            if i < j:
                e, o = slice(i, j), slice(*np.searchsorted(entries, [i, j]))
                out.append((keys[e], sizes[e], lefts[e], matrix[e], entries[o] - i, uids[o], ranks[o], places[o]))
        if out:
            yield out


def _solve(held: list[tuple[np.ndarray, ...]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uids, starts, ends) of what documents lose by the anchors of one range."""
    key, size, left, texts, entry, uid, rank, lo = [], [], [], [], [], [], [], []
    base = 0
    for keys, sizes, lefts, matrix, entries, uids, ranks, places in held:
        key.append(keys), size.append(sizes), left.append(lefts), texts.append(matrix), entry.append(entries + base)
        uid.append(uids), rank.append(ranks), lo.append(places)
        base += len(keys)
    key, size, left, texts, entry, uid, rank, lo = map(np.concatenate, (key, size, left, texts, entry, uid, rank, lo))
    code = np.zeros(len(key), np.uint64) + size.astype(np.uint64) * np.uint64(128) + left.astype(np.uint64)
    for k in range(0, texts.shape[1], 8):
        code = mix(code, np.ascontiguousarray(texts[:, k:k + 8]).view("<u8")[:, 0])
    order = np.lexsort((code, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (code[order][1:] != code[order][:-1])])
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    kind = number[entry]  # of each occurrence: its distinct surrounding
    least = np.full(int(new.sum()), LAST)
    np.minimum.at(least, kind, rank)
    pick = order[new]
    first = _trimmed_first_documents(key[pick], texts[pick], size[pick].astype(np.int64), left[pick].astype(np.int64), least, length)
    found = []
    for k in range(0, len(kind), BLOCK):
        gone = first[kind[k:k + BLOCK]] < rank[k:k + BLOCK, None]
        edge = np.diff(gone.astype(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
        r, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        found.append((uid[k + r], lo[k + r] + a, lo[k + r] + b - 1 + length))
    return tuple(map(np.concatenate, zip(*found)))


def find_spans(rows: DataFrame, lists: DataFrame, fragments: int, length: int) -> DataFrame:
    """(uid, spans): packed (start, end) pairs of bytes that documents lose; several rows per document.

    ``rows``: uid, rank, text; ``lists``: uid and its packed ``codes``.
    """
    reach = length - PIECE  # a string starts at most so far before its anchor
    wide = -(-(length + reach) // 8) * 8

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=CHUNK):
            parts = _encoded(column_values(batch, "text"))
            place, owner, keys = anchors(parts, length)
            uids, ranks = (np.array(column_values(batch, c), dtype=np.int64) for c in ("uid", "rank"))
            code = shared_keys.codes(keys, fragments)
            wanted = np.zeros(len(keys), dtype=bool)
            bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
            for i, packed in enumerate(column_values(batch, "codes")):
                own = slice(bounds[i], bounds[i + 1])
                wanted[own] = np.isin(code[own], np.frombuffer(packed, "<u8"))
            place, owner, keys = place[wanted], owner[wanted], keys[wanted]
            if not len(place):
                continue
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - np.array([len(p) for p in parts])
            lo = np.maximum(starts[owner], place - reach)
            size = np.minimum(ends[owner], place + length) - lo
            data = np.frombuffer(b"".join(parts) + bytes(wide), dtype=np.uint8)
            texts = np.lib.stride_tricks.sliding_window_view(data, wide)[lo].copy()
            texts[np.arange(wide) >= size[:, None]] = 0
            # equal surroundings of this slice are sent once
            left = place - lo
            same = size.astype(np.uint64) * np.uint64(128) + left.astype(np.uint64)
            for k in range(0, wide, 8):
                same = mix(same, np.ascontiguousarray(texts[:, k:k + 8]).view("<u8")[:, 0])
            order = np.lexsort((same, keys))
            new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (same[order][1:] != same[order][:-1])])
            entry = np.cumsum(new) - 1
            pick = order[new]
            frag = fragment_of(keys[pick], fragments)
            cuts = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
            o_cuts = np.searchsorted(entry, cuts)
            s_owner, s_lo = owner[order], (lo - starts[owner])[order]
            out = []
            for f in np.flatnonzero(np.diff(cuts)):
                e, o = slice(cuts[f], cuts[f + 1]), slice(o_cuts[f], o_cuts[f + 1])
                out.append((int(f), keys[pick[e]].astype("<u8").tobytes(), size[pick[e]].astype("<i4").tobytes(),
                            left[pick[e]].astype("<i4").tobytes(), texts[pick[e]].tobytes(), (entry[o] - cuts[f]).astype("<i4").tobytes(),
                            uids[s_owner[o]].tobytes(), ranks[s_owner[o]].tobytes(), s_lo[o].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(map(list, zip(*out)))],
                ["frag", "keys", "sizes", "lefts", "texts", "entries", "uids", "ranks", "places"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            for part in _ranges(held):
                uid, start, end = _solve(part, length)
                order = np.argsort(uid, kind="stable")
                uid, pairs = uid[order], np.stack([start[order], end[order]], axis=1).astype("<i8")
                cuts = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else uid
                stops = [*cuts[1:].tolist(), len(uid)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[cuts], pa.int64()),
                    pa.array([pairs[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), stops)], pa.binary())], ["uid", "spans"])

        held, current = [], None
        for batch in batches:
            for f, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if f != current and held:
                    yield from close()
                    held = []
                current = f
                kinds = ("<u8", "<i4", "<i4", np.uint8, "<i4", "<i8", "<i8", "<i8")
                arrays = [np.frombuffer(x, k) for x, k in zip(packed, kinds)]
                arrays[3] = arrays[3].reshape(-1, wide)
                held.append(tuple(arrays))
        if held:
            yield from close()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(lists, "uid").mapInArrow(
            surround, "frag int, keys binary, sizes binary, lefts binary, texts binary, entries binary, uids binary, ranks binary, "
                      "places binary")
        .repartition(max(parts, fragments), "frag").sortWithinPartitions("frag")
        .mapInArrow(solve, "uid long, spans binary")
    )


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text, later, spans) per row of ``docs``: ``later`` if a smaller id has the whole text, else packed spans."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text")).withColumn(
        "rank", F.coalesce("doc_id", F.lit(int(LAST))))
    digest = rows.select("uid", "rank", F.md5("text").alias("digest")).distinct()
    least = digest.groupBy("digest").agg(F.min("rank").alias("_least"))
    later = cut(digest.join(least, "digest").where("rank > _least").select("uid"))
    fragments = shared_keys.fragments_for(rows, "text", 14.0)
    lists = shared_keys.shared_lists(rows, _anchor_keys(length), fragments, size=CHUNK)
    with bounded_batches(docs.sparkSession):
        wanted = cut(lists).join(later, "uid", "left_anti")
        spans = cut(find_spans(rows, wanted, fragments, length))
    own = spans.groupBy("uid").agg(F.collect_list("spans").alias("spans"))
    flags = later.withColumn("_later", F.lit(True)).join(own, "uid", "full")
    return rows.join(flags, "uid", "left").select(
        "doc_id", "text", F.coalesce("_later", F.lit(False)).alias("later"), "spans")


def remove(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``mark``: ``kept`` are the remaining bytes."""
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=CHUNK):
            out = []
            for doc_id, raw, later, packed in zip(column_values(batch, "doc_id"), _encoded(column_values(batch, "text")),
                                                  column_values(batch, "later"), column_values(batch, "spans")):
                if later and len(raw) >= length:
                    out.append((doc_id, len(raw), len(raw), 1, b""))
                elif not packed:
                    out.append((doc_id, len(raw), 0, 0, raw))
                else:
                    pairs = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)
                    depth = np.bincount(pairs[:, 0], minlength=len(raw) + 1) - np.bincount(pairs[:, 1], minlength=len(raw) + 1)
                    gone = np.cumsum(depth)[:len(raw)] > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((doc_id, len(raw), int(gone.sum()), n_spans, kept))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return marked.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
