"""Words and shingles of many texts at once, as 64-bit keys in numpy arrays.

Equal words have equal keys. Different words share a key with a chance of about
2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20  # text handled at once inside a task

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP_OR_MARK = _GAP.copy()
_GAP_OR_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Key of a sequence made longer by one value."""
    out = (key ^ (value * _K1)) * _K2
    out ^= out >> np.uint64(32)
    out *= _K1
    return out ^ (out >> np.uint64(29))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values, span = pick(values[:-span], values[span:]), 2 * span
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together have about ``size`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(np.nan_to_num(lengths.to_numpy(zero_copy_only=False).astype(float)))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, min(int(np.searchsorted(ends, base + size)), lo + 60_000))
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(texts: list[str | None], lower: bool = True, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words in order, bounds): words of text i are keys[bounds[i]:bounds[i + 1]].

    Words are runs without white space, and without ASCII punctuation unless ``marks``; A-Z count as a-z if ``lower``.
    """
    keys, bounds, _, _ = spans(texts, lower, marks)
    return keys, bounds


def spans(texts: list[str | None], lower: bool = True, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words`` with the places of the words: (keys, bounds, starts, ends) in bytes of the joined, newline-ended texts."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), dtype=np.uint8)
    data = _LOWER[raw] if lower else raw
    gap = (_GAP if marks else _GAP_OR_MARK)[data[:-8]]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    loads = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    keys = np.full(len(starts), 0x1234567, dtype=np.uint64) ^ sizes.astype(np.uint64)
    live, at, left = np.arange(len(starts)), starts, sizes
    while len(live):
        piece = loads[at] & _MASKS[np.minimum(left, 8)]
        keys[live] = mix(keys[live], piece)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    text_ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return keys, bounds, starts, ends


def ngrams(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that start at each position, len(keys) - n + 1 of them, across text bounds."""
    count = max(len(keys) - n + 1, 0)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out, keys[k:k + count])
    return out


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text indexes) of all n-word shingles; a shorter text with a word has one, the whole sequence."""
    keys, bounds = words(texts)
    counts = np.diff(bounds)
    grams = ngrams(keys, n)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = (np.repeat(bounds[1:], counts)[:len(grams)] - np.arange(len(grams))) >= n
    out, own = grams[whole], owner[:len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = [ngrams(keys[bounds[i]:bounds[i + 1]], int(counts[i]))[0] for i in short]
        out, own = np.concatenate([out, np.array(extra, dtype=np.uint64)]), np.concatenate([own, short])
    return out, own


def distinct_by_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, text) pairs, sorted by key and then by text."""
    by_text = np.argsort(owner, kind="stable")
    order = by_text[np.argsort(keys[by_text], kind="stable")]
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return keys, owner
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    return keys[new], owner[new]
