"""Suffix arrays of many short strings by induced sorting, all strings in step.

The scans of induced sorting are sequential in one string; here position i of all
strings of a batch is handled by one numpy operation, so the cost per character
stays linear and small.
"""

from __future__ import annotations

import numpy as np

CELLS = 1 << 18  # characters of one batch
WIDE = 1 << 10  # longer strings leave too few rows for scans in step


def _place(cols: np.ndarray, group: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    """Put ``cols`` at the ends of their buckets, keeping their order; ``group`` is the bucket of each."""
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    first = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(sorted_group)))
    rank = np.arange(len(sorted_group)) - np.repeat(starts, sizes)
    out[ends[sorted_group] - np.repeat(sizes, sizes) + rank] = cols[by_group]


def _induce(sa: np.ndarray, text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, ends: np.ndarray,
            rows: int, width: int, letters: int) -> None:
    """Larger suffixes left to right, then smaller ones right to left, from what ``sa`` holds."""
    base = np.arange(rows) * width
    bucket_base = np.arange(rows) * letters
    for left, borders in ((True, heads.copy()), (False, ends.copy())):
        for i in range(width) if left else range(width - 1, -1, -1):
            j = sa[base + i] - 1
            live = np.flatnonzero(j >= 0)
            if not len(live):
                continue
            at = base[live] + j[live]
            wanted = smaller[at] != left
            live, at = live[wanted], at[wanted]
            bucket = bucket_base[live] + text[at]
            if left:
                sa[borders[bucket]] = at - base[live]
                borders[bucket] += 1
            else:
                borders[bucket] -= 1
                sa[borders[bucket]] = at - base[live]


def batch_suffix_arrays(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of the rows of ``text``; row r has sizes[r] symbols, the last a 0 that occurs nowhere else in it.

    Entries behind a row's size are -1.
    """
    rows, width = text.shape
    letters = int(text.max()) + 1
    place = np.arange(width)
    inside = place < sizes[:, None]
    step = np.zeros((rows, width), dtype=np.int8)
    step[:, :-1] = np.sign(text[:, 1:].astype(np.int64) - text[:, :-1])
    step[np.arange(rows), sizes - 1] = 1  # the end counts as smaller than what follows
    step[~inside] = -1
    following = np.minimum.accumulate(np.where(step != 0, place, width - 1)[:, ::-1], axis=1)[:, ::-1]
    smaller = np.take_along_axis(step, following, axis=1) > 0
    leftmost = np.zeros_like(smaller)
    leftmost[:, 1:] = smaller[:, 1:] & ~smaller[:, :-1]
    leftmost &= inside
    leftmost[:, 0] = sizes == 1

    flat, flat_smaller = text.ravel().astype(np.int64), smaller.ravel()
    buckets = (np.arange(rows)[:, None] * letters + text)[inside]
    counts = np.bincount(buckets, minlength=rows * letters).reshape(rows, letters)
    ends = (np.cumsum(counts, axis=1) + np.arange(rows)[:, None] * width).ravel()
    heads = ends - counts.ravel()

    def sort_from(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        sa = np.full(rows * width, -1, dtype=np.int64)
        _place(col, row * letters + text[row, col], ends, sa)
        _induce(sa, flat, flat_smaller, heads, ends, rows, width, letters)
        return sa.reshape(rows, width)

    row, col = np.nonzero(leftmost)
    sa = sort_from(row, col)
    # names of leftmost-smaller substrings, in their sorted order
    s_row, s_at = np.nonzero((sa >= 0) & np.take_along_axis(leftmost, np.maximum(sa, 0), axis=1))
    s_col = sa[s_row, s_at]
    ordinal = np.cumsum(leftmost, axis=1) - 1  # of a leftmost-smaller position in its row
    many = leftmost.sum(axis=1)
    next_of = np.full((rows, width), -1, dtype=np.int64)
    same_row = row[1:] == row[:-1]
    next_of[row[:-1][same_row], col[:-1][same_row]] = col[1:][same_row]
    length = np.maximum(next_of[s_row, s_col] - s_col, 0)  # 0 for the end of a row
    equal = np.zeros(len(s_row), dtype=bool)
    equal[1:] = (s_row[1:] == s_row[:-1]) & (length[1:] == length[:-1]) & (length[1:] > 0)
    live, k = np.flatnonzero(equal), 0
    while len(live):
        here = text[s_row[live], s_col[live] + k] == text[s_row[live - 1], s_col[live - 1] + k]
        equal[live[~here]] = False
        live, k = live[here], k + 1
        live = live[length[live] >= k]
    new = ~equal
    total = np.cumsum(new)
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    name = total - total[first][s_row]
    reduced = np.zeros((rows, int(many.max())), dtype=np.int64)
    reduced[s_row, ordinal[s_row, s_col]] = name
    if equal.any():
        order = batch_suffix_arrays(reduced, many)
    else:
        order = np.full(reduced.shape, -1, dtype=np.int64)
        order[s_row, name] = ordinal[s_row, s_col]
    starts = np.zeros(reduced.shape, dtype=np.int64)
    starts[row, ordinal[row, col]] = col
    o_row, o_at = np.nonzero(order >= 0)
    return sort_from(o_row, starts[o_row, order[o_row, o_at]])


def _doubled(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling."""
    rank, span = text.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        span *= 2
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if span >= depth or span >= len(text):
            return order


def sorted_suffixes(text: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix orders of the rows, right for the first ``depth`` symbols: what runs of common prefixes need.

    Short strings are sorted by induction, all in step. Of strings beyond ``WIDE`` a batch holds few rows, whose scans
    would cost an operation per symbol; they are sorted by doubling.
    """
    if text.shape[1] <= WIDE:
        return batch_suffix_arrays(text, sizes)
    out = np.full(text.shape, -1, dtype=np.int64)
    for r, size in enumerate(sizes):
        out[r, :size] = _doubled(text[r, :size], depth)
    return out


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the common prefix (``cap`` at most) with the suffix before it in order; 0 for the first."""
    rows, width = text.shape
    before = np.full((rows, width), -1, dtype=np.int64)
    r, c = np.nonzero(sa[:, 1:] >= 0)
    before[r, sa[r, c + 1]] = sa[r, c]
    padded = np.concatenate([text, np.zeros((rows, cap), text.dtype)], axis=1)
    out = np.zeros((rows, width), dtype=np.int32)
    live_r, live_c = np.nonzero(before >= 0)
    other, k = before[live_r, live_c], 0
    while len(live_r) and k < cap:
        same = padded[live_r, live_c + k] == padded[live_r, other + k]
        live_r, live_c, other = live_r[same], live_c[same], other[same]
        k += 1
        out[live_r, live_c] = k
    return out
