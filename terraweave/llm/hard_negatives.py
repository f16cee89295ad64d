"""Hard negatives for anchors, scored exactly by the method of Four Russians.

A row takes part if its label and its vector are not null and all components are
finite numbers. A component x counts as floor(``scale`` * x), an integer; a score
is the inner product of two rows in 64-bit integers. Vectors of unequal length
are compared as if the shorter one ended in zeros.

1. Rows are packed into blocks of at most ``BLOCK`` (``pack``): ids, labels, and the
   bit planes of the components, eight dimensions to a byte; the highest plane
   holds signs and counts negative.
2. Anchors are dealt to blocks of about ``ANCHORS``, and every block of candidates
   is sent to every block of anchors, in cells of at most ``CELL`` candidates: a
   cell is bounded in both, whatever the labels are.
3. A cell computes for each group of eight dimensions all 256 subset sums of its
   anchors. The byte of a candidate's plane looks up its sum; planes are added
   shifted. That gives the full exact scores of a cell (``scores``).
4. First pass: the best ``positives`` rows of an anchor's label in each cell, then
   of all cells. Second pass: the best rows of other labels within each positive's
   bounds in each cell, then of all cells.

Higher scores come first, ties by smaller id, null ids last, which are
never anchors. A row with an anchor's id is never its positive. Repeated rows count each; an anchor that is
repeated gives its rows as often. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terraweave.llm.store import column_values
from terraweave.session import cut

BLOCK = 4096  # candidates of a block
ANCHORS = 1024  # anchors of a block, on average
CELL = 1 << 14  # candidates of a cell, on average
TILE = 128  # anchors scored at once
WIDE = 2048  # candidates scored at once
PACKED = "uid long, n int, groups int, planes int, ids binary, nulls binary, labels binary, bits binary"


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    kept = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), held within 64 bits."""
    return np.clip(np.floor(values * scale), -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)


def matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """Integer components, rows padded with zeros to a whole number of groups of eight."""
    sizes = np.array([len(v) for v in vectors], dtype=np.int64)
    flat = integers(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    groups = max(1, -(-int(sizes.max(initial=0)) // 8))
    out = np.zeros((len(sizes), 8 * groups), dtype=np.int64)
    out[np.arange(8 * groups) < sizes[:, None]] = flat
    return out


def bit_planes(values: np.ndarray) -> np.ndarray:
    """bytes[plane, group, row]: bit j is bit ``plane`` of component 8 * group + j in two's complement."""
    most = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
    planes = most.bit_length() + 1
    n, dims = values.shape
    out = np.empty((planes, dims // 8, n), dtype=np.uint8)
    for b in range(planes):
        out[b] = np.packbits(((values >> min(b, 63)) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def pack(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of ``usable`` rows, those of one block ordered by label."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids, labels = column_values(part, "id"), np.array(column_values(part, "label"), dtype="<i8")
                order = np.argsort(labels, kind="stable")
                planes = bit_planes(matrix(part.column(part.schema.get_field_index("vec")), scale)[order])
                numbers = np.array([i or 0 for i in ids], dtype="<i8")[order]
                nulls = np.array([i is None for i in ids], dtype=np.uint8)[order]
                values = (0, len(ids), planes.shape[1], planes.shape[0], numbers.tobytes(), nulls.tobytes(), labels[order].tobytes(),
                          planes.tobytes())
                kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)],
                                                 ["uid", "n", "groups", "planes", "ids", "nulls", "labels", "bits"])

    return rows.mapInArrow(blocks, PACKED).withColumn("uid", F.monotonically_increasing_id())


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """sums[group, byte, anchor]: sum of the anchor's components of the group whose bit is set in the byte.

    In the narrowest integers that hold every sum of an anchor's components.
    """
    reach = int(np.abs(anchors.astype(object)).sum(axis=1).max()) if anchors.size else 0
    kind = np.int16 if reach < 2 ** 15 else np.int32 if reach < 2 ** 31 else np.int64
    n, dims = anchors.shape
    out = np.zeros((dims // 8, 256, n), dtype=kind)
    for g in range(dims // 8):
        for j in range(8):
            step = 1 << j
            out[g, step:2 * step] = out[g, :step] + anchors[:, 8 * g + j].astype(kind)
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact scores [candidate, anchor] from subset sums and candidates' bit planes."""
    n_planes, groups, n = planes.shape
    out = np.zeros((n, sums.shape[2]), dtype=np.int32 if n_planes <= 16 and sums.dtype == np.int16 else np.int64)
    held, looked = np.empty((n, sums.shape[2]), sums.dtype), np.empty((n, sums.shape[2]), sums.dtype)
    for b in range(n_planes):
        held[:] = 0
        for g in range(min(groups, sums.shape[0])):
            np.take(sums[g], planes[b, g], axis=0, out=looked, mode="clip")
            held += looked
        part = held.astype(out.dtype) << out.dtype.type(min(b, 63))
        out = out - part if b == n_planes - 1 else out + part
    return out


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], row["groups"], row["n"])
    return (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8), np.frombuffer(row["labels"], "<i8"), planes)


def _best(group: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the first ``top`` of each group: higher score, ids that are not null, smaller id."""
    order = np.lexsort((ids, null, ~score, group))  # ~score turns the order round without overflow
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < top]


class _Kept:
    """The best rows so far of each group, and the score a full group asks for."""

    def __init__(self, groups: int, top: int) -> None:
        self.top, self.rows = top, [np.zeros(0, np.int64) for _ in range(4)]
        self.floor = np.full(groups, np.iinfo(np.int64).min)

    def add(self, *found: np.ndarray) -> None:
        if not len(found[0]):
            return
        group, score, null, ids = (np.concatenate([a, b]) for a, b in zip(self.rows, found))
        pick = _best(group, score, null, ids, self.top)
        self.rows = [c[pick] for c in (group, score, null, ids)]
        group, score = self.rows[:2]
        counts = np.bincount(group, minlength=len(self.floor))
        last = np.cumsum(counts) - 1
        full = counts == self.top
        self.floor[full] = score[last[full]]


def _cells(blocks: DataFrame, anchors: DataFrame, rows: int, n_anchors: int, work, schema: str) -> DataFrame:
    """``work(anchors, blocks)`` per cell; ``anchors`` has a row per anchor with its ``uid``."""
    n_blocks = -(-n_anchors // ANCHORS)
    n_cells = -(-rows // CELL)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int")).withColumn("_c", every(n_cells))
    right = blocks.withColumn("_c", F.pmod(F.xxhash64("uid"), F.lit(n_cells)).cast("int")).withColumn("_a", every(n_blocks))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], schema=work.schema)
        return work(a, (_open(x) for batch in b.to_batches(max_chunksize=1) for x in batch.to_pylist()))

    return left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInArrow(run, schema)


class _Positives:
    """Best rows of an anchor's own label."""

    schema = pa.schema([("uid", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def __init__(self, scale: float, top: int) -> None:
        self.scale, self.top = scale, top

    def __call__(self, a: pa.Table, blocks: Iterator[tuple]) -> pa.Table:
        labels = a["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        labels, ids, uid = labels[order], a["id"].to_numpy()[order], a["uid"].to_numpy()[order]
        values = matrix(a["vec"].combine_chunks(), self.scale)[order]
        kept = _Kept(len(uid), self.top)
        for c_ids, c_nulls, c_labels, planes in blocks:
            for label in np.intersect1d(labels, c_labels):
                lo, hi = np.searchsorted(labels, [label, label + 1])
                c_lo, c_hi = np.searchsorted(c_labels, [label, label + 1])
                for k in range(lo, hi, TILE):
                    tile = slice(k, min(k + TILE, hi))
                    sums = subset_sums(values[tile])
                    for w in range(c_lo, c_hi, WIDE):
                        part = slice(w, min(w + WIDE, c_hi))
                        got = scores(sums, planes[:, :, part])
                        fine = (got >= kept.floor[tile]) & ((c_ids[part, None] != ids[tile]) | (c_nulls[part, None] > 0))
                        c, i = np.nonzero(fine)
                        kept.add(i + k, got[c, i].astype(np.int64), c_nulls[part][c].astype(np.int64), c_ids[part][c])
        group, score, null, found = kept.rows
        return pa.Table.from_arrays([pa.array(uid[group]), pa.array(score), pa.array(found, mask=null > 0)], schema=self.schema)


class _Negatives:
    """Best rows of other labels within the bounds of each positive."""

    schema = pa.schema([("uid", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def __init__(self, scale: float, top: int, low: int, high: int) -> None:
        self.scale, self.top, self.low, self.high = scale, top, low, high

    def __call__(self, a: pa.Table, blocks: Iterator[tuple]) -> pa.Table:
        labels, uid = a["label"].to_numpy(), a["uid"].to_numpy()
        values = matrix(a["vec"].combine_chunks(), self.scale)
        bounds = a["positives"].to_pylist()
        n_pos = max(map(len, bounds))
        low, high = np.full((n_pos, len(uid)), 1), np.full((n_pos, len(uid)), 0)  # nothing is within these
        for i, own in enumerate(bounds):
            for p in own:  # 100 * s between low * p and high * p, in exact integers
                k = p["positive"]
                low[k, i], high[k, i] = -(-self.low * p["score"] // 100), self.high * p["score"] // 100
        kept = _Kept(len(uid) * n_pos, self.top)
        tiles = [(k, subset_sums(values[k:k + TILE])) for k in range(0, len(uid), TILE)]
        for c_ids, c_nulls, c_labels, planes in blocks:
            for k, sums in tiles:
                tile = slice(k, k + sums.shape[2])
                for w in range(0, len(c_ids), WIDE):
                    part = slice(w, w + WIDE)
                    got = scores(sums, planes[:, :, part])
                    other = c_labels[part, None] != labels[tile]
                    for p in range(n_pos):
                        floor = np.maximum(low[p, tile], kept.floor[p * len(uid) + k:p * len(uid) + tile.stop])
                        c, i = np.nonzero((got >= floor) & (got <= high[p, tile]) & other)
                        kept.add(p * len(uid) + i + k, got[c, i].astype(np.int64), c_nulls[part][c].astype(np.int64), c_ids[part][c])
        group, score, null, found = kept.rows
        return pa.Table.from_arrays([pa.array(uid[group % len(uid)]), pa.array((group // len(uid)).astype(np.int32)), pa.array(score),
                                     pa.array(found, mask=null > 0)], schema=self.schema)


def _first(found: DataFrame, by: list[str], top: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= top)


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors. A negative's score lies between ``low`` and ``high`` percent of the
    positive's; both are whole numbers.
    """
    label = F.col("label") if label is None else label
    taking_part = usable(rows, key, vector, label)
    blocks = cut(pack(taking_part, scale))
    chosen = cut(usable(rows.where(anchors & F.col(key).isNotNull()), key, vector, label).withColumn("uid", F.monotonically_increasing_id()))
    n_rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_anchors = chosen.count()
    if not n_anchors:
        n_rows, n_anchors = 1, 1  # one empty cell
    close = _Positives(scale, positives)
    near = cut(_first(_cells(blocks, chosen, n_rows, n_anchors, close, "uid long, score long, id long"), ["uid"], positives, "nth"))
    own = near.groupBy("uid").agg(F.collect_list(F.struct((F.col("nth") - 1).alias("positive"), "score")).alias("positives"))
    far = _Negatives(scale, negatives, low, high)
    ready = cut(chosen.join(own, "uid"))
    found = _cells(blocks, ready, n_rows, n_anchors, far, "uid long, positive int, score long, id long")
    ranked = _first(found, ["uid", "positive"], negatives, "rank").select(
        "uid", (F.col("positive") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("uid", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["uid", "nth"]).join(chosen.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
