"""Benchmark passages in training documents, exact or edited.

1. All documents are searched for the word n-grams of all items. Every n-gram that
   occurs is a seed, however common: an n-gram that copies share may be the only
   one that an edited copy has left.
2. A seed hit says where in the document the item would start; places are put in
   buckets of the item's length.
3. Around each bucket the words are aligned with the item by Smith-Waterman
   (match +2, other word -1, gap -1), wide enough for every alignment through a
   seed that can reach ``min_score``. The score is divided by that of the item
   with itself; from ``min_score`` on the document counts as contaminated. Pairs
   that share too few words to get there are not aligned.

Words are lower-cased runs without white space or ASCII punctuation. Items
of fewer than n words or without an id match nothing; null and empty texts match
nothing. Rows
that share an id are judged together: the best score of each (id, item) counts.
Items that share an id are searched each by its own text.
The n-grams of the items are handed to tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terraweave.llm.store import column_values
from terraweave.llm.tokens import chunks, ngrams, words
from terraweave.session import cut

NGRAM = 3
MIN_SCORE = 0.5
BLOCK_KEYS = 1 << 20  # n-grams (8 bytes each) handed to tasks at once
PAIR_CELLS = 1 << 22  # cells of one batch of alignments
MATCH, OTHER, GAP = 2, -1, 1


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return words([(t or "").lower() for t in texts], marks=False)


def _grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text indexes, positions) of the n-grams inside texts, and the number of words of each text."""
    keys, bounds = _words(texts)
    counts = np.diff(bounds)
    grams = ngrams(keys, n)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(keys)) - np.repeat(bounds[:-1], counts)
    whole = (counts[owner] - place)[:len(grams)] >= n
    return grams[whole].view(np.int64), owner[:len(grams)][whole], place[:len(grams)][whole], counts


def item_uid(item_id: Column, text: Column) -> Column:
    return F.xxhash64(item_id.cast("long"), text)


def item_grams(items: DataFrame, n: int = NGRAM, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key, pos, size): the n-grams of each (id, text) and its number of words."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = np.array(column_values(batch, "item"), dtype=np.int64)
            keys, owner, place, counts = _grams(column_values(batch, "text"), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(keys), pa.array(place.astype(np.int32)),
                 pa.array(counts[owner].astype(np.int32))], ["item", "key", "pos", "size"])
    rows = items.where(F.col(key).isNotNull()).select(item_uid(F.col(key), F.col(text)).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "item long, key long, pos int, size int")


def find_hits(docs: DataFrame, keys: np.ndarray, n: int, uid: str = "uid", text: str = "text") -> DataFrame:
    """(uid, key, pos) of every n-gram of ``docs`` that is among the sorted ``keys``."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = batch.column(batch.schema.get_field_index("uid")).to_numpy(zero_copy_only=False)
            grams, owner, place, _ = _grams(column_values(batch, "text"), n)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = keys[at] == grams
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner[hit]]), pa.array(grams[hit]), pa.array(place[hit].astype(np.int32))],
                ["uid", "key", "pos"])
    return docs.select(F.col(uid).alias("uid"), F.col(text).alias("text")).mapInArrow(
        search, "uid long, key long, pos int")


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best score, position in the window just behind the best alignment) of each pair of word keys."""
    scores, ends = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int32)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(windows[i])))
    lo = 0
    while lo < len(order):
        hi, wide = lo, 0
        while hi < len(order):
            wide = max(wide, len(windows[order[hi]]))
            if hi > lo and (hi - lo + 1) * wide > PAIR_CELLS // 64:
                break
            hi += 1
        some = order[lo:hi]
        tall, wide = max(len(items[i]) for i in some), max(1, *(len(windows[i]) for i in some))
        a, b = np.zeros((len(some), tall), np.uint64), np.ones((len(some), wide), np.uint64)
        for r, i in enumerate(some):
            a[r, :len(items[i])], b[r, :len(windows[i])] = items[i], windows[i]
        away = np.arange(wide, dtype=np.int32) * GAP
        above = np.zeros((len(some), wide), dtype=np.int32)
        best, where = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32)
        for r in range(tall):
            step = np.where(b == a[:, r:r + 1], MATCH, OTHER).astype(np.int32)
            step[:, 1:] += above[:, :-1]
            row = np.maximum(np.maximum(step, above - GAP), 0)
            above = np.maximum.accumulate(row + away, axis=1) - away  # gaps along the window
            at = above.argmax(axis=1)
            top = above[np.arange(len(some)), at]
            better = top > best
            best[better], where[better] = top[better], at[better] + 1
        scores[some], ends[some] = best, where
        lo = hi
    return scores, ends


def _align(candidates: DataFrame, min_score: float) -> DataFrame:
    """Aligned candidates (uid, text, wanted: item, item_id, item_text, bucket) that reach ``min_score``."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, wanted = column_values(batch, "uid"), column_values(batch, "wanted")
            keys, bounds = _words(column_values(batch, "text"))
            found, items, windows = [], [], []
            known: dict[int, np.ndarray] = {}
            for i, uid in enumerate(ids):
                own = keys[bounds[i]:bounds[i + 1]]
                for want in wanted[i]:
                    item = known.setdefault(want["item"], None)
                    if item is None:
                        item = known[want["item"]] = _words([want["item_text"]])[0]
                    size = len(item)
                    reach = ceil((1 - min_score) * MATCH * size / GAP)  # more gaps cost the score
                    lo = max(0, want["bucket"] * size - reach)
                    window = own[lo:max(0, want["bucket"] * size + 2 * size + reach)]
                    both, n_item = np.unique(item, return_counts=True)
                    at = np.minimum(np.searchsorted(both, window), size and len(both) - 1)
                    n_window = np.bincount(at[both[at] == window], minlength=len(both))
                    if np.minimum(n_item, n_window).sum() < min_score * size:
                        continue
                    found.append((uid, want["item_id"], lo))
                    items.append(item)
                    windows.append(window)
            scores, ends = smith_waterman(items, windows)
            kept = [(*f, float(s) / (MATCH * len(item)), int(e)) for f, s, e, item in zip(found, scores, ends, items)
                    if s >= min_score * MATCH * len(item)]
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()),
                pa.array([k[3] for k in kept], pa.float64()), pa.array([k[2] + k[4] for k in kept], pa.int64())],
                ["uid", "item_id", "score", "end_word"])
    return candidates.mapInArrow(align, "uid long, item_id long, score double, end_word long")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", n: int = NGRAM, min_score: float = MIN_SCORE, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(doc_id, item_id, score, end_word): contaminated documents with their items.

    score is at most 1 (an exact copy); end_word is the number of words up to the end of the best alignment.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    grams = cut(item_grams(items, n, item_key, item_text))
    distinct = cut(grams.select("key").distinct())
    blocks = -(-distinct.count() // block_keys)
    hits = None
    for block in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        keys = np.sort(part.toPandas()["key"].to_numpy(dtype=np.int64))  # about block_keys of them
        if len(keys):
            found = find_hits(rows, keys, n)
            hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    hits = cut(hits)
    seeds = grams.select("item", "key", "size", F.col("pos").alias("at"))
    places = hits.join(seeds, "key").select(
        "uid", "item", F.floor((F.col("pos") - F.col("at")) / F.col("size")).cast("int").alias("bucket")).distinct()
    texts = items.where(F.col(item_key).isNotNull()).select(
        item_uid(F.col(item_key), F.col(item_text)).alias("item"), F.col(item_key).cast("long").alias("item_id"),
        F.col(item_text).alias("item_text")).dropDuplicates(["item"])
    wanted = places.join(texts, "item").groupBy("uid").agg(
        F.collect_list(F.struct("item", "item_id", "item_text", "bucket")).alias("wanted"))
    aligned = _align(rows.join(wanted, "uid").select("uid", "text", "wanted"), min_score)
    best = aligned.groupBy("uid", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("_end"))).alias("_best"))
    ids = rows.select("uid", "doc_id").distinct()
    return (best.join(ids, "uid").groupBy("doc_id", "item_id").agg(F.max("_best").alias("_best"))
            .select("doc_id", "item_id", F.col("_best.score").alias("score"), (-F.col("_best._end")).alias("end_word")))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, columns unchanged; rows with a null id go by their own leaks under null."""
    found = leaks(docs, items, key=key, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(cut(found), F.col(key).eqNullSafe(F.col("_leaked")), "left_anti")
