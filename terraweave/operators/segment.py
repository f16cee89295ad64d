"""Documents -> sentences -> windows and chunks.

A document is one row, so everything that follows the order of its sentences is
done on an array inside that row: no shuffle, and no single task ever receives
the rows of a hot document. The ``*_rows`` variants do the same for inputs that
already come as one row per sentence; they number rows block-wise (see
``ordering``) and group only the few rows of one window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.arrays import elements
from ..functions.text import SPACE, col, strip, strip_licence, tidy
from .ordering import with_position, with_previous

OFFSETS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))

MIN_SENTENCE = 10     # characters a sentence needs to be kept
MIN_WINDOWED = 20     # characters a sentence needs to enter a window


def clean_documents(docs: DataFrame, text: str = "text", licence: bool = True,
                    ellipsis: bool = True) -> DataFrame:
    body = strip_licence(text) if licence else F.col(text)
    return docs.withColumn(text, tidy(body, ellipsis))


def split_sentences(text: Column | str, min_chars: int = MIN_SENTENCE) -> Column:
    """Sentence array: cut after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.transform(F.split(col(text), r"(?<=[.!?])" + SPACE + "+"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


def drop_repeats(sentences: Column) -> Column:
    """Drop elements equal to their predecessor."""
    return F.filter(sentences, lambda s, i: (i == 0) | (s != F.get(sentences, i - 1)))


def sentence_arrays(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    min_chars: int = MIN_SENTENCE, dedup: str = "consecutive") -> DataFrame:
    """One row per document: ``sents ARRAY<STRUCT<idx, text>>``.

    ``dedup="consecutive"`` re-indexes after dropping runs of equal sentences;
    ``dedup=None`` keeps everything (see ``first_of_repeats_rows`` for dropping
    every later repeat).
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), split_sentences(text, min_chars).alias("_raw"))
    if dedup == "consecutive":
        base = base.select("doc_id", drop_repeats(F.col("_raw")).alias("_raw"))
    return base.select("doc_id", F.transform("_raw", lambda s, i: F.struct(
        i.alias("idx"), s.alias("text"))).alias("sents"))


def sentence_id(doc_id: Column, idx: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_sent_"), idx.cast("string"))


def sentences(arrays: DataFrame) -> DataFrame:
    """Explode sentence arrays into the sentence table."""
    flat = arrays.select("doc_id", F.inline(elements("sents")))
    return flat.select(
        "doc_id", F.col("idx").cast("long").alias("sent_idx"),
        sentence_id(F.col("doc_id"), F.col("idx")).alias("sentence_id"), "text")


def _one_line(s: Column) -> Column:
    return strip(F.replace(s, F.lit("\n"), F.lit(" ")))


def windows(arrays: DataFrame, size: int = 3, stride: int = 3,
            min_chars: int = MIN_WINDOWED) -> DataFrame:
    """Full windows of ``size`` sentences every ``stride``; the partial tail is dropped."""
    kept = arrays.select("doc_id", F.filter(
        "sents", lambda s: F.length(s["text"]) >= min_chars).alias("sents"))
    n = F.size("sents")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(stride)))
    return _cut(kept, starts, size, joined=lambda part: strip(F.array_join(
        F.transform(part, lambda s: _one_line(s["text"])), " ")))


def chunks(arrays: DataFrame, size: int = 6, overlap: int = 2) -> DataFrame:
    """Overlapping chunks of ``size`` sentences; the partial tail is kept."""
    stride = max(1, size - overlap)
    n = F.size("sents")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride)))
    cut = _cut(arrays, starts, size, joined=lambda part: F.array_join(
        F.transform(part, lambda s: s["text"]), " "))
    return cut.withColumn("chunk_id", F.concat(
        F.col("doc_id").cast("string"), F.lit("_chunk_"), F.format_string("%04d", F.col("window_id"))))


def _cut(arrays: DataFrame, starts: Column, size: int, joined) -> DataFrame:
    at = arrays.select("doc_id", "sents", F.posexplode(starts).alias("window_id", "start"))
    part = at.select("doc_id", F.col("window_id").cast("long").alias("window_id"),
                     F.slice("sents", F.col("start") + 1, size).alias("sents"))
    return part.select(
        "doc_id", "window_id", "sents",
        F.transform("sents", lambda s: sentence_id(F.col("doc_id"), s["idx"])).alias("sentence_ids"),
        joined(F.col("sents")).alias("sentence"))


# -- spans ------------------------------------------------------------------

def boundaries(sents: Column, doc_id: Column) -> Column:
    """[start, end) of each sentence inside the joined window text."""
    lengths = F.transform(sents, lambda s: F.length(_one_line(s["text"])))
    return F.transform(sents, lambda s, i: _bound(s, F.aggregate(
        F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n + 1), F.get(lengths, i), doc_id))


def _bound(s: Column, start: Column, n: Column, doc_id: Column) -> Column:
    return F.struct(start.alias("start"), (start + n).alias("end"),
                    sentence_id(doc_id, s["idx"]).alias("sentence_id"))


def to_sentence(start: Column, end: Column, bounds: Column, fallback: bool = True) -> Column:
    """Sentence and local span of a window span; the end is clamped to the sentence.

    A start between sentences falls back to the last one, or gives null.
    """
    hit = F.get(F.filter(bounds, lambda b: (start >= b["start"]) & (start < b["end"])), 0)
    b = F.coalesce(hit, F.element_at(bounds, -1)) if fallback else hit
    return F.when(b.isNotNull(), F.struct(
        b["sentence_id"].alias("sentence_id"), (start - b["start"]).alias("local_start"),
        (F.least(end, b["end"]) - b["start"]).alias("local_end")))


@F.pandas_udf(OFFSETS)
def _cursor(tokens: pd.Series, text: pd.Series) -> pd.Series:
    def one(words, body):
        at, out = 0, []
        for word in words:
            hit = body.find(word, at)
            if hit < 0:
                hit = len(body) - len(body[at:].lstrip(" "))
            at = hit + len(word)
            out.append({"start": hit, "end": at})
        return out
    return pd.Series([one(w, b) for w, b in zip(tokens, text)])


def token_offsets(tokens: Column, text: Column) -> Column:
    """(start, end) of every token, searched from the end of the previous one; a
    token that is not found is placed after the blanks at the cursor.

    The cursor makes this a true left-to-right fold over one sentence, which an
    array expression can only do in quadratic time, hence the Arrow helper.
    """
    return _cursor(tokens, text)


# -- one row per sentence ---------------------------------------------------

def drop_repeats_rows(rows: DataFrame, key: str, order: str, text: str, coarse: Column | None = None) -> DataFrame:
    """Drop rows whose text equals that of the preceding row of the same key."""
    marked = with_previous(rows, [key], order, text, "_prev", coarse=coarse)
    return marked.where(~F.col(text).eqNullSafe(F.col("_prev")) | F.col("_prev").isNull()).drop("_prev")


def first_of_repeats_rows(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Keep the first row of each (key, text); partial aggregation absorbs hot texts."""
    others = [c for c in rows.columns if c not in (key, text)]
    best = rows.groupBy(key, text).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return best.select(key, text, "_r.*").select(*rows.columns)


def windows_rows(rows: DataFrame, key: str, order: str, text: str, size: int = 3,
                 stride: int = 3, partial_tail: bool = False, one_line: bool = True) -> DataFrame:
    """Windows over rows: each row is sent to the few windows it belongs to."""
    placed = with_position(rows.select(key, order, text), [key], order)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / stride) + 1)
    last = F.floor(F.col("pos") / stride)
    spread = placed.select(
        key, order, "pos", text, F.explode(F.when(first <= last, F.sequence(first, last))).alias("window_id"))
    body = _one_line(F.col(text)) if one_line else F.col(text)
    grouped = spread.groupBy(key, "window_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(order).alias("ord"), body.alias("t")))).alias("p"))
    if not partial_tail:
        grouped = grouped.where(F.size("p") == size)
    return grouped.select(
        key, F.col("window_id").cast("long").alias("window_id"),
        F.transform("p", lambda s: s["ord"]).alias("members"),
        F.transform("p", lambda s: F.struct(s["ord"].alias("idx"), s["t"].alias("text"))).alias("sents"),
        strip(F.array_join(F.transform("p", lambda s: s["t"]), " ")).alias("sentence"))


# -- token budgets ----------------------------------------------------------

def count_tokens(text: Column) -> Column:
    """Default tokenizer: runs of non-space characters."""
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def _greedy(budget: int):
    @F.pandas_udf("array<int>")
    def assign(sizes: pd.Series) -> pd.Series:
        def one(counts):
            chunk, used, filled, out = 0, 0, False, []
            for n in counts:
                if filled and used + n > budget:
                    chunk, used = chunk + 1, 0
                used, filled = used + n, True
                out.append(chunk)
            return out
        return sizes.map(one)
    return assign


def _overlapping(budget: int, overlap: int):
    @F.pandas_udf("array<struct<start:int,len:int>>")
    def assign(sizes: pd.Series) -> pd.Series:
        def one(counts):
            out, i, n = [], 0, len(counts)
            while i < n:
                j, used = i, 0
                while j < n and (j == i or used + counts[j] <= budget):
                    used += counts[j]
                    j += 1
                out.append({"start": i, "len": j - i})
                if j >= n:
                    break
                i += max(1, j - i - overlap)
            return out
        return sizes.map(one)
    return assign


def budget_chunks(arrays: DataFrame, budget: int = 380, tokens=count_tokens) -> DataFrame:
    """Greedy non-overlapping chunks of at most ``budget`` tokens, at least one sentence each.

    The fold only sees the token counts (one small int array per document);
    texts stay in the JVM.
    """
    counted = arrays.withColumn(
        "_n", F.transform("sents", lambda s: tokens(s["text"])))
    placed = counted.withColumn("_c", _greedy(budget)(F.col("_n")))
    rows = placed.select("doc_id", F.inline(elements(F.arrays_zip("_c", "sents", "_n"))))
    return rows.groupBy("doc_id", F.col("_c").cast("long").alias("chunk")).agg(
        F.min("sents.idx").cast("long").alias("first_idx"),
        F.count(F.lit(1)).alias("n_sents"), F.sum("_n").cast("long").alias("n_tokens"))


def budget_windows(arrays: DataFrame, budget: int = 400, overlap: int = 5,
                   tokens=count_tokens) -> DataFrame:
    """Token-budget windows that share ``overlap`` sentences with their successor."""
    counted = arrays.withColumn(
        "_n", F.transform("sents", lambda s: tokens(s["text"])))
    placed = counted.withColumn("_w", _overlapping(budget, overlap)(F.col("_n")))
    rows = placed.select("doc_id", "_n", F.posexplode(elements("_w")).alias("win", "w"))
    used = F.aggregate(F.slice("_n", F.col("w.start") + 1, F.col("w.len")), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.col("win").cast("long").alias("win"),
                       F.col("w.start").cast("long").alias("first_pos"),
                       F.col("w.len").cast("long").alias("n_sents"), used.cast("long").alias("n_tokens"))


# -- sampling ---------------------------------------------------------------

def draw_windows(candidates: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` windows without replacement in a seeded hash order; too few is an error, raised at once.

    Ranking by a hash keeps the draw a TakeOrdered: each task sends its ``n``
    best rows, whatever the number of candidates.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), F.col("window_id")))
    drawn = candidates.withColumn("_h", order).orderBy("_h").limit(n)
    # the drawn rows are at most n, so numbering them in one task is bounded
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0)).orderBy("_h")
    out = drawn.withColumn("i", F.row_number().over(w) - 1).drop("_h")
    if candidates.limit(n).count() < n:
        raise ValueError(f"fewer than {n} windows to draw from")
    return out.withColumn("annotation_id", F.format_string("ann_%03d", "i")).drop("i")
