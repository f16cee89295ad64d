"""Katz backoff language model over words, learnt and applied at scale.

Counts r of 1 to 5 are discounted by Good-Turing, for words and for pairs apart.
For a history v with C(v) tokens behind it, a pair seen c > 0 times has
P(w|v) = d(c) c / (C(v) + 1); any other word has P(w|v) = alpha(v) P(w), where
alpha(v) shares out exactly what the seen pairs leave. The added one keeps that
share above zero. P(w) = d(c) c / (N + 1); all unknown words together have the
rest. So each distribution sums to one over the known words and the unknown.
A history never seen hands on to P(w); the first token of a text has none.

Tokens are words (A-Z lower-cased) and one end per text. Pairs go to fragments by
their second word; words above ``HOT_SHARE`` of all tokens (so fewer than
1 / HOT_SHARE of them) are split by the first word, too. A fragment therefore
holds a bounded share of the pairs, knows the counts of its words and pairs, and
gives sums per document instead of a probability per token. Only pairs of
texts outside the training part that were not seen need their alpha, by join.

Word keys have 64 bits, histories 48 of them. Null texts are empty: just the end.
Rows that repeat id and text are documents of their own, with equal results.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraweave.llm.common import bounded_batches, new_folder
from terraweave.llm.shared_keys import _fragment as fragment_of
from terraweave.llm.store import column_values
from terraweave.llm.tokens import chunks, mix, words

TOP = 5  # greatest count that is discounted
HOT_SHARE = 0.001
FRAGMENT_TOKENS = 8 << 20
RANGE_TOKENS = 1 << 16  # tokens of a fragment that are worked on, or rows that are given, at once
END = np.uint64(0xE4D0E4D0E4D0E4D1)
DOC, HISTORY, UNSEEN, PAIR = range(4)  # kinds of rows that fragments give
FOUND = ("kind int, a long, b long, " + "".join(f"h{r} long, " for r in range(1, TOP + 2))
         + "x double, y double, z double, n long, m long")


@dataclass(frozen=True)
class Discounts:
    """Factors d(1) ... d(TOP); greater counts keep all of themselves."""

    factors: tuple[float, ...]

    @staticmethod
    def from_counts(seen: Sequence[int]) -> Discounts:
        """``seen[r - 1]`` items were counted r times, r = 1 ... TOP + 1; d(r) = 1 - 1 / 2r where Good-Turing has none."""
        share = (TOP + 1) * seen[TOP] / seen[0] if seen[0] else 1.0
        out = []
        for r in range(1, TOP + 1):
            d = 0.0
            if share < 1 and seen[r - 1]:
                d = ((r + 1) * seen[r] / (r * seen[r - 1]) - share) / (1 - share)
            out.append(d if 0 < d <= 1 else 1 - 0.5 / r)
        return Discounts(tuple(out))

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        d = np.array([1.0, *self.factors, 1.0])
        return d[np.minimum(counts, TOP + 1)] * counts


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    types: int
    discounts: Discounts
    left: float  # probability of the unknown

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.discounted(counts) / (self.tokens + 1), self.left)


@dataclass(frozen=True)
class Model:
    """Tables in ``folder``: unigrams (word, n), fragments (pairs under kind 3), alphas (history, alpha, total)."""

    folder: str
    unigrams: Unigrams
    pairs: Discounts


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys with an end behind each text, text indexes)."""
    keys, bounds = words(texts)
    return np.insert(keys, bounds[1:], END), np.repeat(np.arange(len(texts)), np.diff(bounds) + 1)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``rows``; tasks add up before they send."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        keys, n = np.zeros(0, np.uint64), np.zeros(0)
        for batch in chunks(batches):
            new, times = np.unique(_tokens(column_values(batch, "text"))[0], return_counts=True)
            merged, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, n = merged, np.bincount(at, weights=np.concatenate([n, times]))
            if len(keys) > 1 << 20:
                yield batch_of(keys, n)
                keys, n = np.zeros(0, np.uint64), np.zeros(0)
        if len(keys):
            yield batch_of(keys, n)

    return rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _fragments(rows: DataFrame, unigrams: Unigrams, hot: dict[int, int], fragments: int) -> DataFrame:
    """What fragments of the pairs give, by kind. ``rows``: uid, train, text."""
    hot_keys = np.array(sorted(hot), dtype=np.uint64)
    hot_counts = np.array([hot[k] for k in sorted(hot)], dtype=np.int64)

    def is_hot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hot_keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
        return hot_keys[at] == keys, at

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            uids = np.array(column_values(batch, "uid"), dtype="<i8")
            train = np.array(column_values(batch, "train"), dtype=np.uint8)
            word, owner = _tokens(column_values(batch, "text"))
            history = np.concatenate([[np.uint64(0)], np.maximum(word[:-1] >> np.uint64(16), np.uint64(1))])
            history[np.concatenate([[True], owner[1:] != owner[:-1]])] = 0
            frag = fragment_of(np.where(is_hot(word)[0], mix(word, history), word), fragments)
            order = np.lexsort((word, frag))
            word, history, owner, frag = word[order], history[order], owner[order].astype("<u2"), frag[order]
            cuts = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (frag[1:] != frag[:-1])]))
            runs = np.diff(np.append(first, len(word))).astype("<u4")
            h_bytes = history.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            f_cuts = np.searchsorted(first, cuts)
            table, flags, out = uids.tobytes(), train.tobytes(), []
            for f in np.flatnonzero(np.diff(cuts)):
                t, r = slice(cuts[f], cuts[f + 1]), slice(f_cuts[f], f_cuts[f + 1])
                out.append((int(f), table, flags, word[first[r]].astype("<u8").tobytes(), runs[r].tobytes(),
                            h_bytes[t].tobytes(), owner[t].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(map(list, zip(*out)))],
                ["frag", "uids", "train", "words", "runs", "histories", "owners"])

    def ranges(held: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        """(word, history, uid, train) of the tokens of a fragment, in ranges of words of about ``RANGE_TOKENS``."""
        every, runs = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        order = np.argsort(every, kind="stable")
        part = np.cumsum(runs[order].astype(np.int64)) // RANGE_TOKENS
        starts = np.unique(every[order][np.concatenate([[True], part[1:] != part[:-1]])])
        stops = [np.cumsum(h[3].astype(np.int64)) for h in held]
        for k, low in enumerate(starts):
            out = []
            for (uids, train, word, run, raw, owners), stop in zip(held, stops):
                i = int(np.searchsorted(word, low))
                j = int(np.searchsorted(word, starts[k + 1])) if k + 1 < len(starts) else len(word)
                if i >= j:
                    continue
                t = slice(int(stop[i - 1]) if i else 0, int(stop[j - 1]))
                wide = np.zeros((t.stop - t.start, 8), np.uint8)
                wide[:, :6] = raw[t]
                out.append((np.repeat(word[i:j], run[i:j]), wide.view("<u8")[:, 0], uids[owners[t]],
                            train[owners[t]].astype(np.int64)))
            yield tuple(map(np.concatenate, zip(*out)))

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        owners = np.unique(np.concatenate([h[0][np.unique(h[5])] for h in held]))
        sums = np.zeros((TOP + 7, len(owners)))
        for tokens in ranges(held):
            own, values = yield from solve_range(*tokens)
            at = np.searchsorted(owners, own)
            for total, value in zip(sums, values):
                total[at] += value
        whole = lambda values: np.rint(values).astype(np.int64)
        for lo in range(0, len(owners), RANGE_TOKENS):
            *hist, x, y, z, n, m, ends = sums[:, lo:lo + RANGE_TOKENS]
            yield rows_of(DOC, a=owners[lo:lo + RANGE_TOKENS], hist=[whole(h) for h in hist], x=x, y=y, z=z, n=whole(n), m=whole(m),
                          b=whole(ends))

    def solve_range(word: np.ndarray, history: np.ndarray, uid: np.ndarray, train: np.ndarray) -> Generator[
            pa.RecordBatch, None, tuple[np.ndarray, np.ndarray]]:
        """Rows of a range of words; returns the sums of the documents that have some of them."""
        order = np.lexsort((history, word))
        word, history, uid, train = word[order], history[order], uid[order], train[order]
        new_word = np.concatenate([[True], word[1:] != word[:-1]])
        new_pair = new_word | np.concatenate([[True], history[1:] != history[:-1]])
        of_word, of_pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
        n_word = np.bincount(of_word, weights=train).astype(np.int64)
        split, at = is_hot(word[new_word])
        n_word[split] = hot_counts[at[split]] if len(hot_keys) else 0
        n_pair = np.bincount(of_pair, weights=train).astype(np.int64)
        started = history > 0
        c1, c2 = n_word[of_word], np.where(started, n_pair[of_pair], 0)
        seen, p1 = c2 > 0, unigrams.probability(c1)

        owners, doc = np.unique(uid, return_inverse=True)
        ends = word == END
        values = [*(c2 == r for r in range(1, TOP + 2)),
                  np.where(c2 > TOP, np.log10(np.maximum(c2, 1)), 0) + np.where(seen, 0, np.log10(p1)),
                  np.where(ends, 0, np.log10(c1 + 1)), np.log10(c1 + 1), np.ones(len(doc)), c1 > 0, ends]
        summed = np.array([np.bincount(doc, weights=v, minlength=len(owners)) for v in values])
        kept = new_pair & seen
        names, who = np.unique(history[kept], return_inverse=True)
        c, p = c2[kept], p1[kept]
        per = lambda values: np.bincount(who, weights=values, minlength=len(names))
        yield rows_of(HISTORY, a=names.astype(np.int64), hist=[per(c == r).astype(np.int64) for r in range(1, TOP + 2)],
                      x=per(p), m=per(np.where(c > TOP, c, 0)).astype(np.int64))
        yield rows_of(PAIR, a=word[kept].view(np.int64), b=history[kept].astype(np.int64), n=c)
        lost = np.flatnonzero(started & ~seen)
        yield rows_of(UNSEEN, a=uid[lost], b=history[lost].astype(np.int64))
        return owners, summed

    names = ["kind", "a", "b", *(f"h{r}" for r in range(1, TOP + 2)), "x", "y", "z", "n", "m"]

    def rows_of(kind: int, a: np.ndarray, b=None, hist=None, x=None, y=None, z=None, n=None, m=None) -> pa.RecordBatch:
        size = len(a)
        column = lambda v, t: pa.nulls(size, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(size, kind, np.int32)), column(a, pa.int64()), column(b, pa.int64()),
            *(column(hist and hist[r], pa.int64()) for r in range(TOP + 1)),
            *(column(v, pa.float64()) for v in (x, y, z)), column(n, pa.int64()), column(m, pa.int64())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for f, u, t, w, r, h, o in zip(*(c.to_pylist() for c in batch.columns)):
                if f != current and held:
                    yield from solve(held)
                    held = []
                current = f
                held.append((np.frombuffer(u, "<i8"), np.frombuffer(t, np.uint8), np.frombuffer(w, "<u8"),
                             np.frombuffer(r, "<u4"), np.frombuffer(h, np.uint8).reshape(-1, 6), np.frombuffer(o, "<u2")))
        if held:
            yield from solve(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.mapInArrow(send, "frag int, uids binary, train binary, words binary, runs binary, histories binary, owners binary")
        .repartition(max(parts, fragments), "frag").sortWithinPartitions("frag").mapInArrow(meet, FOUND)
    )


def learn_and_score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model]:
    """Learn from the rows where ``train`` is true and score all rows.

    Scores: (doc_id, train, n_tokens, n_known, train_tokens, base_score, score), log10; base_score is the word model with
    one added to each count.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "katz")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.coalesce(train, F.lit(True)).alias("train"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    with bounded_batches(spark):
        count_words(rows.where("train")).write.parquet(f"{folder}/unigrams")
    counted = spark.read.parquet(f"{folder}/unigrams")
    seen = [F.count_if(F.col("n") == r) for r in range(1, TOP + 2)]
    tokens, types, *by_count = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *seen).first()
    discounts = Discounts.from_counts(by_count)
    lost = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(discounts.factors, by_count), 1))
    unigrams = Unigrams(tokens, types, discounts, 1 - (tokens - lost) / (tokens + 1))
    hot = {int(r[0]) & (2 ** 64 - 1): r[1] for r in counted.where(F.col("n") > HOT_SHARE * max(tokens, 1000)).collect()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_text = rows.select("uid", "train", "text")
    fragments = max(parts, 1 + int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 6.0 / FRAGMENT_TOKENS))
    with bounded_batches(spark):
        _write_kinds(_fragments(rows_text, unigrams, hot, fragments), f"{folder}/fragments")
    model = _finish(spark, folder, unigrams)
    return _scores(spark, rows, model), model


def _write_kinds(found: DataFrame, path: str) -> None:
    """A table partitioned by kind; a task keeps a file open for each instead of sorting its rows."""
    conf, name = found.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, "0")
    conf.set(name, "8")
    try:
        found.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    finally:
        conf.set(name, before)


def _finish(spark: SparkSession, folder: str, unigrams: Unigrams) -> Model:
    """Discounts of pairs, and the table of backoff weights."""
    histories = spark.read.schema(FOUND).parquet(f"{folder}/fragments").where(F.col("kind") == HISTORY)
    hist = [f"h{r}" for r in range(1, TOP + 2)]
    by_count = [n or 0 for n in histories.agg(*[F.sum(h) for h in hist]).first()]
    pairs = Discounts.from_counts(by_count)
    summed = histories.groupBy(F.col("a").alias("history")).agg(
        *[F.sum(h).alias(h) for h in hist[:TOP]], F.sum("x").alias("below"), F.sum("m").alias("great"))
    total = sum((r * F.col(f"h{r}") for r in range(1, TOP + 1)), F.col("great"))
    kept = sum((F.lit(d * r) * F.col(f"h{r}") for r, d in enumerate(pairs.factors, 1)), F.col("great"))
    summed.select("history", total.alias("total"), ((1 - kept / (total + 1)) / (1 - F.col("below"))).alias("alpha")) \
        .write.parquet(f"{folder}/alphas")
    return Model(folder, unigrams, pairs)


def _scores(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    found = spark.read.schema(FOUND).parquet(f"{model.folder}/fragments")
    hist = [f"h{r}" for r in range(1, TOP + 1)]
    docs = found.where(F.col("kind") == DOC).groupBy(F.col("a").alias("uid")).agg(
        *[F.sum(c).alias(c) for c in (*hist, "x", "y", "z", "n", "m")], F.sum("b").alias("rows"))
    alphas = spark.read.parquet(f"{model.folder}/alphas")
    # few of a document's unseen pairs share a history, so counting them first would only shuffle them twice
    unseen = (found.where(F.col("kind") == UNSEEN).select("a", "b").join(alphas, F.col("b") == F.col("history"))
              .groupBy(F.col("a").alias("uid"))
              .agg(F.sum(F.log10("alpha") + F.log10(F.col("total") + 1)).alias("backed")))
    pair_part = sum((F.lit(float(np.log10(d * r))) * F.col(f"h{r}") for r, d in enumerate(model.pairs.factors, 1)),
                    F.col("x")) - F.col("y") + F.coalesce("backed", F.lit(0.0))
    each = lambda c: c / F.col("rows")  # noqa: E731  rows that repeat id and text were summed
    uni = model.unigrams
    return (
        rows.select("uid", "doc_id", "train").distinct().join(docs.join(unseen, "uid", "left"), "uid")
        .select("doc_id", "train", each(F.col("n")).cast("long").alias("n_tokens"), each(F.col("m")).cast("long").alias("n_known"),
                F.lit(uni.tokens).cast("long").alias("train_tokens"),
                (each(F.col("z")) - each(F.col("n")) * float(np.log10(uni.tokens + uni.types + 1))).alias("base_score"),
                each(pair_part).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"))
        .drop("_row")
    )
