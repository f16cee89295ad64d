"""Quality rules as a short-circuit cascade.

Each rule is a Column over the text. On a sample its rejection rate and the time
it takes are measured; rules then run in descending rejection per second inside
one CASE expression, so a text that an early rule rejects never pays for later
ones. The order only moves work: a text is kept exactly if no rule rejects it.

Null and empty texts count as texts without words. Rows with equal ids or equal
texts are judged one by one; columns besides the text pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from terraweave.llm.common import let, words_of
from terraweave.session import cut

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 8
SAMPLE_ROWS = 2000


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def _worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\x0c\r"))) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_worded_lines(text), lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, first occurrences included.

    ``window`` is a power of two.
    """
    def hashes(codes: Column) -> Column:
        """One hash per window: each doubling joins the hash of a span with that of the span after it."""
        span, out = 1, codes
        while 2 * span <= window:
            out, span = let(out, lambda h, k=span: F.zip_with(
                h, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))), 2 * span
        return F.slice(out, 1, F.greatest(F.size(codes) - (window - 1), F.lit(0)))

    def covered(starts: Column) -> Column:
        def add(p: Column, j: Column) -> Column:
            last = j == F.size(starts) - 1
            return F.when(last, F.lit(window)).otherwise(F.least(F.lit(window), F.get(starts, j + 1) - p))
        return F.aggregate(F.transform(starts, add), F.lit(0), lambda a, b: a + b)

    def sharing(ordered: Column) -> Column:
        def twin(e: Column, j: Column) -> Column:
            before = F.coalesce(F.get(ordered, j - 1)["h"] == e["h"], F.lit(False))
            after = F.coalesce(F.get(ordered, j + 1)["h"] == e["h"], F.lit(False))
            return before | after
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(let(pairs, sharing), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), count).cast("long")


def measures(text: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    return F.struct(
        F.size(words).cast("long").alias("n_words"), word_chars(words).alias("word_chars"),
        n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a bad text; null counts as false."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _odd_length(text: Column, words: Column) -> Column:
    """Mean length with the gap behind it."""
    n = F.length(text)
    return (n < 3 * F.size(words)) | (n > 16 * F.size(words))


def _few_letters(text: Column, words: Column) -> Column:
    def bare(w: Column) -> Column:
        plain = ((w >= "a") & (w < "{")) | ((w >= "A") & (w < "["))  # spares most words the pattern
        return ~(plain | w.rlike(r"\p{L}"))
    return 10 * F.size(F.filter(words, lambda w: bare(w))) > 3 * F.size(words)


def _dup_lines(text: Column, words: Column) -> Column:
    return let(_worded_lines(text), lambda v: 10 * (F.size(v) - F.size(F.array_distinct(v))) > 3 * F.size(v))


def _shouting(text: Column, words: Column) -> Column:
    capitals = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", ""))
    return 2 * capitals > F.length(text)


BASE_RULES = (
    Rule("too_short", lambda text, words: F.size(words) < 20),
    Rule("repetition", lambda text, words: 100 * repeated_words(words) > 30 * F.size(words)),
)
RULES = (
    Rule("symbols", lambda text, words: 10 * n_symbols(text) > F.size(words)),
    Rule("word_length", _odd_length),
    Rule("few_letters", _few_letters),
    Rule("dup_lines", _dup_lines),
    Rule("shouting", _shouting),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure_rules(df: DataFrame, rules: Sequence[Rule], text: str = "text",
                  sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Time and rejections of every rule on a random sample of about ``sample_rows`` rows, best first.

    The sample decides the order of evaluation only, never a verdict.
    """
    texts = df.select(F.col(text).alias("_text"))
    total = texts.count()
    sample = cut(texts.sample(False, min(1.0, sample_rows / max(total, 1)), seed))
    found = []
    for rule in rules:
        verdict = let(words_of(F.col("_text")), lambda words: rule.rejects(F.col("_text"), words))
        seen = sample.agg(F.count_if(F.coalesce(verdict, F.lit(False))))
        seconds, rejected = [], 0
        for _ in range(2):  # the first run also compiles
            t0 = time.perf_counter()
            rejected = seen.first()[0]
            seconds.append(time.perf_counter() - t0)
        found.append(Measured(rule, min(seconds), rejected))
    return sorted(found, key=lambda m: (-m.worth, m.seconds))


def first_rejection(rules: Sequence[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule in this order that rejects, null for a text that passes all of them."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(text, words), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def with_verdict(df: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, text: str = "text",
                 name: str = "rejected_by", measured: str | None = None,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with the name of a rejecting rule, or null; rules are ordered by rejection per cost.

    ``measured`` names a column for the struct of ``measures``.
    """
    order = [m.rule for m in measure_rules(df, rules, text, sample_rows)]

    def judge(words: Column) -> Column:
        parts = [first_rejection(order, F.col(text), words).alias("verdict")]
        return F.struct(*parts, *([measures(F.col(text), words).alias("measures")] if measured else []))

    out = df.withColumn("_judged", let(words_of(F.col(text)), judge)).withColumn(name, F.col("_judged.verdict"))
    return (out.withColumn(measured, F.col("_judged.measures")) if measured else out).drop("_judged")


def keep(df: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, text: str = "text",
         sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, columns unchanged."""
    order = [m.rule for m in measure_rules(df, rules, text, sample_rows)]
    return df.where(let(words_of(F.col(text)), lambda w: first_rejection(order, F.col(text), w).isNull()))
