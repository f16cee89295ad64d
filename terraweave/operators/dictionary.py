"""Which keys of a dictionary occur inside which texts, with Aho-Corasick automata.

Keys are dealt into blocks and texts into groups, both of bounded size. A cell
builds the automaton of one block and runs it over the whole texts of one group;
it gives one row per text or per key, not one per match, so what is exchanged is
linear in texts and keys even if a short key occurs everywhere. Texts are copied
once per block of keys, keys once per group of texts; ``first_within`` does
without that for short texts, of which there are many more than words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import elements
from ..session import cut

BLOCK_CHARS = 4 << 20   # of the keys of a block, on average
GROUP_CHARS = 16 << 20  # of the texts of a group, on average
LEAST_ROWS = 2000       # groups of fewer texts are not worth an automaton of their own


def _comparable(value):
    """Nested structs as tuples that sort as Spark sorts them, nulls first."""
    if isinstance(value, dict):
        return (1, *map(_comparable, value.values()))
    return (0,) if value is None else (1, value)


def _automaton(keys: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, key in enumerate(keys):
        if key:
            found.add_word(key, i)
    found.make_automaton()
    return found


def _occurring(automaton, text: str, empty: list[int]) -> set[int]:
    return {i for _, i in automaton.iter(text)}.union(empty) if len(automaton) else set(empty)


def _least_key(keys: pa.Table, texts: pa.Table) -> tuple[list, list]:
    """(text rows, key rows): of each text that holds a key, the key that comes first."""
    words, order = keys["key"].to_pylist(), [_comparable(o) for o in keys["ord"].to_pylist()]
    rank = {i: r for r, i in enumerate(sorted(range(len(words)), key=order.__getitem__))}
    automaton, empty = _automaton(words), [i for i, w in enumerate(words) if not w]
    rows = []
    for t, text in enumerate(texts["text"].to_pylist()):
        found = _occurring(automaton, text, empty)
        if found:
            rows.append((t, min(found, key=rank.__getitem__)))
    return [t for t, _ in rows], [k for _, k in rows]


def _least_text(keys: pa.Table, texts: pa.Table) -> tuple[list, list]:
    """(text rows, key rows): of each key that is in some text, the text that comes first."""
    words, order = keys["key"].to_pylist(), [_comparable(o) for o in texts["ord"].to_pylist()]
    automaton, empty = _automaton(words), [i for i, w in enumerate(words) if not w]
    content, first = texts["text"].to_pylist(), {}
    for t in sorted(range(len(content)), key=order.__getitem__):
        for k in _occurring(automaton, content[t], empty):
            first.setdefault(k, t)
    return list(first.values()), list(first)


def _cells(keys: DataFrame, texts: DataFrame, pick, ordered: str, marks=None) -> DataFrame:
    """(text, key, canonical, ord) of what ``pick`` finds in each cell; ``ordered`` names the side with canonical and ord.

    ``marks`` gives the marks of a string, some of every key and all of them in each text around that key: blocks are then
    made by a key's first mark, and a text goes to the blocks of its own marks only.
    """
    measure = lambda df, c: df.agg(F.coalesce(F.sum(F.length(c)), F.lit(0)), F.count(F.lit(1))).first()
    (key_chars, _), (text_chars, rows) = measure(keys, "key"), measure(texts, "text")
    blocks = 1 + key_chars // BLOCK_CHARS
    groups = max(1 + text_chars // GROUP_CHARS, min(texts.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = keys.withColumn("_block", part("key" if marks is None else F.get(marks("key"), 0), blocks)).withColumn("_group", every(groups))
    right = texts.withColumn("_group", part("text", groups)).withColumn("_block", every(blocks) if marks is None else F.explode(elements(
        F.array_distinct(F.transform(marks("text"), lambda m: part(m, blocks))))))
    kind = (keys if ordered == "key" else texts).schema["ord"].dataType.simpleString()

    def run(at, k: pa.Table, t: pa.Table) -> pa.Table:
        t_rows, k_rows = pick(k, t) if k.num_rows and t.num_rows else ([], [])
        t_at, k_at = pa.array(t_rows, pa.int64()), pa.array(k_rows, pa.int64())
        source, index = (k, k_at) if ordered == "key" else (t, t_at)
        return pa.Table.from_arrays([t["text"].take(t_at), k["key"].take(k_at), source["canonical"].take(index), source["ord"].take(index)],
                                    ["text", "key", "canonical", "ord"])

    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(
        run, f"text string, key string, canonical string, ord {kind}")


def first_inside(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, canonical, ord): the first of ``keys`` (key, canonical, ord) inside each of ``texts`` (text, distinct)."""
    found = _cells(keys.select("key", "canonical", "ord"), texts.select("text"), _least_key, "key")
    return found.groupBy("text").agg(F.min_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))


def _gaps(c: str) -> Column:
    """Each blank of a string with the character on either side."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(. .))"), 1)


def first_within(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The same rows as ``first_inside``, for many short texts of few different words; both tables are read several times.

    A key without a blank lies inside one word of a text, so it is looked for in the distinct words. A key with blanks meets
    the texts that have the same characters around a blank.
    """
    blank = F.contains("key", F.lit(" "))
    words = texts.select("text", F.explode(elements(F.array_distinct(F.split("text", " ")))).alias("word"))
    lone = cut(first_inside(cut(words.select(F.col("word").alias("text")).distinct()), keys.where(~blank)))
    found = words.join(lone.withColumnRenamed("text", "word"), "word").select("text", "canonical", "ord")
    wide = keys.where(blank).select("key", "canonical", "ord")
    gapped = wide.where(F.size(_gaps("key")) > 0)
    found = found.unionByName(_cells(gapped, texts.select("text"), _least_key, "key", _gaps).select("text", "canonical", "ord"))
    edged = wide.where(F.size(_gaps("key")) == 0)  # their only blanks are at an end
    if not edged.isEmpty():
        found = found.unionByName(first_inside(texts, edged))
    return found.groupBy("text").agg(F.min_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))


def first_around(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, canonical, ord): the first of ``keys`` that has each of ``names`` (text, distinct) inside."""
    found = _cells(names.select(F.col("text").alias("key")), keys.select(F.col("key").alias("text"), "canonical", "ord"), _least_text, "text")
    return found.groupBy(F.col("key").alias("text")).agg(F.min_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
