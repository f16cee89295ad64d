"""Quality rules and line dedup."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraweave.llm import line_dedup, quality
from terraweave.llm.common import let, words_of

from .data import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def repeated(words: list[str], k: int = 8) -> int:
    windows = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    seen = Counter(windows)
    return len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + k)})


def test_measures(docs):
    out = docs.select("text", let(words_of(F.col("text")), lambda w: quality.measures(F.col("text"), w)).alias("m"))
    for text, m in out.collect():
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        assert m.n_words == len(words)
        assert m.word_chars == sum(map(len, words))
        assert m.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert m.n_dup_lines == len(lines) - len(set(lines))
        assert m.n_repeat_words == repeated(words)


def test_symbols_and_unusual_space(spark):
    text = "a#b *|\x0bc\x0cd e <x> & $%\r\nq"
    df = spark.createDataFrame([(text,)], "text string")
    m = df.select(let(words_of(F.col("text")), lambda w: quality.measures(F.col("text"), w)).alias("m")).first().m
    assert (m.n_words, m.n_symbols) == (len(WORD.findall(text)), 8)


def test_cascade_keeps_what_no_rule_rejects(docs):
    rules = quality.BASE_RULES + quality.RULES
    kept = {(r.doc_id, r.text) for r in quality.keep(docs).collect()}
    one_by_one = docs
    for rule in rules:
        bad = let(words_of(F.col("text")), lambda w, r=rule: F.coalesce(r.rejects(F.col("text"), w), F.lit(False)))
        one_by_one = one_by_one.where(~bad)
    assert kept == {(r.doc_id, r.text) for r in one_by_one.collect()}
    assert quality.keep(docs).columns == docs.columns
    assert kept and all(t for _, t in kept)


def test_rules_are_ordered_by_rejection_per_cost(docs):
    found = quality.measure_rules(docs, quality.BASE_RULES + quality.RULES)
    worths = [m.worth for m in found]
    assert worths == sorted(worths, reverse=True) and len(found) == 7
    assert {m.rule.name: m.rejected for m in found}["too_short"] >= 5


def test_empty_tables(docs):
    none = docs.limit(0)
    assert quality.keep(none).count() == 0
    assert quality.with_verdict(none, measured="m").count() == 0
    assert line_dedup.drop_boilerplate(none, "source").count() == 0


def test_lines_by_host(spark):
    data = [(i, "big", f"own {i}\n  menu line \n\nown too {i}") for i in range(20)]
    data += [(i, "small", "menu line\nbody") for i in range(100, 104)]
    data += [(i, None, f"null host\nmine {i}") for i in range(200, 206)]
    data += [(300, "big", None), (301, "big", ""), (302, "big", "menu line\nmenu line")]
    df = spark.createDataFrame(data, "doc_id long, host string, text string")
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, "host", dropped="n").collect()}
    assert out[3].text == "own 3\n\nown too 3" and out[3].n == 1
    assert out[100].text == "menu line\nbody" and out[100].n == 0  # too few pages
    assert out[200].text == "mine 200"
    assert out[300].text is None and out[301].text == "" and out[302].text == "" and out[302].n == 2
    assert len(out) == len(data)


def test_ratio_is_relative_to_the_host(spark):
    data = [(i, "h", f"line a\nown {i}" if i < 10 else f"own {i}") for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, host string, text string")
    assert line_dedup.boilerplate(df, "host").count() == 0  # exactly a tenth is no boilerplate
    assert line_dedup.boilerplate(df, "host", max_ratio=0.09).first().pages == 10


def test_equal_texts_are_one_page_of_a_host(spark):
    data = [(i, "h", f"menu\nown {i}") for i in range(20)] + [(i, "h", "copied first line\ncopied last line") for i in range(100, 110)]
    df = spark.createDataFrame(data, "doc_id long, host string, text string")
    out = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, "host").collect()}
    assert out[3] == "own 3" and {out[i] for i in range(100, 110)} == {"copied first line\ncopied last line"}
    assert [(r.pages, r.host) for r in line_dedup.boilerplate(df, "host").collect()] == [(20, "h")]
    plain = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, "host", copies_once=False).collect()}
    assert plain[3] == "own 3" and plain[100] == ""
