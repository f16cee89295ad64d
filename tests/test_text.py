import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from terraweave.functions import lexicon as lx, names as nm, text as tx


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("given_,want", [
    ("The Great Café!", "the_great_cafe"), ("***", "doc"), ("Straße 5", "strae_5"), ("a--b", "a_b")])
def test_slug(spark, given_, want):
    assert one(spark, given_, tx.slug) == want


@pytest.mark.parametrize("given_,want", [
    ("  N.Y. ", "New York"), ("long island", "Long Island"), ("gatsby's", "Gatsby'S"), ("West Egg", "West Egg"),
    ("ab", "ab"), ("ßheit", "Ssheit")])
def test_canonical_matches_python_title(spark, given_, want):
    assert one(spark, given_, tx.canonical) == want


def test_strip_knows_every_space(spark):
    assert one(spark, "   x y　\n", tx.strip) == "x y"
    assert one(spark, " A \n B ", tx.fold) == "a b"


def test_licence_and_tidy(spark):
    raw = ("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n“Hi”—he said…\r\n\r\n\r\n\r\nend\x07"
           "\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\ntail")
    assert one(spark, raw, lambda c: tx.tidy(tx.strip_licence(c))) == '"Hi"--he said...\n\nend'
    assert one(spark, "plain", tx.strip_licence) == "plain"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\E.", max_size=12), st.text("ab\\E.", min_size=1, max_size=3)), min_size=1, max_size=20))
def test_occurrences_overlap(spark, cases):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n string")
    got = {r["i"]: r["o"] for r in df.select("i", tx.occurrences(F.col("t"), F.col("n")).alias("o")).collect()}
    for i, (t, n) in enumerate(cases):
        want = [m.start() for m in re.finditer(f"(?={re.escape(n)})", t) if m.start() + len(n) <= len(t)]
        assert (got[i] or []) == want


def test_jaccard_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, pytest.approx(1 / 3)]


CUES = [
    ("in", "NTPP", None, None, None), ("at the tip of", "TPP", None, None, None),
    ("across the bay from", None, None, None, None), ("across from", "DC", None, None, None),
    ("not far from", "EC", None, None, None), ("far from", "DC", None, None, None),
    ("twenty miles north of", None, "N", None, None), ("20 miles northeast of", None, "NE", 20.0, "miles"),
    ("southwest of", None, "SW", None, None), ("12.5 km from", None, None, 12.5, "km"), ("contains", "NTPPi", None, None, None)]


@pytest.mark.parametrize("cue,rcc8,cdc,value,unit", CUES)
def test_cue_values(spark, cue, rcc8, cdc, value, unit):
    m = lx.map_cue("v")
    r = spark.createDataFrame([(cue,)], "v string").select(*[c.alias(n) for n, c in m.items()]).first()
    assert (r["rcc8"], r["cdc"], r["distance_value"], r["distance_unit"]) == (rcc8, cdc, value, unit)


def test_lexicon_file(spark, tmp_path):
    f = tmp_path / "lex.yaml"
    f.write_text("rcc8:\n  - {pattern: '\\bzap\\b', label: EQ}\ncdc: []\n")
    lexicon = lx.load(str(f))
    assert one(spark, "zap", lambda c: lx.map_cue(c, lexicon)["rcc8"]) == "EQ"
    assert one(spark, "5 miles", lambda c: lx.map_cue(c, lexicon)["distance_value"]) is None
    assert lx.load(str(tmp_path / "none.yaml")).topology == lx.TOPOLOGY_SHORT


@pytest.mark.parametrize("cue,kind", [("IN", "REGION"), ("right across", "DIRECTION"), ("nearby", "DISTANCE"), ("zz", None)])
def test_infer_type(spark, cue, kind):
    assert one(spark, cue, lx.infer_type) == kind


@pytest.mark.parametrize("name,bad", [("ab", True), ("W3st", True), ("42nd Street", False), ("A&B", True), ("Ohio", False)])
def test_scan_errors(spark, name, bad):
    assert one(spark, name, nm.scan_error) is bad


@pytest.mark.parametrize("name,bad", [("Tom's", True), ("lake", True), ("the lake", False), ("Ohio", False)])
def test_not_a_place(spark, name, bad):
    assert one(spark, name, nm.not_a_place) is bad


def test_entity_classes(spark):
    joint = lambda n, h: one(spark, n, lambda c: nm.entity_class(c, F.lit(h)))
    assert joint("West Egg", "real") == "fictional" and joint("X", " Real") == "real"
    assert joint("Kansas City", "") == "real" and joint("Foo", "") == "uncertain"
    assert one(spark, "Lake Foo", nm.entity_class_wide) == "real"


def test_mentions_are_searched_without_a_pattern_where_one_search_will_do(spark):
    df = spark.createDataFrame([("", "a"), ("xax", "a"), ("aa", "a"), ("aaa", "aa"), (None, "a")], "t string, n string")
    got = [r["o"] or [] for r in df.select(tx.occurrences(F.col("t"), F.col("n")).alias("o")).collect()]
    assert got == [[], [1], [0, 1], [0, 1], []]
