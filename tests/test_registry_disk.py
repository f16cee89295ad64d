"""What the registry of clustered spans leaves on disk, and that its slices and word lookups change no row."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from terraweave.operators import dictionary, entities as en
from terraweave.session import cut, scratch, shared_dir


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if blocks.apply(i).isShuffle()}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    cut(spark.range(2000).groupBy((F.col("id") % 50).alias("k")).count())
    assert not shuffles(spark) - before


def test_scopes_inside_scopes_own_their_tables(spark):
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            gone, kept = cut(spark.range(3)), keep(spark.range(4))
        late = cut(spark.range(5))
        assert kept.count() == 4 and late.count() == 5
        stays = outer(spark.range(6))
        with pytest.raises(Exception):
            gone.groupBy("id").count().collect()
    assert stays.count() == 6
    for lost in (kept, late):
        with pytest.raises(Exception):
            lost.groupBy("id").count().collect()


@pytest.mark.parametrize("block", [40, 4 << 20])
def test_keys_are_found_within_texts_as_by_comparing_all(spark, monkeypatch, block):
    monkeypatch.setattr(dictionary, "BLOCK_CHARS", block)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abé\n") for _ in range(draw.randint(1, 4)))
    strings = lambda n, most: sorted({" ".join(word() for _ in range(draw.randint(1, most))) for _ in range(n)})
    texts = [*strings(150, 4), "", " ", "a  b", " ab"]
    keys = [(k, k.upper(), draw.random()) for k in [*strings(60, 3), "  ", " ab", "b ", "a  b"]]
    want = {t: min((o, c) for k, c, o in keys if k in t) for t in texts if any(k in t for k, _, _ in keys)}
    got = dictionary.first_within(spark.createDataFrame([(t,) for t in texts], "text string"),
                                  spark.createDataFrame(keys, "key string, canonical string, ord double"))
    assert {r["text"]: (r["ord"], r["canonical"]) for r in got.collect()} == want


SPANS = "doc_id long, chunk long, pos long, label string, surface string, sentence_id string, char_start int, char_end int, source_text string"
CLUSTERS = "doc_id long, chunk long, cluster long, pos int, mention string, sentence_id string, char_start int, char_end int"


def annotated(spark):
    draw = random.Random(3)
    names = ["West Egg", "WEST EGG", "west Egg", "Avenel", "York", "New York", "Ann", "ANN", None]
    words = ["west egg", "the West Egg road", "Annex", "in New York", "york", "Ann", "ann ", "she", "Avenel", None]
    maybe = lambda v: None if draw.random() < 0.03 else v
    spans, clusters = [], []
    for d in range(12):
        for c in range(4):
            for p in range(5):
                n, at = draw.choice(names), draw.randint(0, 3)
                spans.append((maybe(d), maybe(c), maybe(p), draw.choice(["LOC", "GPE", "ORG"]), n, maybe(f"{d}_{p}"), at, maybe(at + 8), n))
            for k in range(3):
                for p in range(draw.randint(1, 3)):
                    at = draw.randint(0, 3)
                    clusters.append((maybe(d), maybe(c), maybe(k), maybe(p), draw.choice(words), maybe(f"{d}_{p}"), at, maybe(at + 8)))
    spans, clusters = spans + spans[:40], clusters + clusters[:30]
    return spark.createDataFrame(spans, SPANS), spark.createDataFrame(clusters, CLUSTERS)


def test_slices_give_the_same_entities_and_mentions(spark, monkeypatch):
    rows = lambda: [sorted(map(repr, t.collect())) for t in en.clustered_registry(*annotated(spark))]
    whole = rows()
    monkeypatch.setattr(en, "SLICE_ROWS", 20)
    assert rows() == whole and all(whole)


def test_the_tables_of_members_are_removed(spark):
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "lineage")
    before = set(glob.glob(f"{folder}/*"))
    entities, mentions = en.clustered_registry(*annotated(spark))
    assert entities.count() and mentions.count()
    left = [set(spark.read.parquet(p).columns) for p in set(glob.glob(f"{folder}/*")) - before]
    assert left and not any(c & {"cluster", "readings", "key", "text"} for c in left)
