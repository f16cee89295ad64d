"""Triples -> labelled directed multigraph and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx
from ..functions.text import strip

NONE = "—"

# Closed-class words that point at a place without naming it.
DEICTIC = [
    "i", "me", "my", "mine", "myself",
    "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
    "himself", "herself", "itself", "themselves",
    "here", "there", "where", "everywhere", "anywhere",
    "somewhere", "nowhere", "elsewhere",
    "this place", "that place", "the place",
]

# Fixed value: determiners dropped before the lookup above.
DETERMINER = r"(?i)^(?:the|a|an|this|that|these|those|some|any|no)[\s]+"


def edges(triples: DataFrame, lexicon: lx.Lexicon | None = None) -> DataFrame:
    """One edge per triple with both ends non-empty; cues are mapped, never dropped."""
    ends = triples.select(
        *[c for c in triples.columns if c not in ("location_1", "location_2", "spatial_indicator")],
        strip(F.coalesce("location_1", F.lit(""))).alias("location_1"),
        strip(F.coalesce("location_2", F.lit(""))).alias("location_2"),
        strip(F.coalesce("spatial_indicator", F.lit(""))).alias("indicator"),
    ).where((F.col("location_1") != "") & (F.col("location_2") != ""))
    mapped = ends.select("*", *[c.alias(n) for n, c in lx.map_cue("indicator", lexicon).items()])
    return mapped.withColumn("link", lx.link_kind(F.col("cdc")))


def entity_kind(surface: Column, ner_label: Column | None = None) -> Column:
    """place / deictic / person_locus / common_locus.

    Without an annotator label a capitalised single word counts as a person's place.
    """
    bare = strip(surface)
    key = F.lower(F.regexp_replace(bare, DETERMINER, ""))
    one_word = bare.rlike(r"^\p{Lu}") & ~F.contains(bare, F.lit(" "))
    rule = F.when(one_word, "person_locus").otherwise("common_locus")
    if ner_label is not None:
        rule = (F.when(ner_label.isin("GPE", "LOC", "FAC"), "place")
                .when(ner_label == "PERSON", "person_locus").otherwise("common_locus"))
    return F.when(key == "", "common_locus").when(key.isin(DEICTIC), "deictic").otherwise(rule)


def _ends(e: DataFrame) -> DataFrame:
    side = lambda name, i, o: F.struct(
        F.col(name).alias("entity"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    return e.select(F.inline(F.array(side("location_1", 0, 1), side("location_2", 1, 0))))


def nodes(e: DataFrame, tag: bool = True) -> DataFrame:
    """Degrees per entity; a self loop counts once in each direction.

    One shuffle on the entity, after map-side partial sums, so hubs cost no
    more than any other key.
    """
    out = _ends(e).groupBy("entity").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    degree = F.col("in_degree") + F.col("out_degree")
    return out.select(
        "entity", degree.alias("degree"), "in_degree", "out_degree", degree.alias("mention_count"),
        (entity_kind(F.col("entity")) if tag else F.lit("")).alias("entity_kind"))


def top_connected(n: DataFrame, k: int = 10) -> DataFrame:
    """k best by degree, then mentions, then name (a TakeOrdered, no global sort)."""
    best = n.orderBy(F.desc("degree"), F.desc("mention_count"), F.asc("entity")).limit(k)
    from pyspark.sql import Window
    # at most k rows
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), F.desc("mention_count"), F.asc("entity"))
    return best.withColumn("rank", F.row_number().over(w).cast("long"))


def distribution(e: DataFrame, column: str) -> DataFrame:
    return e.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NONE)).alias(column)).agg(
        F.count(F.lit(1)).alias("n"))


def summary(e: DataFrame) -> DataFrame:
    """Counts and the three distributions as (section, key, n), in one pass over the edges.

    Every edge adds one label row and two node rows to a single partial
    aggregation; its result is at most one row per node plus the label pairs.
    """
    row = lambda tag, a, b: F.struct(F.lit(tag).alias("tag"), a.alias("a"), b.alias("b"))
    label = lambda c: F.coalesce(F.col(c), F.lit(NONE))
    none = F.lit("")
    counted = e.select(F.inline(F.array(
        row("edge", label("rcc8"), label("cdc")),
        row("node", F.col("location_1"), none), row("node", F.col("location_2"), none),
    ))).groupBy("tag", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    out = lambda s, k, n: F.struct(F.lit(s).alias("section"), k.alias("key"), n.alias("n"))
    n, one = F.col("n"), F.lit(1).cast("long")
    is_edge = F.col("tag") == "edge"
    parts = F.when(is_edge, F.array(
        out("edges", none, n), out("rcc8", F.col("a"), n), out("cdc", F.col("b"), n),
    )).otherwise(F.array(
        out("nodes", none, one), out("entity_kind", entity_kind(F.col("a")), one),
    ))
    return counted.select(F.inline(parts)).groupBy("section", "key").agg(F.sum("n").alias("n"))


def neighbourhood(e: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """(root, entity, hop) for every entity within ``hops`` of a selected root.

    Frontiers are sets, never pair lists: each hop joins the distinct frontier
    with the distinct undirected links and keeps the smallest hop per entity.
    """
    links = e.select(F.inline(F.array(
        F.struct(F.col("location_1").alias("a"), F.col("location_2").alias("b")),
        F.struct(F.col("location_2").alias("a"), F.col("location_1").alias("b")),
    ))).distinct()
    reached = roots.select(F.col("entity").alias("root"), "entity", F.lit(0).cast("long").alias("hop"))
    for hop in range(1, hops + 1):
        step = (
            reached.where(F.col("hop") == hop - 1)
            .join(links, F.col("entity") == F.col("a"))
            .select("root", F.col("b").alias("entity"), F.lit(hop).cast("long").alias("hop"))
        )
        reached = reached.unionByName(step).groupBy("root", "entity").agg(F.min("hop").alias("hop"))
    return reached
