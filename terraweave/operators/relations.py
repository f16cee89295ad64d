"""Relation candidates -> committed relation graph, plus geographic edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..functions.text import fold

# Marks of generated edges, stripped before they are rebuilt.
GENERATED = ["geographic_knowledge", "transitive_geographic", "anchor_geographic"]


def dedup(relations: DataFrame, order: list[str]) -> DataFrame:
    """Best confidence per (entity_1, type, entity_2) up to case; the earliest wins ties.

    ``min_by`` over a comparable struct is a partial aggregate, so a key that
    repeats in a third of the rows shrinks to one row per task before the shuffle.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), *order)
    best = relations.groupBy(
        fold("entity_1").alias("_a"), F.col("relation_type").alias("_t"),
        fold(F.coalesce("entity_2", F.lit(""))).alias("_b"),
    ).agg(F.min_by(F.struct(*relations.columns), rank).alias("_r"), F.min(F.struct(*order)).alias("first_seen"))
    return best.select("_r.*", "first_seen")


def quality(entities: DataFrame, always: list[str] | None = None) -> DataFrame:
    """Entities fit for the graph: fictional ones once mentioned, real ones located and mentioned twice."""
    listed = F.col("canonical_name").isin(always) if always else F.lit(False)
    free = listed | (F.col("type") == "fictional")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return entities.where(
        (F.length(F.trim("canonical_name")) >= 3)
        & ((free & (F.col("mention_count") >= 1)) | (~free & placed & (F.col("mention_count") >= 2))))


def commit(relations: DataFrame, mapping: DataFrame, good: DataFrame, order: list[str]) -> DataFrame:
    """Resolve both ends through ``mapping(name, canonical)``, keep good ends, drop
    self relations, deduplicate."""
    # names meet the good entities first, so each end of the relations is shuffled once, and hashed, not sorted
    names = good.select(F.col("canonical_name").alias("canonical"), F.lit(True).alias("_ok")).distinct()
    known = mapping.select("name", "canonical").join(names, "canonical", "left")
    m = lambda n: known.select(F.col("name").alias(f"entity_{n}"), F.col("canonical").alias(f"_c{n}"), F.col("_ok").alias(f"_ok{n}"))
    out = (
        relations.join(m(1).where("_ok1").hint("shuffle_hash"), "entity_1").join(m(2).hint("shuffle_hash"), "entity_2", "left")
        .where(F.col("entity_2").isNull() | F.col("_c2").isNotNull())
        .where(F.col("_c2").isNull() | F.col("_ok2"))
        .where(F.col("_c2").isNull() | (F.col("_c1") != F.col("_c2")))
        .withColumn("entity_1", F.col("_c1")).withColumn("entity_2", F.col("_c2"))
        .select(*relations.columns)
    )
    best = dedup(out, order)
    conf = F.coalesce("confidence", F.lit(0.7))
    return best.withColumn("weight", F.round(conf, 3)).withColumn("uncertainty", F.round(1.0 - conf, 3))


def located_enough(entities: DataFrame, min_mentions: int = 2) -> DataFrame:
    return entities.where(
        (F.col("type") == "real") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & (F.col("mention_count") >= min_mentions))


def without_generated(relations: DataFrame) -> DataFrame:
    return relations.where(~F.col("extraction_method").isin(GENERATED))


def _edge(kind, a, b, km, weight: float, text, method: str):
    axis = kind.isin("north_of", "south_of", "east_of", "west_of")
    return F.struct(
        kind.alias("relation_type"), a.alias("entity_1"), b.alias("entity_2"),
        F.when(axis, F.replace(kind, F.lit("_of"), F.lit(""))).alias("direction"),
        F.round(km, 1).alias("distance_value"), F.lit("km").alias("distance_unit"),
        F.lit(round(weight, 3)).alias("weight"), F.lit(round(1.0 - weight, 3)).alias("uncertainty"),
        F.substring(text, 1, 200).alias("source_text"), F.lit(method).alias("extraction_method"))


def real_edges(pairs: DataFrame, weight: float = 0.95) -> DataFrame:
    """Three edges (north/south, east/west, distance) for each pair of located entities.

    ``pairs`` holds ``a_name, a_lat, a_lon, b_name, b_lat, b_lon``.
    """
    a, b, c, d = (F.col(x) for x in ("a_lat", "a_lon", "b_lat", "b_lon"))
    km = geo.haversine(a, b, c, d)
    ns, ew = geo.compass_pair(a, b, c, d)
    n1, n2 = F.col("a_name"), F.col("b_name")
    desc = F.concat(n1, F.lit(" → "), n2, F.lit(": "), F.round(km, 0).cast("long").cast("string"), F.lit(" km"))
    text = lambda k: F.concat(F.replace(k, F.lit("_"), F.lit(" ")), F.lit(": "), desc)
    made = pairs.select(F.array(
        _edge(ns, n1, n2, km, weight, text(ns), "geographic_knowledge"),
        _edge(ew, n1, n2, km, weight, text(ew), "geographic_knowledge"),
        _edge(F.lit("distance_approx"), n1, n2, km, weight, F.concat(F.lit("distance: "), desc),
              "geographic_knowledge")).alias("_e"))
    return made.select(F.inline("_e"))


def related_real_pairs(relations: DataFrame, real: DataFrame) -> DataFrame:
    """Unordered pairs of located entities that share at least one relation.

    All pairs of n places would be n^2 rows, although the constraint stage
    drops each of them again (both ends are fixed). Only pairs the text relates
    carry information, and their number is bounded by the relations.
    """
    ends = without_generated(relations).where(F.col("entity_2").isNotNull()).select(
        F.least("entity_1", "entity_2").alias("a_name"), F.greatest("entity_1", "entity_2").alias("b_name")
    ).where(F.col("a_name") != F.col("b_name")).distinct()
    side = lambda p: real.select(F.col("canonical_name").alias(f"{p}_name"),
                                 F.col("latitude").alias(f"{p}_lat"), F.col("longitude").alias(f"{p}_lon"))
    return ends.join(side("a"), "a_name").join(side("b"), "b_name")


def anchor_edges(relations: DataFrame, entities: DataFrame, real: DataFrame,
                 radius_km: float = 50.0) -> DataFrame:
    """One ``near`` edge per related (fictional, real) and (fictional, fictional) pair."""
    text = relations.where(~F.col("extraction_method").isin("geographic_knowledge", "anchor_geographic"))
    kinds = entities.join(real.select("canonical_name", F.lit(True).alias("ok")), "canonical_name", "left")
    side = lambda n: kinds.select(F.col("canonical_name").alias(f"entity_{n}"),
                                  F.col("type").alias(f"t{n}"), F.coalesce("ok", F.lit(False)).alias(f"ok{n}"))
    # distinct name pairs first: the joins below then see each pair once
    pairs = text.select("entity_1", "entity_2").distinct().join(side(1), "entity_1").join(side(2), "entity_2")
    e1, e2 = F.col("entity_1"), F.col("entity_2")
    f1, f2 = F.col("t1") == "fictional", F.col("t2") == "fictional"
    r1, r2 = (F.col("t1") == "real") & F.col("ok1"), (F.col("t2") == "real") & F.col("ok2")
    pick = (
        F.when(f1 & r2, F.struct(e1.alias("a"), e2.alias("b"), F.lit(0.8).alias("w")))
        .when(f2 & r1, F.struct(e2.alias("a"), e1.alias("b"), F.lit(0.8).alias("w")))
        .when(f1 & f2, F.struct(F.least(e1, e2).alias("a"), F.greatest(e1, e2).alias("b"), F.lit(0.7).alias("w")))
    )
    chosen = pairs.select(pick.alias("p")).where(F.col("p").isNotNull()).select("p.*").distinct()
    a, b = F.col("a"), F.col("b")
    radius = F.lit(float(radius_km))
    note = F.when(F.col("w") == 0.8, F.concat(
        a, F.lit(" near "), b, F.lit(f" (anchor radius {float(radius_km)} km)"))).otherwise(
        F.concat(a, F.lit(" near "), b, F.lit(" (co-occurring fictional entities)")))
    edge = _edge(F.lit("near"), a, b, radius, 0.0, note, "anchor_geographic")
    return chosen.select(edge.alias("e"), "w").select("e.*", F.col("w")).withColumn(
        "weight", F.round("w", 3)).withColumn("uncertainty", F.round(1.0 - F.col("w"), 3)).drop("w")
