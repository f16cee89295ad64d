"""Coordinates for entities: overrides, gazetteer candidates, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.names import FICTIONAL
from ..session import cut
from .ordering import with_running_sum

# Coordinates (and confidence) of names geocoders get wrong.
OVERRIDES = {
    "Normandy": (49.1829, -0.3707, 0.95),
    "Marseilles": (43.2965, 5.3698, 0.95),
    "Versailles": (48.8014, 2.1301, 0.95),
    "Castile": (39.4, -3.0, 0.90),
    "Frisco": (37.7749, -122.4194, 0.85),
    "the Pennsylvania Station": (40.7506, -73.9935, 0.95),
    "Pennsylvania Station": (40.7506, -73.9935, 0.95),
}
NEAREST, BIASED, FIRST = 0.85, 0.85, 0.6   # fixed values: confidence per rule


def matches_country(display_name: Column, bias: str) -> Column:
    if bias == "US":
        return F.contains(display_name, F.lit("United States")) | F.contains(display_name, F.lit("USA"))
    return F.contains(F.lower(display_name), F.lit(bias.lower()))


def override_table(spark, extra: dict | None = None) -> DataFrame:
    rows = {**OVERRIDES, **(extra or {})}
    return spark.createDataFrame(
        [(k, *v) for k, v in rows.items()], "canonical_name string, o_lat double, o_lon double, o_conf double")


def disambiguate(candidates: DataFrame, keys: list[str], bias: str = "",
                 center: tuple[Column, Column] | None = None) -> DataFrame:
    """Best candidate per key: nearest to the centre if there is one, else the first
    that matches the country, else the first."""
    first = F.col("rank").cast("double")
    biased = matches_country(F.col("display_name"), bias) if bias else F.lit(False)
    order = F.struct((~biased).alias("b"), first.alias("d"), F.col("rank").alias("r"))
    conf = F.when(biased, BIASED).otherwise(FIRST)
    if center is not None:
        far = geo.haversine(F.col("lat"), F.col("lon"), *center)
        near = center[0].isNotNull()
        order = F.when(near, F.struct(F.lit(False).alias("b"), far.alias("d"), F.col("rank").alias("r"))).otherwise(order)
        conf = F.when(near, NEAREST).otherwise(conf)
    return candidates.groupBy(*keys).agg(
        F.min_by(F.struct("lat", "lon", conf.alias("confidence")), order).alias("c")).select(*keys, "c.*")


def ground(entities: DataFrame, gazetteer: DataFrame, cache: DataFrame | None = None, bias: str = "",
           order: str = "ord", fictional: list[str] = FICTIONAL, overrides: dict | None = None) -> DataFrame:
    """Coordinates per entity, in entity order; each placed entity moves the
    centre the next ones are compared with.

    Run as rounds over the whole table instead of one long fold: given a choice
    for every entity, running sums give each one the centre of those before it,
    which yields the next choice. After k rounds the first k entities are final,
    so the state that no longer changes is the result of the sequential fold; in
    practice a few rounds suffice because a centre moves little. Every round is
    a handful of shuffles on (block, entity) keys and is cut from its lineage.
    Tables of a round grow with the entities and there are many rounds, so their
    joins are merges: a broadcast would pass through the driver each time.

    ``cache(key, lat, lon, confidence)`` answers by lower-case name; a row with a
    null latitude is a remembered miss. ``gazetteer(name, rank, lat, lon, display_name)``.
    """
    spark = entities.sparkSession
    name = F.col("canonical_name")
    free = name.isin(fictional) | (F.col("type") == "fictional")
    # a dozen rows of fixed and configured overrides
    base = entities.join(F.broadcast(override_table(spark, overrides)), "canonical_name", "left")
    base = base.withColumn("key", F.lower(name)).withColumn("_free", free)
    if cache is None:
        cache = spark.createDataFrame([], "key string, lat double, lon double, confidence double")
    known = cache.select("key", F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon"),
                         F.col("confidence").alias("k_conf"), F.lit(True).alias("_known"))
    base = base.join(known, "key", "left")
    settled = (
        F.when(F.col("_free"), F.struct(_none("lat"), _none("lon"), _none("confidence")))
        .when(F.col("o_lat").isNotNull(), F.struct(
            F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"), F.col("o_conf").alias("confidence")))
        .when(F.col("_known"), F.struct(
            F.col("k_lat").alias("lat"), F.col("k_lon").alias("lon"), F.col("k_conf").alias("confidence")))
    )
    base = cut(base.select(order, "canonical_name", settled.alias("s")))  # every round reads it
    fixed = base.where(F.col("s").isNotNull()).select(order, "s.*")
    open_ = base.where(F.col("s").isNull()).select(order, "canonical_name")
    options = cut(open_.join(gazetteer.withColumnRenamed("name", "canonical_name"), "canonical_name").select(
        order, "rank", "lat", "lon", "display_name"))
    fixed = cut(fixed)
    chosen = cut(fixed.unionByName(disambiguate(options, [order], bias)))
    while True:
        weights = chosen.where(F.col("lat").isNotNull()).withColumn("one", F.lit(1.0))
        missing = open_.join(weights.select(order).hint("merge"), order, "left_anti").select(
            order, F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("one"))
        sums = with_running_sum(weights.select(order, "lat", "lon", "one").unionByName(missing), [], order,
                                {"lat": "s_lat", "lon": "s_lon", "one": "s_n"})
        centers = sums.select(order, (F.col("s_lat") / F.nullif("s_n", F.lit(0.0))).alias("c_lat"),
                              (F.col("s_lon") / F.nullif("s_n", F.lit(0.0))).alias("c_lon"))
        nxt = disambiguate(options.join(centers.hint("merge"), order), [order], bias, (F.col("c_lat"), F.col("c_lon")))
        before = chosen.select(order, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
        moved = ~F.col("lat").eqNullSafe(F.col("p_lat")) | ~F.col("lon").eqNullSafe(F.col("p_lon"))
        nxt = cut(fixed.unionByName(nxt).join(before.hint("merge"), order).withColumn("_moved", moved).drop("p_lat", "p_lon"))
        chosen = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            break
    out = entities.drop("latitude", "longitude", "confidence", "type").join(chosen, order, "left")
    return out.select(
        *[c for c in entities.columns if c not in ("latitude", "longitude", "confidence", "type")],
        F.when(F.col("lat").isNull(), "fictional").otherwise("real").alias("type"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.when(F.col("lat").isNotNull(), F.col("confidence")).alias("confidence"))


def _none(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)
