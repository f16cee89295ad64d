"""Constraints evaluated in every sample, in numpy, one cell of samples and constraints at a time.

A table of constraints times samples is large; joining its rows with positions would shuffle it. Here the
samples are dealt to blocks and the constraints to groups, and only these two meet: a cell holds one block's
positions of the entities that one group names, and sends back one row per sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from .block_moves import penalties
from .constraints import PARAMS

TERMS = 16_384      # constraints of a group, on average
SPOTS = 1 << 20     # positions of a cell, about
WIDTH = 2048        # samples of a block, at most
CHUNK = 1 << 15     # penalties computed at once

# The types that a parameter belongs to.
READ_BY = {
    "epsilon_km": ("north_of", "south_of", "east_of", "west_of", "across"),
    "d_near_km": ("near", "co_occurrence", "across"), "d_far_km": ("far",),
    "target_d_km": ("distance_approx",), "sigma_km": ("distance_approx",),
    "centroid_x_km": ("in_region",), "centroid_y_km": ("in_region",), "radius_km": ("in_region",),
}


def with_defaults(kind: Column, across_near: float = geo.ACROSS_NEAR_KM) -> list[Column]:
    """The parameters a type reads, with their fallbacks; null where the penalty does not read them."""
    value = lambda p: F.coalesce(p, F.lit(geo.DEFAULTS[p])) if p in geo.DEFAULTS else F.col(p)
    near = F.when(kind == "across", F.coalesce("d_near_km", F.lit(across_near))).otherwise(value("d_near_km"))
    return [F.when(kind.isin(*READ_BY.get(p, ())), near if p == "d_near_km" else value(p)).alias(p) for p in PARAMS]


def per_sample(terms: DataFrame, draws: DataFrame, rest_on_first: bool, fold: Callable, results: dict[str, str]) -> DataFrame:
    """Rows (sample_id, *results) of every cell; a sample has one per group of constraints, to be summed.

    ``terms(type, e1, e2, d1, d2, fx1, fy1, fx2, fy2, weight, <params>)``: ``d1`` and ``d2`` say which ends are drawn; others
    stay at the fixed point, if there is one. It is counted first, so it should be a written table. A sample that
    lacks the first end leaves a constraint out. One that lacks the second leaves it out, too, unless constraints
    ``rest_on_first``: then both ends are at the first. ``fold(penalty, there, void, weight)`` gives an array by sample for each of
    ``results``; ``void`` marks penalties of null positions.
    """
    cores = terms.sparkSession.sparkContext.defaultParallelism
    n_terms = terms.count()
    n_samples, n_entities = draws.agg(F.approx_count_distinct("sample_id"), F.approx_count_distinct("entity_id")).first()
    groups = max(1, -(-n_terms // TERMS))
    width = max(16, min(WIDTH, SPOTS // max(1, min(n_entities, 2 * TERMS)), -(-n_samples // cores)))
    blocks = max(1, -(-n_samples // width))
    cell, parts = ["group", "block"], min(groups * blocks, 16 * cores)
    kept = terms.withColumn("group", F.pmod(F.xxhash64("type", "e1", "e2", *PARAMS), F.lit(groups)).cast("int"))
    needs = kept.select("group", F.explode(F.array(F.when(F.col("d1"), F.col("e1")), F.when(F.col("d2"), F.col("e2")))).alias(
        "entity_id")).where(F.col("entity_id").isNotNull()).distinct()
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kept.withColumn("block", numbers(blocks)).repartition(parts, *cell)
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("block")
    known = draws.where(F.col("sample_id").isNotNull())
    right = known.join(needs, "entity_id").select("group", block, "sample_id", "entity_id", "x", "y")
    if rest_on_first:  # a sample counts where it has none of the entities, too
        none = lambda kind: F.lit(None).cast(kind)
        right = right.unionByName(known.select("sample_id").distinct().select(
            numbers(groups).alias("group"), block, "sample_id", none("string").alias("entity_id"), none("double").alias("x"), none("double").alias("y")))
    kinds = {name: {"long": pa.int64(), "double": pa.float64()}[kind] for name, kind in results.items()}

    def meet(held: pa.Table, spots: pa.Table) -> pa.Table:
        ids = spots["sample_id"].combine_chunks().dictionary_encode()
        out = _evaluated(held, spots, ids, rest_on_first, fold) if held.num_rows and spots.num_rows else None
        if out is None:
            return pa.table({"sample_id": spots["sample_id"].slice(0, 0), **{n: pa.array([], k) for n, k in kinds.items()}})
        return pa.table({"sample_id": ids.dictionary, **{n: pa.array(v).cast(k) for (n, k), v in zip(kinds.items(), out)}})

    key = draws.schema["sample_id"].dataType.simpleString()
    right = right.toDF("of_group", "at_block", "sample_id", "entity_id", "x", "y").repartition(parts, "of_group", "at_block")
    return left.groupBy(*cell).cogroup(right.groupBy("of_group", "at_block")).applyInArrow(
        meet, f"sample_id {key}, " + ", ".join(f"{n} {k}" for n, k in results.items()))


def _evaluated(held: pa.Table, spots: pa.Table, ids: pa.DictionaryArray, rest_on_first: bool, fold: Callable) -> list[np.ndarray] | None:
    """Results of the cell by sample; None if no sample has a constraint."""
    entities = spots["entity_id"].combine_chunks().dictionary_encode()
    named = entities.is_valid().to_numpy(zero_copy_only=False)
    at = entities.drop_null().indices.to_numpy(), ids.indices.to_numpy()[named]
    shape = len(entities.dictionary), len(ids.dictionary)
    there = np.zeros(shape, bool)
    there[at] = True
    place, unset = [np.full(shape, np.nan) for _ in "xy"], [np.ones(shape, bool) for _ in "xy"]
    for k, c in enumerate("xy"):
        column = spots[c].combine_chunks()
        place[k][at] = column.to_numpy(zero_copy_only=False)[named]
        unset[k][at] = column.is_null().to_numpy(zero_copy_only=False)[named]
    gaps = unset[0].any() or unset[1].any()
    total = None
    for kind, (drawn1, drawn2), rows in _groups(held, entities.dictionary, rest_on_first):
        step = max(1, CHUNK // shape[1])
        for lo in range(0, len(rows["weight"]), step):
            part = {c: v[lo:lo + step, None] for c, v in rows.items()}
            one, two = part["s1"][:, 0], part["s2"][:, 0]
            seen = there[one] if drawn1 else np.ones((len(one), shape[1]), bool)
            first = [p[one] for p in place] if drawn1 else [part["fx1"], part["fy1"]]
            second = [p[two] for p in place] if drawn2 else [part["fx2"], part["fy2"]]
            void = np.zeros((1, 1), bool)
            if rest_on_first and drawn2 and gaps:
                second = [np.where(u[two], f, s) for u, f, s in zip(unset, first, second)]
            elif rest_on_first and not drawn2:
                second = [np.where(np.isnan(s), f, s) for f, s in zip(first, second)]
            elif not drawn2:
                second = [np.nan_to_num(s) for s in second]
            elif gaps:
                seen = seen & there[two]
            value = np.broadcast_to(penalties(kind, *first, *second, {p: part[p] for p in READ_BY}), seen.shape)
            if gaps:
                lost = [u[rows_of] for rows_of, drawn in ((one, drawn1), (two, drawn2)) if drawn for u in unset]
                void = np.isnan(value) & np.any(lost, axis=0) if lost else void
            made = fold(value, seen, void, rows["weight"][lo:lo + step])
            total = made if total is None else [a + b for a, b in zip(total, made)]
    return total


def _groups(held: pa.Table, entities: pa.Array, rest_on_first: bool) -> Iterator[tuple[str, tuple[bool, bool], dict[str, np.ndarray]]]:
    """(type, whether each end is drawn, columns) of the constraints that some sample of the cell may have."""
    kinds = held["type"].combine_chunks().dictionary_encode()
    number = lambda c: held[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    slot = lambda c: pc.fill_null(pc.index_in(held[c].combine_chunks(), value_set=entities), -1).to_numpy(zero_copy_only=False)
    drawn = [held[c].combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for c in ("d1", "d2")]
    columns = {"s1": slot("e1"), "s2": slot("e2"), **{c: number(c) for c in ("weight", "fx1", "fy1", "fx2", "fy2", *READ_BY)}}
    for c in ("fx2", "fy2"):
        columns[c][drawn[1]] = np.nan  # nobody has this end: the first stands for it, or the constraint is left out
    met = [d & (columns[s] >= 0) for d, s in zip(drawn, ("s1", "s2"))]
    usable = (~drawn[0] | met[0]) & (rest_on_first | ~drawn[1] | met[1])
    code = kinds.indices.to_numpy()
    for k, kind in enumerate(kinds.dictionary.to_pylist()):
        for ends in ((False, False), (False, True), (True, False), (True, True)):
            rows = np.flatnonzero((code == k) & usable & (met[0] == ends[0]) & (met[1] == ends[1]))
            if len(rows):
                yield kind, ends, {c: v[rows] for c, v in columns.items()}
