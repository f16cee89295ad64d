"""Predicted triples against gold triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import elements
from ..functions.text import fold, jaccard, token_set

SLOTS = ("location_1", "location_2", "spatial_indicator")


def strict(p: Column, g: Column) -> Column:
    return (p["k1"] == g["k1"]) & (p["k2"] == g["k2"]) & (p["k3"] == g["k3"])


def lenient(p: Column, g: Column, threshold: float = 0.5) -> Column:
    hit = lambda k: jaccard(p[k], g[k]) >= threshold
    return hit("k1") & hit("k2") & hit("k3")


MATCHERS = {"strict": (fold, strict), "lenient": (token_set, lenient)}


def last_per_id(records: DataFrame, order: str) -> DataFrame:
    """A repeated annotation id: the last record counts."""
    others = [c for c in records.columns if c != "annotation_id"]
    return records.groupBy("annotation_id").agg(F.max_by(F.struct(*others), order).alias("r")).select(
        "annotation_id", "r.*")


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold records with the prediction of the same id; further predictions are ignored."""
    p = pred.select("annotation_id", F.col("location_relations").alias("pred"))
    g = gold.select("annotation_id", F.col("location_relations").alias("gold"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(gold.schema["location_relations"].dataType))
    return g.join(p, "annotation_id", "left").select(
        "annotation_id", empty("gold").alias("gold"), empty("pred").alias("pred"))


def matched(pairs: DataFrame, scheme: str) -> DataFrame:
    """Greedy one-to-one matching in list order: ``hits[i]`` is the 1-based gold
    triple taken by prediction i, 0 for none.

    Both lists live in one record (one model answer about a few sentences), so
    the fold is an array expression and records are matched independently.
    """
    key, match = MATCHERS[scheme]
    keyed = lambda c: F.transform(c, lambda t: F.struct(
        *[key(t[s]).alias(f"k{i}") for i, s in enumerate(SLOTS, 1)]))
    slots = pairs.withColumn("_g", keyed("gold")).withColumn("_p", keyed("pred"))
    golds = F.transform("_g", lambda g, j: F.struct(g.alias("g"), (j + 1).alias("j")))

    def take(acc, p):
        free = F.filter(golds, lambda e: ~F.array_contains(acc, e["j"]) & match(p, e["g"]))
        return F.array_append(acc, F.coalesce(F.get(free, 0)["j"], F.lit(0)))

    hits = F.aggregate("_p", F.array().cast("array<int>"), take)
    return slots.withColumn("hits", hits).drop("_g", "_p")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * p * r, p + r))


def overall(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Micro counts and precision / recall / F1 per key (model, scheme ...)."""
    tp = F.size(F.filter("hits", lambda h: h > 0))
    sums = m.groupBy(*(keys or [])).agg(
        F.sum(tp).alias("tp"), F.sum(F.size("pred") - tp).alias("fp"), F.sum(F.size("gold") - tp).alias("fn"),
        F.sum(F.size("pred")).alias("n_predictions"))
    return with_prf(sums)


def per_type(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per semantic type: hits and misses by gold types, false alarms by predicted ones."""
    keys = keys or []
    types = lambda t: F.when(F.size(t["semantic_type"]) > 0, t["semantic_type"]).otherwise(F.array(F.lit("UNTYPED")))
    mark = lambda t, what: F.transform(types(t), lambda s: F.struct(s.alias("semantic_type"), F.lit(what).alias("what")))
    golds = F.flatten(F.transform("gold", lambda g, j: F.when(
        F.array_contains("hits", j + 1), mark(g, "tp")).otherwise(mark(g, "fn"))))
    alarms = F.flatten(F.transform(
        F.filter(F.transform("pred", lambda p, i: F.struct(p.alias("p"), F.get("hits", i).alias("h"))), lambda e: e["h"] == 0),
        lambda e: mark(e["p"], "fp")))
    rows = m.withColumn("_all", F.concat(golds, alarms)).select(*keys, F.inline(elements("_all")))
    n = lambda what: F.sum(F.when(F.col("what") == what, 1).otherwise(0)).alias(what)
    return with_prf(rows.groupBy(*keys, "semantic_type").agg(n("tp"), n("fp"), n("fn")))


def outcomes(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    g, p = F.size("gold") > 0, F.size("pred") > 0
    return m.groupBy(*(keys or [])).agg(
        F.count_if(~g & ~p).alias("correct_empty_tp"), F.count_if(g & ~p).alias("missed_empty"),
        F.count_if(~g & p).alias("halluc_on_empty"))


def markdown(scores: DataFrame) -> DataFrame:
    """Table lines of the overall report, one row per (model, scheme)."""
    pct = lambda c: F.format_string("%.3f", F.col(c))
    n = lambda c: F.col(c).cast("string")
    return scores.select("model", "scheme", F.concat(
        F.lit("| "), F.concat_ws(" | ", "model", "scheme", pct("precision"), pct("recall"), pct("f1"),
                                 n("tp"), n("fp"), n("fn")), F.lit(" |")).alias("line"))


TYPE_HEAD = ["| model | type | precision | recall | F1 | TP | FP | FN |", "|---|---|---:|---:|---:|---:|---:|---:|"]


def markdown_per_type(scores: DataFrame) -> DataFrame:
    """Table lines of the report per semantic type, one row per (model, semantic_type)."""
    pct = lambda c: F.format_string("%.3f", F.col(c))
    n = lambda c: F.col(c).cast("string")
    return scores.select("model", "semantic_type", F.concat(
        F.lit("| "), F.concat_ws(" | ", "model", "semantic_type", pct("precision"), pct("recall"), pct("f1"),
                                 n("tp"), n("fp"), n("fn")), F.lit(" |")).alias("line"))
