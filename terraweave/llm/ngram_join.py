"""Exact n-gram Jaccard join by vertical partitioning.

1. Documents of whose shingles fewer than the threshold's share occur anywhere
   else can link with nothing and leave (``shared_keys``).
2. Documents with equal sets become one class; only its representative goes on.
3. Shingles get a global order, rarest first. A pair above the threshold must
   share a shingle of both prefixes, so prefixes give all candidate pairs.
   First every document meets, for each of its prefix shingles, only the document
   there with the fewest shingles of its own; components of the links found so far are joined, and a second
   pass forms the pairs between different components that share a prefix
   shingle. Large groups of near copies thus never give all their pairs.
4. The global order is cut into fragments. The overlap of a pair is counted per
   fragment, from the two segments in it, and summed per pair.

A document without words has an empty set and links with nothing. Null texts are
empty. Documents are told apart by id and text, so rows that repeat both are one
document with several rows, and rows that share an id only stay separate. A null
id never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terraweave.llm.common import bounded_batches
from terraweave.llm.components import components
from terraweave.llm.shared_keys import count_shared, fragments_for
from terraweave.llm.tokens import chunks, distinct_by_text, shingles
from terraweave.session import cut

SHINGLE_WORDS = 5
PERCENT = 80
FRAGMENTS = 8
BROADCAST_ROWS = 4_000_000


def _at_least(n: Column, percent: int) -> Column:
    """Smallest whole overlap that is ``percent`` of ``n``."""
    return F.ceil(F.col(n) * percent / 100) if isinstance(n, str) else F.ceil(n * percent / 100)


def shingle_sets(docs: DataFrame, n: int, uid: str = "uid", text: str = "text") -> DataFrame:
    """(uid, keys): the sorted distinct shingle keys of each document, signed as longs."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            keys, owner = distinct_by_text(*shingles(batch.column(batch.schema.get_field_index(text)).to_pylist(), n))
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
            values = pa.array(keys[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(uid)), pa.ListArray.from_arrays(pa.array(ends), values)],
                ["uid", "keys"])
    return docs.select(uid, text).mapInArrow(sets, "uid long, keys array<long>")


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose overlap, counted per fragment and summed, reaches the threshold."""
    left = segments.select(F.col("id").alias("a"), "frag", F.col("n").alias("n_a"), F.col("seg").alias("seg_a"))
    right = segments.select(F.col("id").alias("b"), F.col("frag").alias("frag_b"), F.col("n").alias("n_b"),
                            F.col("seg").alias("seg_b"))
    both = pairs.join(left, "a").join(right, ["b"]).where(F.col("frag") == F.col("frag_b"))
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("seg_a", "seg_b")).alias("part"))
    summed = partial.groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("part").alias("both"))
    return summed.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _links(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Links (a, b) between documents with different sets that connect all that are connected."""
    spark = sets.sparkSession
    sized = sets.select(F.col("rep").alias("id"), "keys", F.size("keys").cast("long").alias("n"))
    counted = (sized.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
               .where("df > 1"))
    # place in the global order as a number: frequency, then key
    place = F.col("df") + (F.col("key") / F.lit(2.0 ** 64) + 0.5)
    known = (
        sized.select("id", "n", F.explode("keys").alias("key")).join(counted, "key")
        .groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(
            F.struct(place.alias("place"), "key"))).alias("keys"))
        .where(F.size("keys") >= _at_least("n", percent))
    )
    ordered = cut(known)
    marks = [i / fragments for i in range(1, fragments)]
    pivots = ordered.select(F.explode("keys.place").alias("p")).agg(F.percentile_approx("p", marks, 10_000)).first()[0]
    if not pivots:
        return spark.createDataFrame([], "a long, b long")
    edges = F.array(*[F.lit(float(p)) for p in [float("-inf"), *pivots, float("inf")]])
    segments = cut(
        ordered.select("id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(pivots))), lambda f: F.transform(
            F.filter("keys", lambda e: (e["place"] > F.get(edges, f)) & (e["place"] <= F.get(edges, f + 1))),
            lambda e: e["key"]))).alias("frag", "seg")).where(F.size("seg") > 0))
    # Place in the whole order: shingles of one document only come first and are not listed.
    alone = F.col("n") - F.size("keys")
    prefix = cut(ordered.select("id", "n", alone.alias("alone"), F.posexplode(F.slice(
        F.col("keys.key"), 1, (F.size("keys") - _at_least("n", percent) + 1).cast("int"))).alias("pos", "key"))
        .withColumn("pos", F.col("pos") + F.col("alone")))

    def can_link(n: Column, pos: Column, m: Column, other: Column) -> Column:
        """Behind their first common shingle both documents must hold the overlap that their sizes ask for."""
        need = F.ceil(percent * (n + m) / (100 + percent))
        return (n - pos >= need) & (m - other >= need)

    hubs = prefix.groupBy("key").agg(
        F.min(F.struct("alone", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("other"))).alias("hub"),
        F.count(F.lit(1)).alias("df")).where("df > 1").select("key", "hub.b", "hub.m", "hub.other")
    first = (prefix.join(hubs, "key").where("id <> b").where(can_link(*map(F.col, ("n", "pos", "m", "other"))))
             .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())
    found = cut(_verified(first, segments, percent))
    comps = cut(components(found))
    placed = prefix.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = cut(placed.join(open_keys, "key"))
    one = rest.select("key", F.col("id").alias("a"), "n", "pos", F.col("comp").alias("comp_a"))
    two = rest.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("other"),
                      F.col("comp").alias("comp_b"))
    between = (one.join(two, "key").where("a < b and comp_a <> comp_b")
               .where(can_link(*map(F.col, ("n", "pos", "m", "other")))).select("a", "b").distinct())
    return found.union(_verified(between, segments, percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS,
                    percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, uid, n_shingles, component_id, comp), a row per row of ``docs``.

    component_id is the smallest id that links of at least ``percent`` reach; ``uid`` is ``document_uid``. ``comp``
    tells components apart whatever the ids are: it is the uid of one of the component's documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("uid", document_uid(F.col("doc_id"), F.col("text")))
    with bounded_batches(docs.sparkSession):
        counted = cut(count_shared(rows, lambda texts: shingles(texts, n), fragments_for(rows, "text", 6.0)))
    able = counted.where((F.col("n_keys") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_keys"))).select("uid")
    able = cut(able)
    if able.count() <= BROADCAST_ROWS:  # 8 bytes each; beyond, the texts are shuffled to them
        able = F.broadcast(able)
    with bounded_batches(docs.sparkSession):
        sets = cut(shingle_sets(rows.join(able, "uid", "left_semi"), n).dropDuplicates(["uid"]))
    code = sets.select("uid", F.size("keys").alias("n"), F.xxhash64("keys").alias("h"), F.hash("keys").alias("g"))
    classes = code.groupBy("n", "h", "g").agg(F.min("uid").alias("rep"))
    member = cut(code.join(classes, ["n", "h", "g"]).select("uid", "rep"))
    reps = sets.join(member.where("uid = rep").select("uid", "rep"), "uid")
    comps = components(cut(_links(reps, percent, fragments)))
    named = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("uid", F.coalesce("comp", "rep").alias("comp"))
    ids = rows.select("uid", "doc_id").distinct()
    known = cut(ids.join(counted, "uid").join(named, "uid", "left"))
    smallest = known.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("_least"))
    return (
        known.join(smallest, "comp", "left")
        .select("doc_id", "uid", F.col("n_keys").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"),
                F.coalesce("comp", "uid").alias("comp"),
                F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"))
        .drop("_row")
    )


def document_uid(key: Column, text: Column) -> Column:
    """Tells documents apart by id and text."""
    return F.xxhash64(key, text)
