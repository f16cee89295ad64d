"""The given tables, and the domain inputs Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import canonical
from ..operators import extract, segment
from ..session import cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a small file comes as fewer splits than there are cores.

    A large scan has more splits than the cluster has cores and is left as is,
    so no text is ever shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def sentence_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return segment.sentence_arrays(segment.clean_documents(documents(spark, sf)))


def document_windows(spark: SparkSession, sf: str) -> DataFrame:
    return segment.windows(sentence_arrays(spark, sf))


def window_triples(spark: SparkSession, sf: str, bare: bool = False) -> DataFrame:
    """(doc_id, window_id, sentence_id, sentence, ord, triple) over every document."""
    found = extract.CueExtractor(bare=bare).attach(document_windows(spark, sf))
    found = found.withColumn("sentence_id", F.get("sentence_ids", F.lit(0)))
    return extract.triple_rows(found, ["doc_id", "window_id", "sentence_id", "sentence"])


# -- entities, relations and draws derived from the star schema --------------

# Fixed list: relation types assigned to line items below.
LINE_TYPES = [
    "near", "far", "north_of", "south_of", "east_of", "west_of", "across", "on_coast", "within", "contains",
    "part_of", "borders", "on_shore_of", "connected_via", "distance_approx", "in_region", "co_occurrence",
]


def pick(values: list[str], c) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))


def geo_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are located (nine of ten), customers are not."""
    none = F.lit(None).cast("double")
    sup = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    has = F.pmod(k, F.lit(10)) != 9
    real = sup.select(
        k.alias("ord"), F.concat(F.lit("s"), k.cast("string")).alias("entity_id"), F.col("s_name").alias("name"),
        F.col("s_name").alias("canonical_name"), F.lit("real").alias("type"),
        F.when(has, F.round(40.7128 + (F.pmod(k * 37, F.lit(201)) - 100) / 20.0, 4)).alias("latitude"),
        F.when(has, F.round(-74.006 + (F.pmod(k * 73, F.lit(301)) - 150) / 20.0, 4)).alias("longitude"),
        F.pmod(k, F.lit(5)).alias("mention_count"))
    cust = table(spark, sf, "customer")
    c = F.col("c_custkey")
    free = cust.select(
        (c + 1000000000).alias("ord"), F.concat(F.lit("c"), c.cast("string")).alias("entity_id"),
        F.col("c_name").alias("name"), F.col("c_name").alias("canonical_name"), F.lit("fictional").alias("type"),
        none.alias("latitude"), none.alias("longitude"), F.pmod(c, F.lit(4)).alias("mention_count"))
    return real.unionByName(free)


def geo_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One relation per line item between its customer, its supplier and their like."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_returnflag", "l_linestatus")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = li.join(orders.hint("shuffle_hash"), "l_orderkey")  # line items are shuffled, but not sorted
    n = F.col("l_linenumber")
    cust = lambda c: F.format_string("Customer#%09d", c)
    supp = lambda c: F.format_string("Supplier#%09d", c)
    lane = F.pmod(n, F.lit(4))
    kind = pick(LINE_TYPES, F.col("l_partkey") + n)
    return rows.select(
        (F.col("l_orderkey") * 8 + n).alias("rel_ord"),
        F.concat_ws("_", F.lit("r"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"),
        kind.alias("relation_type"),
        F.when(lane == 3, supp(F.col("l_suppkey"))).otherwise(cust(F.col("o_custkey"))).alias("entity_1"),
        F.when((kind == "on_coast") & (F.pmod(n, F.lit(2)) == 0), F.lit(None).cast("string"))
        .when(lane == 0, cust(F.col("l_partkey"))).otherwise(supp(F.col("l_suppkey") + n)).alias("entity_2"),
        F.round(0.5 + F.col("l_discount") * 5, 3).alias("confidence"),
        F.round(0.5 + F.col("l_discount") * 5, 3).alias("weight"),
        F.when(F.col("l_quantity") < 3, 0.0).when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("distance_value"),
        F.when(F.col("l_returnflag") == "R", "miles").when(F.col("l_returnflag") == "A", "km").alias("distance_unit"),
        F.when((F.col("l_linestatus") == "F") & (lane == 3), "geographic_knowledge")
        .when(n == 5, "anchor_geographic").otherwise("model").alias("extraction_method"))


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding is one draw of 32 points, four chains in turn."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(
        F.concat(F.lit("v"), j.cast("string")).alias("entity_id"),
        (F.get("v", j * 2) * 100).alias("x"), (F.get("v", j * 2 + 1) * 100).alias("y")))
    return e.select(F.pmod("vec_id", F.lit(4)).alias("chain_id"), F.col("vec_id").alias("sample_id"), F.inline(points))


def part_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Constraints among the 32 drawn points and the nations, one per part."""
    p = table(spark, sf, "part")
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    none = F.lit(None).cast("double")
    fixed = lambda c: F.concat(F.lit("f"), c.cast("string"))
    drawn = lambda c: F.concat(F.lit("v"), c.cast("string"))
    own = {"d_near_km": z.cast("double"), "target_d_km": F.when(z > 5, z.cast("double"))}
    from ..operators.constraints import PARAMS
    return p.select(
        F.format_string("c_%04d", k).alias("constraint_id"), pick(LINE_TYPES, z + k).alias("type"),
        F.when(F.pmod(k, F.lit(5)) == 0, fixed(F.pmod(z, F.lit(8)))).otherwise(drawn(F.pmod(k, F.lit(34)))).alias("e1"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, F.lit(7)) <= 2, fixed(F.pmod(k, F.lit(25))))
        .otherwise(drawn(F.pmod(k * 3 + 1, F.lit(33)))).alias("e2"),
        F.lit(1.0).alias("weight"), *[own.get(q, none).alias(q) for q in PARAMS])


def nation_points(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(
        F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("name"),
        (F.col("n_nationkey") * 2.0 - 25).alias("x"), (F.col("n_regionkey") * 5.0 - 10).alias("y"))


# -- names, registries and scored windows derived from the texts -------------

def word_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named by the words of the benchmark texts, in reading order."""
    b = table(spark, sf, "benchmark")
    words = b.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("i", "w"))
    place = F.struct("item_id", "i")
    return words.groupBy(canonical("w").alias("canonical_name")).agg(
        F.min(place).alias("ord"), F.min_by("w", place).alias("name"))


def gold_and_pred(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Windows as gold (spans without articles) and as two models' answers."""
    wins = document_windows(spark, sf).withColumn("annotation_id", F.concat_ws("_", "doc_id", "window_id"))
    marked = extract.CueExtractor(bare=True).attach(wins).select("annotation_id", "sentence", F.col("location_relations").alias("gold"))
    both = cut(extract.CueExtractor().attach(marked).select(  # read once per model; the texts are cut into windows once
        "annotation_id", "gold", F.col("location_relations").alias("full")))
    gold, full = (both.select("annotation_id", F.col(c).alias("location_relations")) for c in ("gold", "full"))
    narrow = full.withColumn("location_relations", F.filter(
        "location_relations", lambda t: ~t["location_1"].rlike("(?i)^(the|an|a) ")))
    return gold, {"full": full, "narrow": narrow}


def chunk_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based joint extraction on six-sentence chunks, validated."""
    from ..functions import lexicon as lx
    chunks = segment.chunks(sentence_arrays(spark, sf))
    found = extract.CueExtractor().attach(chunks)
    rows = found.select("doc_id", F.col("window_id").alias("chunk"), "chunk_id", "sents",
                        F.posexplode(extract.elements("location_relations")).alias("ord", "t"))
    none = F.lit(None).cast("string")
    raw = rows.select(
        "doc_id", "chunk", "chunk_id", "ord", "sents",
        lx.relation_of(F.col("t.spatial_indicator")).alias("relation_type"),
        F.col("t.location_1").alias("entity_1"), F.col("t.location_2").alias("entity_2"),
        *[none.alias(f"entity_{n}_{k}") for n in (1, 2) for k in ("type", "class")],
        F.when(F.contains(F.col("t.spatial_indicator"), F.lit(" ")), "0.9").otherwise("0.7").alias("confidence"),
        none.alias("distance_value"), none.alias("distance_unit"))
    return extract.valid_relations(raw, 0.55)
