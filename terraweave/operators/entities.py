"""Entity registry, mentions, and resolution of names against a registry.

The registry is normalised: entities, mentions and (entity, document) pairs are
separate tables, so nothing ever gathers all mentions of a frequent entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import elements
from ..functions.names import FICTIONAL, entity_class
from ..functions.text import canonical, fold, occurrences, snippet
from ..session import cut, scratch
from .dictionary import first_around, first_inside, first_within
from .ordering import with_global_position


def find_mentions(name: Column, sents: Column, doc_id: Column) -> Column:
    """All occurrences of ``name`` in the sentences of its own chunk, case-insensitive; ``sents`` has them in lower case, too."""
    low = F.lower(name)

    def in_sentence(s):
        return F.transform(occurrences(s["low"], low), lambda at: F.struct(
            F.concat(doc_id.cast("string"), F.lit("_sent_"), s["idx"].cast("string")).alias("sentence_id"),
            at.alias("char_start"), (at + F.length(name)).alias("char_end"),
            snippet(s["text"], at, at + F.length(name)).alias("source_text")))

    return F.flatten(F.transform(F.filter(sents, lambda s: F.contains(s["low"], low)), in_sentence))


def chunk_entities(relations: DataFrame) -> DataFrame:
    """Endpoints of each chunk's relations, one row per chunk and normalised name.

    ``relations`` carries ``doc_id, chunk, ord, sents`` next to the validated
    relation. The first spelling in a chunk names the entity there. Mentions are
    searched while the chunk's sentences are still in the row, so the shuffle
    moves spans, not text.
    """
    lowered = relations.withColumn("sents", F.transform("sents", lambda s: F.struct(
        s["idx"].alias("idx"), s["text"].alias("text"), F.lower(s["text"]).alias("low"))))  # once, not for each name
    raw = lowered.select("doc_id", "chunk", "ord", "sents", F.inline(F.array(*[F.struct(
        F.lit(side).alias("side"), F.col(f"entity_{n}").alias("raw"),
        F.col(f"entity_{n}_type").alias("ner_label"), F.col(f"entity_{n}_class").alias("hint"),
    ) for side, n in ((0, 1), (1, 2))]))).where(F.col("raw").isNotNull())
    named = raw.select(
        "doc_id", "chunk", (F.col("ord") * 2 + F.col("side")).alias("pos"), "raw", "ner_label", "hint",
        canonical("raw").alias("canon"), find_mentions(F.col("raw"), F.col("sents"), F.col("doc_id")).alias("mentions"))
    return named.groupBy("doc_id", "chunk", fold("canon").alias("norm")).agg(
        F.min_by(F.struct("canon", "ner_label", "hint", "mentions"), "pos").alias("e")
    ).select("doc_id", "chunk", "norm", "e.*")


def mention_table(found: DataFrame) -> DataFrame:
    """Distinct (entity, sentence, span) rows."""
    flat = found.select(F.col("canon").alias("canonical_name"), F.inline(elements("mentions")))
    return flat.dropDuplicates(["canonical_name", "sentence_id", "char_start", "char_end"])


def registry(found: DataFrame, fictional: list[str] = FICTIONAL) -> DataFrame:
    """One row per canonical name; ids follow the sorted names, so dropping
    never-mentioned entities afterwards leaves gaps."""
    found = cut(found)  # spans only; three aggregates read them
    first = F.struct("doc_id", "chunk")
    merged = found.groupBy(F.col("canon").alias("canonical_name")).agg(
        F.min_by(F.struct("ner_label", "hint"), first).alias("f"))
    docs = found.select(F.col("canon").alias("canonical_name"), "doc_id").distinct().groupBy(
        "canonical_name").agg(F.count(F.lit(1)).alias("doc_count"))
    counts = mention_table(found).groupBy("canonical_name").agg(F.count(F.lit(1)).alias("mention_count"))
    whole = cut(merged.join(docs, "canonical_name").join(counts, "canonical_name", "left"))
    placed = with_global_position(whole, ["canonical_name"], "_n")
    return placed.where(F.col("mention_count").isNotNull()).select(
        F.format_string("e_%04d", "_n").alias("entity_id"), "canonical_name",
        entity_class(F.col("canonical_name"), F.col("f.hint"), fictional).alias("type"),
        F.col("f.ner_label").alias("ner_label"), "mention_count", "doc_count")


def chunk_names(relations: DataFrame) -> DataFrame:
    """(doc_id, chunk, norm, canon) of ``chunk_entities``, without a search for mentions; needs no sentences."""
    ends = relations.select("doc_id", "chunk", F.posexplode(F.array("entity_1", "entity_2")).alias("side", "raw"), "ord").where(
        F.col("raw").isNotNull()).withColumn("canon", canonical("raw"))
    return ends.groupBy("doc_id", "chunk", fold("canon").alias("norm")).agg(
        F.min_by("canon", F.col("ord") * 2 + F.col("side")).alias("canon"))


def remap(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Relation endpoints take the spelling their chunk registered first."""
    names = found.select("doc_id", "chunk", "norm", "canon")
    side = lambda n: names.select("doc_id", "chunk", F.col("norm").alias(f"_n{n}"), F.col("canon").alias(f"_c{n}"))
    keyed = relations.drop("sents").withColumn("_n1", fold(canonical("entity_1"))).withColumn(
        "_n2", fold(canonical("entity_2")))
    out = keyed.join(side(1), ["doc_id", "chunk", "_n1"]).join(side(2), ["doc_id", "chunk", "_n2"], "left")
    return out.withColumn("entity_1", F.col("_c1")).withColumn("entity_2", F.col("_c2")).drop(
        "_n1", "_n2", "_c1", "_c2")


# -- resolution -------------------------------------------------------------

def lookup_keys(entities: DataFrame, order: str) -> DataFrame:
    """(key, canonical, ord): names and canonical names; a repeated key keeps its
    first place and its last value."""
    rows = entities.select(F.inline(F.array(
        F.struct(fold("canonical_name").alias("key"), F.col("canonical_name").alias("canonical"),
                 F.struct(F.col(order).alias("at"), F.lit(0).alias("side")).alias("o")),
        F.struct(fold("name").alias("key"), F.col("canonical_name").alias("canonical"),
                 F.struct(F.col(order).alias("at"), F.lit(1).alias("side")).alias("o")))))
    return rows.groupBy("key").agg(F.max_by("canonical", "o").alias("canonical"), F.min("o").alias("ord"))


def resolve(names: DataFrame, keys: DataFrame) -> DataFrame:
    """name -> canonical: exact key, else the first key that contains the name or
    is contained in it.

    ``contains`` in a join condition would compare every name with every key;
    automata over blocks of keys read each name once instead (``dictionary``).
    Names are made distinct first, so a frequent name is resolved once.
    """
    # written once: exact hits and open names read them
    todo = cut(names.select("name").where(F.col("name") != "").distinct().withColumn("key", fold("name")))
    keys = cut(keys)
    exact = todo.join(keys.select("key", "canonical"), "key").select("name", "canonical")
    open_ = cut(todo.join(keys.select("key"), "key", "left_anti"))
    texts = cut(open_.select(F.col("key").alias("text")).distinct())
    found = first_inside(texts, keys).unionByName(first_around(texts, keys)).groupBy("text").agg(
        F.min_by("canonical", "ord").alias("canonical"))
    return exact.unionByName(open_.join(found, open_["key"] == found["text"]).select("name", "canonical"))


def match_mentions(mentions: DataFrame, entities: DataFrame, order: str) -> DataFrame:
    """mention text -> canonical: exact, without its article, else the first entity
    of four characters or more named inside the mention."""
    keys = entities.select(F.lower("canonical_name").alias("key"), F.col("canonical_name").alias("canonical"),
                           F.col(order).alias("o")).groupBy("key").agg(
        F.max_by("canonical", "o").alias("canonical"), F.min("o").alias("ord"))
    from ..functions.text import strip
    keys = cut(keys)
    todo = mentions.select("mention").distinct().withColumn("low", F.lower(strip("mention")))
    short = F.regexp_replace("low", "^(?:the|a|an) ", "")
    tries = F.array(F.struct(F.lit(0).alias("level"), F.col("low").alias("key")),
                    F.struct(F.lit(1).alias("level"), short.alias("key")))
    direct = todo.select("mention", F.inline(tries)).join(keys, "key").select(
        "mention", "canonical", "level")
    direct = cut(direct.groupBy("mention").agg(F.min_by("canonical", "level").alias("canonical")))
    rest = cut(todo.join(direct, "mention", "left_anti"))
    texts = rest.select(F.col("low").alias("text")).where(F.col("text").isNotNull()).distinct()
    inside = first_inside(texts, keys.where(F.length("key") >= 4))
    return direct.unionByName(rest.join(inside, rest["low"] == inside["text"]).select("mention", "canonical"))


def propagate_coref(clusters: DataFrame, entities: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """New mentions an entity gains from coreference clusters.

    ``clusters(window, cluster, pos, mention, sentence_id, char_start, char_end)``
    comes from an annotator; ``existing(canonical_name, sentence_id)`` are known
    mentions. A cluster belongs to the entity of its first mention that matches
    one. Each (entity, sentence) gains at most one mention - the earliest - and
    none when that one merely repeats the entity's name.
    """
    matched = clusters.join(match_mentions(clusters, entities, order), "mention")
    owner = matched.groupBy("window", "cluster").agg(F.min_by("canonical", "pos").alias("canonical_name"))
    fresh = clusters.join(owner, ["window", "cluster"]).join(
        existing.select("canonical_name", "sentence_id").distinct(), ["canonical_name", "sentence_id"], "left_anti")
    # one pre-aggregated row per (entity, sentence)
    first = fresh.groupBy("canonical_name", "sentence_id").agg(F.min_by(
        F.struct("mention", "char_start", "char_end"), F.struct("window", "cluster", "pos")).alias("m")).select(
        "canonical_name", "sentence_id", "m.*")
    from ..functions.text import strip
    return first.where(F.lower(strip("mention")) != F.lower("canonical_name")).withColumn(
        "source_text", F.concat(F.lit("[coref→"), F.col("canonical_name"), F.lit("] ..."), F.col("mention"), F.lit("...")))


def without_coref(mentions: DataFrame) -> DataFrame:
    return mentions.where(~F.contains("source_text", F.lit("[coref")))


# -- registry from annotated spans --------------------------------------------

CAPITALISED = r"(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"


def capitalised_spans(sentences: DataFrame) -> DataFrame:
    """Default span annotator: runs of capitalised words, wherever they occur.

    Stands in for a model that labels spans; any table of the same shape does.
    """
    found = sentences.select("doc_id", "sent_idx", "sentence_id", "text", F.explode(elements(F.array_distinct(
        F.regexp_extract_all("text", F.lit(CAPITALISED), 1)))).alias("surface"))
    placed = found.select("doc_id", "sent_idx", "sentence_id", "surface", F.explode(elements(
        occurrences(F.col("text"), F.col("surface")))).alias("char_start"))
    return placed.withColumn("char_end", F.col("char_start") + F.length("surface")).withColumn("label", F.lit("LOC"))


def span_registry(spans: DataFrame, labels: tuple = ("GPE", "LOC", "FAC"), min_mentions: int = 2,
                  blocked: list[str] | None = None, fictional: list[str] | None = None) -> DataFrame:
    """Entities of annotated spans: normalised surface, filtered by name and mention
    count, classified, numbered in the order of their first span."""
    from ..functions import names as nm
    from ..functions.text import surface
    more = sorted(set(FICTIONAL) | set(fictional or []))
    named = spans.where(F.col("label").isin(*labels)).withColumn("canonical_name", surface("surface"))
    first = F.struct("doc_id", "sent_idx", "char_start")
    merged = named.groupBy("canonical_name").agg(
        F.count(F.lit(1)).alias("mention_count"), F.min_by("label", first).alias("ner_label"), F.min(first).alias("f"))
    kept = merged.where(nm.plausible(F.col("canonical_name"), F.col("mention_count"), min_mentions,
                                     sorted(set(nm.BLOCKED) | set(blocked or [])), more))
    flat = cut(kept.select("canonical_name", "mention_count", "ner_label", "f.*"))
    placed = with_global_position(flat, ["doc_id", "sent_idx", "char_start", "canonical_name"], "_n")
    return placed.select(
        F.format_string("e_%04d", "_n").alias("entity_id"), "canonical_name",
        nm.entity_class_wide(F.col("canonical_name"), more).alias("type"), "ner_label", "mention_count")


SLICES, SLICE_ROWS = 4, 1_000_000  # most slices of a large table's shuffle, and the rows from which a slice pays


def _in_slices(keep, rows: DataFrame, by: list, plan) -> DataFrame:
    """The tables of ``plan`` over slices of ``by``, one after the other: only one slice's shuffle is on disk at a time.

    ``rows`` is a written table, read once per slice; ``plan`` gets a function that keeps a table's rows of a slice, given the
    same columns there.
    """
    n = min(SLICES, 1 + rows.count() // SLICE_ROWS)
    if n == 1:
        return keep(plan(lambda df, cols=by: df), "zstd")
    out = None
    for i in range(n):
        part = keep(plan(lambda df, cols=by: df.where(F.pmod(F.xxhash64(F.lit("slice"), *cols), F.lit(n)) == i)), "zstd")
        out = part if out is None else out.unionByName(part)
    return out


def _low() -> Column:
    from ..functions.text import strip
    return F.lower(strip("mention"))


def _readings(members: DataFrame, named: DataFrame) -> DataFrame:
    """(low, readings): the names a member's text in lower case may stand for, each with its place.

    A reading is (rank, doc_id, chunk, canonical_name); names equal to the text have positive ranks, those inside it negative
    ones, and of the readings known at some place the greatest counts. A text has the spellings of two names at most.
    """
    first = F.struct("doc_id", "chunk", "pos", "canonical_name")
    seen = named.where(F.col("canonical_name").isNotNull()).groupBy("canonical_name").agg(F.min(first).alias("first")).select("first.*")
    names = cut(with_global_position(cut(seen), ["doc_id", "chunk", "pos", "canonical_name"], "rank").select(
        (F.col("rank") + 1).alias("rank"), "doc_id", "chunk", "canonical_name", F.lower("canonical_name").alias("key")))
    total = names.agg(F.max("rank")).scalar()
    keys = cut(names.groupBy("key").agg(F.min("rank").alias("ord")).select("key", F.col("key").alias("canonical"), "ord"))
    texts = cut(members.select(_low().alias("text")).where(F.col("text").isNotNull()).distinct())
    inside = cut(first_within(texts, keys.where(F.length("key") >= 4)).select(
        F.col("text").alias("low"), F.col("canonical").alias("key"), F.lit(False).alias("equal")))
    equal = keys.select("key").join(texts.withColumnRenamed("text", "key"), "key").select(
        F.col("key").alias("low"), "key", F.lit(True).alias("equal"))
    rank = F.when(F.col("equal"), F.col("rank")).otherwise(F.col("rank") - total - 1)
    return equal.unionByName(inside).join(names, "key").groupBy("low").agg(F.collect_list(
        F.struct(rank.alias("rank"), "doc_id", "chunk", "canonical_name")).alias("readings"))


def owned_members(clusters: DataFrame, named: DataFrame, repeats: bool = False) -> DataFrame:
    """Members of the coreference clusters that belong to an entity, with its ``canonical_name``; without ``repeats`` not those
    that repeat the name.

    ``named`` has the entity spans with ``canonical_name``. A cluster knows the entities named up to its own chunk, in the
    order of their first span. Its first member decides that is such a name, up to case, or that holds a name of four
    characters or more; of several the one named first counts. Names equal up to case mean the last of them.

    A member's row is shuffled to its readings and to its cluster, each time from a written table and with nothing else left
    on disk but ``named``.
    """
    spark = named.sparkSession
    whole = ["doc_id", "chunk", "cluster"]
    owned = F.col("canonical_name").isNotNull() if repeats else _low() != F.lower("canonical_name")
    with scratch(spark) as keep:
        with scratch(spark) as keep_read:
            members = cut(clusters.dropna(subset=whole).select(*whole, "pos", "mention", "sentence_id", "char_start", "char_end"), "zstd")
            with scratch(spark) as keep_readings:
                readings = keep_readings(_readings(members, named), "zstd")
            best = F.array_max(F.filter("readings", lambda r: F.struct(r["doc_id"], r["chunk"]) <= F.struct("doc_id", "chunk")))
            read = _in_slices(keep_read, members, [_low()], lambda of: of(members).join(of(readings, ["low"]), _low() == F.col("low"), "left").select(
                *members.columns, best["rank"].alias("rank"), best["canonical_name"].alias("canonical_name")))
        order = F.when(F.col("rank").isNotNull(), F.struct("pos", F.col("rank") < 0, -F.col("rank")))
        return _in_slices(keep, read, whole, lambda of: of(read).withColumn("canonical_name", F.min_by("canonical_name", order).over(
            Window.partitionBy(*whole))).drop("rank").where(owned))


def cluster_owners(clusters: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, chunk, cluster, canonical_name): the entity each coreference cluster belongs to; see ``owned_members``."""
    return owned_members(clusters, named, True).select("doc_id", "chunk", "cluster", "canonical_name").distinct()


def clustered_registry(spans: DataFrame, clusters: DataFrame, labels: tuple = ("GPE", "LOC", "FAC"), min_mentions: int = 2,
                       blocked: list[str] | None = None, fictional: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) of annotated spans and coreference clusters.

    ``spans(doc_id, chunk, pos, label, surface, sentence_id, char_start, char_end, source_text)``, ``pos`` ascending in a
    chunk; ``clusters(doc_id, chunk, cluster, pos, mention, sentence_id, char_start, char_end)``. Members of a cluster become
    mentions of its entity, once per place and unless they repeat its name or lie where it is named already. Entities are
    then filtered by name and mention count, classified, and numbered in the order of their first span.
    """
    from ..functions import names as nm
    from ..functions.text import surface
    more = sorted(set(FICTIONAL) | set(fictional or []))
    spot = ["canonical_name", "sentence_id", "char_start", "char_end"]
    named = cut(spans.where(F.col("label").isin(*labels)).select(
        surface("surface").alias("canonical_name"), "doc_id", "chunk", "pos", "label", "sentence_id", "char_start", "char_end", "source_text"), "zstd")
    with scratch(named.sparkSession) as keep:
        owned = owned_members(clusters, named)
        first = F.struct("doc_id", "chunk", "cluster", "pos")
        fresh = _in_slices(keep, owned, spot, lambda of: of(owned).join(of(named.select(*spot)), spot, "left_anti").groupBy(*spot).agg(
            F.min_by("mention", first).alias("mention"), F.min("doc_id").alias("doc_id")))
    at = F.struct("doc_id", "chunk", "pos")
    n = lambda rows: rows.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n"))
    merged = named.groupBy("canonical_name").agg(F.min_by("label", at).alias("ner_label"), F.min(at).alias("f"))
    counts = n(named).unionByName(n(fresh)).groupBy("canonical_name").agg(F.sum("n").alias("mention_count"))
    docs = n(named.select("canonical_name", "doc_id").unionByName(fresh.select("canonical_name", "doc_id")).distinct()).withColumnRenamed(
        "n", "doc_count")
    kept = merged.join(counts, "canonical_name").join(docs, "canonical_name").where(nm.plausible(
        F.col("canonical_name"), F.col("mention_count"), min_mentions, sorted(set(nm.BLOCKED) | set(blocked or [])), more))
    flat = cut(kept.select("canonical_name", "mention_count", "doc_count", "ner_label", "f.*"))
    placed = with_global_position(flat, ["doc_id", "chunk", "pos", "canonical_name"], "_n")
    entities = cut(placed.select(
        F.format_string("e_%04d", "_n").alias("entity_id"), "canonical_name",
        nm.entity_class_wide(F.col("canonical_name"), more).alias("type"), "ner_label", "mention_count", "doc_count"))
    keep_columns = ["doc_id", *spot, "source_text"]
    mentions = named.select(*keep_columns).unionByName(fresh.withColumn("source_text", F.concat(
        F.lit("[coref→"), F.col("canonical_name"), F.lit("] ..."), F.col("mention"), F.lit("..."))).select(*keep_columns))
    return entities, mentions.join(entities.select("canonical_name"), "canonical_name", "left_semi")
