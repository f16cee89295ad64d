"""Registered queries over entities, relations, constraints, draws and runs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import geo, lexicon as lx, names as nm, text as tx
from ..operators import (constraints as cn, diagnostics as dg, entities as en, extract, graph, grounding,
                         joint, progress, relations as rl, sampling as sm, scoring, segment)
from . import tables as tb
from ..session import cut, shared_dir
from ..sources import writers
from ..sources.cache import CacheTable
from .tables import table

LAT0, LON0 = 40.7128, -74.0060


def r4(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 4)


def half_up(c):
    """Four decimals by plain arithmetic: exact ties fall the same way everywhere."""
    return F.floor(F.col(c) * 10000 + 0.5) / 10000


# -- spans and parsing --------------------------------------------------------

def span_to_sentence(spark, sf):
    wins = tb.document_windows(spark, sf)
    scan = extract.scan_pattern()
    wins = wins.select("doc_id", "window_id", "sentence", segment.boundaries(F.col("sents"), F.col("doc_id")).alias("b"))
    rows = wins.select("doc_id", "window_id", "sentence", "b", F.posexplode(extract.elements(F.regexp_extract_all("sentence", F.lit(scan), 0))).alias("ord", "m"))
    at = F.position(F.col("m"), F.col("sentence")) - 1
    placed = rows.select("doc_id", "window_id", F.col("ord").cast("long").alias("ord"), "m",
                         at.alias("start"), segment.to_sentence(at, at + F.length("m"), F.col("b")).alias("s"))
    return placed.select("doc_id", "window_id", "ord", F.col("start").cast("long").alias("start"), "s.sentence_id",
                         F.col("s.local_start").cast("long").alias("local_start"),
                         F.col("s.local_end").cast("long").alias("local_end"))


def token_offsets(spark, sf):
    sents = segment.sentences(tb.sentence_arrays(spark, sf))
    toks = sents.withColumn("toks", F.filter(F.split("text", tx.SPACE + "+"), lambda w: w != ""))
    return toks.select("doc_id", "sent_idx", F.posexplode(extract.elements(F.arrays_zip(
        "toks", segment.token_offsets(F.col("toks"), F.col("text")).alias("o")))).alias("i", "t")).select(
        "doc_id", "sent_idx", F.col("i").cast("long").alias("i"), F.col("t.toks").alias("token"),
        F.col("t.o.start").cast("long").alias("char_start"), F.col("t.o.end").cast("long").alias("char_end"))


def _responses(spark, sf):
    """Model answers as text: the triples of a window as JSON, in four shapes."""
    wins = extract.CueExtractor().attach(tb.document_windows(spark, sf))
    obj = lambda t: F.to_json(F.struct(
        F.upper(t["location_1"]).alias("location_1"), t["location_2"].alias("location_2"),
        F.concat(F.lit(" "), t["spatial_indicator"]).alias("spatial_indicator"),
        F.get(t["semantic_type"], 0).alias("semantic_type")))
    body = F.concat(F.lit('{"location_relations": ['), F.array_join(F.transform("location_relations", obj), ", "), F.lit("]}"))
    shape = F.pmod("window_id", F.lit(4))
    raw = F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone."))).when(
        shape == 2, F.replace(body, F.lit("location_relations"), F.lit("relations"))).otherwise("no answer")
    return wins.select("doc_id", "window_id", "sentence", raw.alias("response"))


def parse_responses(spark, sf):
    got = _responses(spark, sf).withColumn("location_relations", extract.parse_triples("response"))
    rows = extract.triple_rows(got, ["doc_id", "window_id"])
    return rows.select("doc_id", "window_id", "ord", "location_1", "location_2", "spatial_indicator",
                       F.array_join("semantic_type", ",").alias("semantic_type"))


def parse_and_validate(spark, sf):
    got = _responses(spark, sf).withColumn("location_relations", extract.parse_triples("response", accept_lists=True))
    rows = extract.valid_triples(extract.triple_rows(got, ["doc_id", "window_id", "sentence"]))
    rows = extract.first_of_equal_triples(rows, ["doc_id", "window_id"])
    return rows.select("doc_id", "window_id", "ord", "location_1", "location_2", "spatial_indicator",
                       F.array_join("semantic_type", ",").alias("semantic_type"))


def _raw_relations(spark, sf):
    """Raw relations with every defect the validator handles, one per order."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return o.select(
        k.alias("rid"),
        F.concat(F.lit(" "), tb.pick(tb.LINE_TYPES, k), F.lit(" ")).alias("relation_type"),
        F.when(F.pmod(k, F.lit(11)) == 0, "x").otherwise(F.col("o_orderpriority")).alias("entity_1"),
        tb.pick(["gpe", "LOC", "fac", "person"], k).alias("entity_1_type"),
        tb.pick(["Real", " fictional", "uncertain"], k).alias("entity_1_class"),
        F.when(F.pmod(k, F.lit(7)) == 0, "None").when(F.pmod(k, F.lit(13)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, F.lit(5)) == 0, F.lower(F.concat(F.lit(" "), F.col("o_orderpriority"))))
        .otherwise(F.concat(F.lit("Clerk "), F.col("o_custkey"))).alias("entity_2"),
        tb.pick(["LOC", "ORG"], k).alias("entity_2_type"), tb.pick(["real"], k).alias("entity_2_class"),
        F.when(F.pmod(k, F.lit(9)) == 0, "high").when(F.pmod(k, F.lit(10)) == 0, "-3")
        .otherwise((F.pmod(k, F.lit(150)) / 100).cast("string")).alias("confidence"),
        F.when(F.pmod(k, F.lit(6)) == 0, "far").otherwise(F.pmod(k, F.lit(90)).cast("string")).alias("distance_value"),
        tb.pick(["miles", "km", "m"], k).alias("distance_unit"))


def joint_validate(spark, sf):
    return extract.valid_relations(_raw_relations(spark, sf), 0.55)


def parse_joint(spark, sf):
    """The same relations as joint responses: plain, wrapped in prose, broken off, and under another key."""
    raw = _raw_relations(spark, sf)
    one = F.struct(*[c for c in raw.columns if c != "rid"])
    good = F.to_json(F.struct(F.array(one).alias("relations")))
    k = F.pmod("rid", F.lit(4))
    answer = (F.when(k == 0, good).when(k == 1, F.concat(F.lit("Here you are:\n"), good, F.lit("\nAnything else?")))
              .when(k == 2, F.substring(good, 1, 40)).otherwise(F.to_json(F.struct(F.array(one).alias("facts")))))
    return extract.joint_relations(raw.select("rid", answer.alias("answer")), "answer", 0.55)


# -- entities -------------------------------------------------------------------

def relation_candidates(spark, sf):
    rel = cut(tb.chunk_relations(spark, sf).drop("chunk_id", "sents"))  # names and ends read it, texts are read once
    out = en.remap(rel, en.chunk_names(rel))
    return out.select("doc_id", "chunk", F.col("ord").cast("long").alias("ord"), "relation_type", "entity_1",
                      "entity_2", "confidence")


def _scripted_client():
    """Stands in for a model: reads cues, hints classes and distances; slow once on every third length, dead on every 17th."""
    import json

    import regex
    scan = regex.compile(extract.scan_pattern())
    hint = lambda name: "real" if len(name) % 2 == 0 else "Fictional"

    def chat(system, user, temperature):
        if len(user) % 17 == 0:
            raise OSError("no answer")
        if len(user) % 3 == 0 and temperature < 0.12:
            raise TimeoutError("slow")
        facts = []
        for first, cue, second in scan.findall(user):
            kind = lx.CUE_RELATIONS.get(cue.lower())
            away = kind in ("near", "far")
            facts.append({"entity_1": first, "entity_1_type": "gpe", "entity_1_class": hint(first), "relation_type": kind,
                          "entity_2": second, "entity_2_type": "place", "entity_2_class": hint(second),
                          "confidence": 0.9 if " " in cue else 0.7, "distance_value": len(first) + len(second) if away else None,
                          "distance_unit": "km" if away else None})
        body = json.dumps({"relations": facts}, ensure_ascii=False)
        return body if len(user) % 2 else f"Sure:\n{body}\nAnything else?"

    return chat


def _asked(spark, sf):
    """Answers of a scripted model per chunk; only the text a call needs goes to the model, and none comes back."""
    chunks = segment.chunks(tb.sentence_arrays(spark, sf)).select("doc_id", F.col("window_id").alias("chunk"), "sentence")
    model = joint.RelationModel(_scripted_client, max_attempts=3, backoff=0.0)
    return model.attach(chunks).drop("sentence")


def joint_candidates(spark, sf):
    """Relations of a scripted model over all chunks, with class hints, confidence and distance."""
    valid = cut(joint.relation_rows(_asked(spark, sf), ["doc_id", "chunk"]))
    out = en.remap(valid, en.chunk_names(valid))
    return out.select("doc_id", "chunk", F.col("ord").cast("long").alias("ord"), "relation_type", "entity_1", "entity_1_type", "entity_1_class",
                      "entity_2", "entity_2_type", "entity_2_class", "confidence", "distance_value", "distance_unit")


def answer_log(spark, sf):
    return progress.answer_log(_asked(spark, sf))


def attempt_history(spark, sf):
    """Attempts of that model on each chunk; chunks that failed to the end are dead letters."""
    asked = _asked(spark, sf)
    last = F.element_at("attempts", -1)
    return asked.select("doc_id", "chunk", F.size("attempts").cast("long").alias("n_attempts"), F.round(last["temperature"], 2).alias("temperature"),
                        last["strict"].alias("strict"), F.col("_error").isNotNull().alias("failed"))


def entity_registry(spark, sf):
    return en.registry(en.chunk_entities(tb.chunk_relations(spark, sf)))


def mention_positions(spark, sf):
    m = en.mention_table(en.chunk_entities(tb.chunk_relations(spark, sf)))
    return m.select("canonical_name", "sentence_id", F.col("char_start").cast("long").alias("char_start"),
                    F.col("char_end").cast("long").alias("char_end"), "source_text")


def span_registry(spark, sf):
    return en.span_registry(en.capitalised_spans(segment.sentences(tb.sentence_arrays(spark, sf))))


def clustered_registry(spark, sf):
    """Capitalised runs as spans; the first two words of a sentence and the first of the next as a cluster."""
    sents = segment.sentences(tb.sentence_arrays(spark, sf)).withColumn("chunk", F.floor(F.col("sent_idx") / 6))
    spans = en.capitalised_spans(sents).select(
        "doc_id", F.floor(F.col("sent_idx") / 6).alias("chunk"), F.struct("sent_idx", "char_start").alias("pos"), "label", "surface",
        "sentence_id", "char_start", "char_end", F.col("surface").alias("source_text"))
    words = lambda n: F.regexp_extract("text", r"^\S+(?: \S+)?" if n == 2 else r"^\S+", 0)
    one = lambda n: F.struct((F.col("sent_idx") - (2 - n)).alias("cluster"), F.lit(2 - n).alias("pos"), words(n).alias("mention"),
                             F.lit(0).alias("char_start"), F.length(words(n)).alias("char_end"))
    clusters = sents.select("doc_id", "chunk", "sentence_id", F.inline(F.when(
        F.floor((F.col("sent_idx") - 1) / 6) == F.col("chunk"), F.array(one(2), one(1))).otherwise(F.array(one(2)))))  # one scan
    entities, _ = en.clustered_registry(spans, clusters)
    return entities


def _endpoints(spark, sf):
    t = tb.window_triples(spark, sf)
    return t.select(F.explode(F.array("location_1", "location_2")).alias("name"))


def canonical_resolve(spark, sf):
    keys = en.lookup_keys(tb.word_registry(spark, sf), "ord")
    return en.resolve(_endpoints(spark, sf), keys)


def match_mentions(spark, sf):
    mentions = _endpoints(spark, sf).select(F.col("name").alias("mention"))
    return en.match_mentions(mentions, tb.word_registry(spark, sf), "ord")


def coref_mentions(spark, sf):
    """Spans of a window whose words share a first letter stand for one cluster."""
    t = cut(tb.window_triples(spark, sf).drop("sentence", "semantic_type"))  # spans, matches and owners read it
    spans = t.select("doc_id", "window_id", "sentence_id", "ord", F.posexplode(
        F.array("location_1", "location_2")).alias("side", "mention"))
    bare = F.regexp_replace(F.lower("mention"), "^(the|an|a) ", "")
    clusters = spans.select(
        F.concat_ws("_", "doc_id", "window_id").alias("window"), F.substring(bare, 1, 1).alias("cluster"),
        (F.col("ord") * 2 + F.col("side")).alias("pos"), "mention", "sentence_id",
        F.col("ord").alias("char_start"), (F.col("ord") + F.length("mention")).alias("char_end"))
    existing = t.where(F.col("spatial_indicator") == "in").select(
        tx.canonical("location_2").alias("canonical_name"), "sentence_id")
    return en.propagate_coref(clusters, tb.word_registry(spark, sf), existing, "ord")


def classify_names(spark, sf):
    """Names put together from parts, customers' segments and place words."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    tails = ["", "City", " Island", " River", " Harbor", "'s", " 4", " Road", " & Co", "n", " Airport"]
    heads = ["", "Lake ", "the ", "Port ", "12th ", "New York", "West Egg", "Gatsby", "N.Y.", "São "]
    raw = F.concat(tb.pick(heads, k), F.when(F.pmod(k, F.lit(10)).isin(5, 6, 7, 8), "").otherwise(
        F.when(F.pmod(k, F.lit(3)) == 0, F.initcap("p_name")).otherwise(F.col("p_name"))),
        F.when(F.pmod(k, F.lit(10)).isin(5, 6, 7, 8), "").otherwise(tb.pick(tails, k)))
    name = tx.surface(raw)
    hint = tb.pick(["", "Real ", "FICTIONAL", "uncertain", "unknown"], F.col("p_size"))
    mentions = F.pmod(F.col("p_size"), F.lit(4))
    return p.select(
        "p_partkey", name.alias("name"), tx.canonical(raw).alias("canonical"),
        nm.entity_class(name, hint).alias("class_joint"), nm.entity_class_wide(name).alias("class_wide"),
        nm.scan_error(name).cast("int").alias("scan_error"), nm.not_a_place(name).cast("int").alias("not_a_place"),
        nm.plausible(name, mentions).cast("int").alias("plausible"))


# -- relations and constraints ----------------------------------------------------

def relation_dedup(spark, sf):
    best = rl.dedup(tb.geo_relations(spark, sf), ["rel_ord", "relation_id"])
    return best.select("relation_id", "relation_type", "entity_1", "entity_2", "confidence",
                       F.col("first_seen.rel_ord").alias("first_seen"))


def graph_commit(spark, sf):
    ents = tb.geo_entities(spark, sf)
    mapping = ents.select("name", F.col("canonical_name").alias("canonical"))
    out = rl.commit(tb.geo_relations(spark, sf), mapping, rl.quality(ents), ["rel_ord", "relation_id"])
    return out.select("relation_id", "relation_type", "entity_1", "entity_2", "weight",
                      F.round("uncertainty", 3).alias("uncertainty"), "distance_value", "distance_unit")


def counts_by_type(spark, sf):
    rel = tb.geo_relations(spark, sf)
    return rel.groupBy("relation_type", "extraction_method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation_type")


def project_km(spark, sf):
    e = cn.with_km(tb.geo_entities(spark, sf), cn.Settings()).where(F.col("x_km").isNotNull())
    lat, lon = geo.unproject(F.col("x_km"), F.col("y_km"), LAT0, LON0)
    return e.select("entity_id", r4("x_km").alias("x"), r4("y_km").alias("y"), r4(lat).alias("lat"), r4(lon).alias("lon"))


def bounding_box(spark, sf):
    fixed = cn.fixed_entities(tb.geo_entities(spark, sf))
    near = cn.start_box(fixed, 300.0)
    every = cn.bounding_box(fixed)
    return every.select(F.lit("all").alias("box"), *map(r4_named, every.columns)).unionByName(
        near.select(F.lit("near").alias("box"), *map(r4_named, near.columns)))


def r4_named(c):
    return F.round(F.col(c), 4).alias(c)


def geo_edges(spark, sf):
    real = rl.located_enough(tb.geo_entities(spark, sf))
    e = rl.real_edges(rl.related_real_pairs(tb.geo_relations(spark, sf), real))
    return e.select("relation_type", "entity_1", "entity_2", "direction", "distance_value", "distance_unit",
                    "weight", "uncertainty", "source_text", "extraction_method")


def anchor_edges(spark, sf):
    ents = tb.geo_entities(spark, sf)
    e = rl.anchor_edges(tb.geo_relations(spark, sf), ents, rl.located_enough(ents))
    return e.select("relation_type", "entity_1", "entity_2", "distance_value", "weight", "uncertainty", "source_text")


def augmented_counts(spark, sf):
    rel, ents = tb.geo_relations(spark, sf), tb.geo_entities(spark, sf)
    real = rl.located_enough(ents)
    keep = ["relation_type", "entity_1", "entity_2", "weight", "extraction_method"]
    every = rl.without_generated(rel).select(keep).unionByName(
        rl.real_edges(rl.related_real_pairs(rel, real)).select(keep)).unionByName(
        rl.anchor_edges(rel, ents, real).select(keep))
    return every.groupBy("extraction_method", "relation_type").agg(
        F.count(F.lit(1)).alias("n"), r4(F.sum("weight")).alias("weight"))


def _specs(spark, sf):
    return cn.specs(tb.geo_relations(spark, sf), tb.geo_entities(spark, sf))


def _admitted(spark, sf, positions=None):
    """The same constraints without their ids."""
    return cn.admitted(tb.geo_relations(spark, sf), tb.geo_entities(spark, sf), positions=positions)


def constraint_specs(spark, sf):
    c = _specs(spark, sf)
    return c.select("constraint_id", "type", "e1", "e2", "weight", "source_relation_id",
                    *[r4(p).alias(p) for p in cn.PARAMS])


def constraint_prune(spark, sf):
    narrow = cut(_admitted(spark, sf).select("rel_ord", "source_relation_id", "type", "e1", "e2"))
    specs = cut(cn.numbered(narrow).select("constraint_id", "type", "e1", "e2"))  # counted and filtered
    latent, kept = cn.prune(cn.latent_entities(tb.geo_entities(spark, sf)), specs, 12)
    return latent.select(F.lit("latent").alias("part"), F.col("entity_id").alias("id")).unionByName(
        kept.select(F.lit("constraint"), F.col("constraint_id")).toDF("part", "id"))


def underconstrained(spark, sf):
    return cn.underconstrained(cn.latent_entities(tb.geo_entities(spark, sf)), _admitted(spark, sf), 12)


def _positions(spark, sf):
    """Fixed entities where they are, latent ones on a lattice by customer number."""
    ents = tb.geo_entities(spark, sf)
    n = F.regexp_extract("entity_id", r"(\d+)", 1).cast("long")
    free = cn.latent_entities(ents).select("entity_id", (F.pmod(n * 7, F.lit(120)) - 60).cast("double").alias("x"),
                                           (F.pmod(n * 11, F.lit(90)) - 45).cast("double").alias("y"))
    return cn.fixed_entities(ents).select("entity_id", "x", "y").unionByName(free)


def penalties(spark, sf):
    # all constraints are numbered, those without an energy, too; only these few columns are shuffled for it
    every = _admitted(spark, sf, _positions(spark, sf))
    e = cn.energies_at(every, all_rows=True).select("rel_ord", "source_relation_id", "type", "penalty", "energy", "evaluated")
    return cn.numbered(cut(e)).where("evaluated").select(
        "constraint_id", "type", half_up("penalty").alias("penalty"), half_up("energy").alias("energy"))


def total_energy(spark, sf):
    e = cn.energies_at(_admitted(spark, sf, _positions(spark, sf)))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 2).alias("energy"))


def constraint_graph(spark, sf):
    """Undirected plot edges: one per pair, the last constraint wins."""
    c = _admitted(spark, sf).where(F.col("e2").isNotNull())
    pair = c.groupBy(F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b"))
    last = pair.agg(F.max_by(F.struct("type", "weight"), F.struct("rel_ord", "source_relation_id")).alias("l"))  # as their ids
    return last.select("a", "b", F.col("l.type").alias("type"),
                       F.greatest(F.lit(1), F.floor(F.col("l.weight") * 8)).cast("long").alias("width"))


def constraint_lines(spark, sf):
    return writers.constraint_plot_lines(constraint_graph(spark, sf)).select("line")


# -- grounding ---------------------------------------------------------------------

def _gazetteer(spark, sf):
    """Fifteen candidates per supplier, one per customer, ranked by number."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.format_string("Supplier#%09d", F.floor(k / 15)).alias("name"), F.pmod(k, F.lit(15)).alias("rank"),
        ((F.pmod(k * 37, F.lit(1600)) - 800) / 10.0).alias("lat"), ((F.pmod(k * 91, F.lit(3500)) - 1750) / 10.0).alias("lon"),
        F.concat_ws(", ", "c_mktsegment", F.when(F.pmod(k, F.lit(4)) == 1, "United States").otherwise("Elsewhere")).alias("display_name"))


def geocode_rules(spark, sf):
    out = grounding.disambiguate(_gazetteer(spark, sf), ["name"], "US")
    plain = grounding.disambiguate(_gazetteer(spark, sf), ["name"]).select(
        "name", F.col("lat").alias("lat_first"), F.col("confidence").alias("conf_first"))
    return out.join(plain, "name")


def grounding_fold(spark, sf):
    ents = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("canonical_name"),
        F.when(F.pmod("s_suppkey", F.lit(17)) == 5, "fictional").otherwise("uncertain").alias("type"))
    g = grounding.ground(ents, _gazetteer(spark, sf))
    return g.select("ord", "canonical_name", "type", "latitude", "longitude", "confidence")


# -- diagnostics ---------------------------------------------------------------------

def posterior_moments(spark, sf):
    m = dg.moments(tb.draws(spark, sf))
    return m.select("entity_id", "n", *[r4(c).alias(c) for c in ("mean_x", "mean_y", "std_x", "std_y")])


def credible_ellipse(spark, sf):
    e = dg.ellipse(tb.draws(spark, sf))
    return e.select("entity_id", *[r4(c).alias(c) for c in ("semi_major", "semi_minor", "angle_deg", "center_x", "center_y")])


def spatial_entropy(spark, sf):
    return dg.entropy(tb.draws(spark, sf)).select("entity_id", r4("spatial_entropy").alias("spatial_entropy"))


def density_grid(spark, sf):
    return dg.density(tb.draws(spark, sf))


def smoothed_grid(spark, sf):
    return dg.smoothed(tb.draws(spark, sf)).select("entity_id", "cell_x", "cell_y", F.round("mass", 6).alias("mass"))


def contour_levels(spark, sf):
    return dg.contour_levels(dg.smoothed(tb.draws(spark, sf))).select("entity_id", "share", F.round("level", 6).alias("level"), "n_cells")


def gelman_rubin(spark, sf):
    return dg.r_hat(tb.draws(spark, sf)).select("entity_id", r4("r_hat_x").alias("r_hat_x"), r4("r_hat_y").alias("r_hat_y"))


def ess(spark, sf):
    e = dg.effective_sample_size(tb.draws(spark, sf))
    return e.select("entity_id", r4("ess_x").alias("ess_x"), r4("ess_y").alias("ess_y"))


def _scores(spark, sf, evaluable_only=False):
    return dg.satisfaction_per_sample(
        tb.part_constraints(spark, sf), tb.nation_points(spark, sf), tb.draws(spark, sf), evaluable_only)


def constraint_satisfaction(spark, sf):
    return _scores(spark, sf).select("sample_id", r4("score").alias("score"))


def satisfaction_summary(spark, sf):
    row = lambda kind, only: dg.satisfaction(_scores(spark, sf, only)).select(
        F.lit(kind).alias("kind"), r4("constraint_satisfaction_mean").alias("mean"), r4("constraint_satisfaction_std").alias("std"))
    return row("as-is", False).unionByName(row("evaluable", True))


def thin_burnin(spark, sf):
    d = dg.thinned(tb.draws(spark, sf).withColumn("sample_id", F.floor(F.col("sample_id") / 4)), 5, 20)
    return d.groupBy("chain_id", "sample_id").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("x")).alias("x"))


def evenly_spaced(spark, sf):
    d = dg.evenly_spaced(tb.draws(spark, sf), 50)
    return d.select("sample_id", "entity_id", r4("x").alias("x"), r4("y").alias("y"))


def ensemble_lines(spark, sf):
    d = dg.evenly_spaced(tb.draws(spark, sf), 50)
    lines = dg.ensemble_lines(d, tb.part_constraints(spark, sf), tb.nation_points(spark, sf), 20)
    return lines.select("sample_id", "constraint_id", "type", *[r4(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def map_overlay(spark, sf):
    m = dg.moments(tb.draws(spark, sf))
    lat, lon = geo.unproject(F.col("mean_x"), F.col("mean_y"), LAT0, LON0)
    return m.select("entity_id", r4(lat).alias("lat"), r4(lon).alias("lon"),
                    r4(F.hypot("std_x", "std_y")).alias("uncertainty_km"))


def mode_count(spark, sf):
    return dg.mode_count(tb.draws(spark, sf))


def posterior_summary(spark, sf):
    d = tb.draws(spark, sf)
    names = d.select("entity_id", F.concat(F.lit("Point "), "entity_id").alias("name")).distinct()
    return dg.posterior_summary(d, names, _scores(spark, sf))


# -- sampling ------------------------------------------------------------------------

SWEEPS, BURN_IN, THIN = 200, 50, 5  # as flows.infer without a configuration


def _model(spark, sf):
    ents = tb.geo_entities(spark, sf)
    energy = _admitted(spark, sf).where(F.col("type").isin(cn.INFERABLE)).select("type", "e1", "e2", "weight", *cn.PARAMS)  # all that counts here
    latent, kept = cn.prune(cn.latent_entities(ents), cut(energy))
    return kept, latent, cn.fixed_entities(ents)


def metropolis(spark, sf):
    """Four chains over every customer, with the sweeps and burn-in that the flow has by default."""
    return sm.metropolis(*_model(spark, sf), sm.Settings(sweeps=SWEEPS, burn_in=BURN_IN, thin=THIN, radius=300.0))


def geocode_cache(spark, sf):
    """Two runs write their answers, misses included; then all names ask what the cache knows."""
    e = tb.geo_entities(spark, sf).select(F.lower("canonical_name").alias("key"), F.col("ord").alias("k"), "latitude", "longitude", "type")
    memory = CacheTable(spark, os.path.join(shared_dir(spark), "cache", uuid.uuid4().hex))
    conf = lambda c: F.when(F.col("latitude").isNotNull(), F.lit(c)).alias("confidence")
    real = e.where(F.col("type") == "real")
    memory.upsert(real.select("key", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), conf(0.6), F.lit(10).alias("seen")))
    memory.upsert(real.where(F.col("k") % 3 == 0).select("key", (F.col("latitude") + 1).alias("lat"), F.col("longitude").alias("lon"), conf(0.85),
                                                         F.lit(20).alias("seen")))
    return memory.status(e.select("key"), 15).select("key", "state", r4("lat").alias("lat"), r4("lon").alias("lon"), "confidence", "seen")


def _first_sweep(spark, sf):
    return sm.transition(*_model(spark, sf), sm.Settings(radius=300.0))


def transition(spark, sf):
    """Positions of every customer in every chain after one sweep from the starting positions."""
    last = _first_sweep(spark, sf).last
    return last.select("entity_id", (F.col("moved") > 0).alias("moves"), F.posexplode(F.arrays_zip("x", "y")).alias("chain_id", "p")).select(
        "entity_id", "moves", "chain_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def acceptance(spark, sf):
    """Proposals and acceptance of each chain in that sweep."""
    w = _first_sweep(spark, sf).windows
    return w.select("chain_id", "round", "first_sweep", "sweeps", "tried", "won", r4("rate").alias("rate"), "proposal_std")


def sample_energies(spark, sf):
    """Energy of every draw under the constraints of the parts."""
    d = tb.draws(spark, sf)
    e = sm.sample_energies(tb.part_constraints(spark, sf), d.select("entity_id").distinct(), tb.nation_points(spark, sf), d)
    return e.select("sample_id", F.round("energy", 2).alias("energy"))


# -- scoring ---------------------------------------------------------------------------

def _matched(spark, sf, scheme, answers=None):
    gold, preds = answers or tb.gold_and_pred(spark, sf)
    out = None
    for model, pred in preds.items():
        m = scoring.matched(scoring.paired(gold, pred), scheme).withColumn("model", F.lit(model))
        out = m if out is None else out.unionByName(m)
    return out


def _score(scheme):
    def run(spark, sf):
        s = scoring.overall(_matched(spark, sf, scheme), ["model"])
        return s.select("model", "tp", "fp", "fn", "n_predictions", r4("precision").alias("precision"),
                        r4("recall").alias("recall"), r4("f1").alias("f1"))
    return run


def score_per_type(spark, sf):
    s = scoring.per_type(_matched(spark, sf, "lenient"), ["model"])
    return s.select("model", "semantic_type", "tp", "fp", "fn", r4("precision").alias("precision"),
                    r4("recall").alias("recall"), r4("f1").alias("f1"))


def score_outcomes(spark, sf):
    return scoring.outcomes(_matched(spark, sf, "lenient"), ["model"])


def score_markdown(spark, sf):
    both, answers = None, tb.gold_and_pred(spark, sf)  # either scheme reads the same answers
    for scheme in ("strict", "lenient"):
        s = scoring.overall(_matched(spark, sf, scheme, answers), ["model"]).withColumn("scheme", F.lit(scheme))
        both = s if both is None else both.unionByName(s)
    return scoring.markdown(both)


def type_markdown(spark, sf):
    return scoring.markdown_per_type(scoring.per_type(_matched(spark, sf, "lenient"), ["model"]))


# -- progress ----------------------------------------------------------------------------

def progress_counts(spark, sf):
    return progress.counts(table(spark, sf, "events"))


def recent_feed(spark, sf):
    return progress.recent(table(spark, sf, "events"), 8, ["ts", "event_id"]).select("event_id", "event_type", "value")


def rolling_eta(spark, sf):
    e = progress.eta(table(spark, sf, "events"), relation_type="purchase")
    return e.select("total", "done", "errors", "relations", r4("avg_s").alias("avg_s"), r4("rate_min").alias("rate_min"),
                    F.round("eta_s", 2).alias("eta_s"), "eta", "projected")


def window_stats(spark, sf):
    return progress.window_stats(extract.CueExtractor().attach(tb.document_windows(spark, sf)))


def resume_pending(spark, sf):
    wins = tb.document_windows(spark, sf).select("doc_id", "window_id")
    done = wins.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return extract.pending(wins, done, ["doc_id", "window_id"])


QUERIES = {
    "p15_span_to_sentence": span_to_sentence,
    "p14_token_offsets": token_offsets,
    "x01_parse_responses": parse_responses,
    "x02_parse_and_validate": parse_and_validate,
    "f06_joint_validate": joint_validate,
    "x03_parse_joint": parse_joint,
    "d04_relation_candidates": relation_candidates,
    "a06_entity_registry": entity_registry,
    "i11_joint_candidates": joint_candidates,
    "i12_attempt_history": attempt_history,
    "s28_answer_log": answer_log,
    "j08_mention_positions": mention_positions,
    "i10_span_registry": span_registry,
    "i10_clustered_registry": clustered_registry,
    "m11_canonical_resolve": canonical_resolve,
    "m12_match_mentions": match_mentions,
    "i09_coref_mentions": coref_mentions,
    "m09_classify_names": classify_names,
    "a08_relation_dedup": relation_dedup,
    "i13_graph_commit": graph_commit,
    "a09_counts_by_type": counts_by_type,
    "g01_project_km": project_km,
    "a20_bounding_box": bounding_box,
    "g17_geo_edges": geo_edges,
    "g18_anchor_edges": anchor_edges,
    "u01_augmented_counts": augmented_counts,
    "m14_constraint_specs": constraint_specs,
    "f15_constraint_prune": constraint_prune,
    "a22_underconstrained": underconstrained,
    "g05_penalties": penalties,
    "a23_total_energy": total_energy,
    "v01_constraint_graph": constraint_graph,
    "v01_constraint_lines": constraint_lines,
    "d12_geocode_rules": geocode_rules,
    "s26_geocode_cache": geocode_cache,
    "i08_grounding_fold": grounding_fold,
    "a13_posterior_moments": posterior_moments,
    "a14_credible_ellipse": credible_ellipse,
    "a15_spatial_entropy": spatial_entropy,
    "v02_density_grid": density_grid,
    "v02_smoothed_grid": smoothed_grid,
    "v02_contour_levels": contour_levels,
    "a16_gelman_rubin": gelman_rubin,
    "a17_effective_sample_size": ess,
    "a18_constraint_satisfaction": constraint_satisfaction,
    "a18_satisfaction_summary": satisfaction_summary,
    "d11_thin_burnin": thin_burnin,
    "d10_evenly_spaced": evenly_spaced,
    "v03_map_overlay": map_overlay,
    "v04_ensemble_lines": ensemble_lines,
    "a19_mode_count": mode_count,
    "j12_posterior_summary": posterior_summary,
    "i07_sample_energies": sample_energies,
    "i03_metropolis": metropolis,
    "i03_transition": transition,
    "a24_acceptance_windows": acceptance,
    "a10_score_strict": _score("strict"),
    "a10_score_lenient": _score("lenient"),
    "a11_score_per_type": score_per_type,
    "a12_score_outcomes": score_outcomes,
    "s21_score_markdown": score_markdown,
    "s21_type_markdown": type_markdown,
    "t04_progress_counts": progress_counts,
    "d08_recent_feed": recent_feed,
    "d09_rolling_eta": rolling_eta,
    "a25_window_stats": window_stats,
    "f16_resume_pending": resume_pending,
}
