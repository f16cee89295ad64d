"""End-to-end flows: prose -> spatial graph, and relations -> posterior map.

Each stage reads the folders of earlier stages and writes its own; a stage whose
output exists is skipped unless forced.
"""

from __future__ import annotations

import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, lexicon as lx
from ..functions.names import FICTIONAL
from ..functions.text import drop_leading_the, slug
from ..operators import (constraints as cn, diagnostics as dg, entities as en, extract, graph, grounding,
                         joint as jt, progress, relations as rl, sampling as sm, segment)
from ..operators.ordering import with_global_position
from ..session import cut, scratch
from ..sources import readers, writers
from ..sources.cache import CacheTable

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# -- prose -> graph -----------------------------------------------------------

def ingest(spark: SparkSession, source: str, cleaned: str, doc_id: str | None = None) -> str:
    """Clean and segment text files into a sentence table (JSON lines)."""
    texts = readers.read_texts(spark, source)
    if doc_id:
        texts = texts.withColumn("doc_id", F.lit(doc_id))
    arrays = segment.sentence_arrays(segment.clean_documents(texts))
    writers.write_jsonl(segment.sentences(arrays).select("doc_id", "sentence_id", "text"), cleaned)
    return cleaned


def sentence_windows(sents: DataFrame, size: int, stride: int, partial_tail: bool = False) -> DataFrame:
    w = segment.windows_rows(sents, "doc_id", "sent_idx", "text", size, stride, partial_tail, not partial_tail)
    ids = F.transform("members", lambda i: segment.sentence_id(F.col("doc_id"), i))
    return w.withColumn("sentence_ids", ids).drop("members")


def extract_windows(spark: SparkSession, corpus: str, out: str, window: int = 3, stride: int = 3, min_chars: int = 20,
                    limit: int = 0, resume: bool = False, extractor=None) -> str:
    """Windows of a sentence table -> window records with their triples."""
    wins = sentence_windows(readers.read_sentences(spark, corpus, min_chars), window, stride)
    if limit:
        wins = wins.orderBy("doc_id", "window_id").limit(limit)
    if resume and exists(spark, out):
        wins = extract.pending(wins, readers.read_done(spark, out), ["doc_id", "window_id"])
    found = (extractor or extract.CueExtractor()).attach(wins).drop("sents")
    if resume:
        found.write.mode("append").option("ignoreNullFields", False).json(out)
    else:
        writers.write_jsonl(found, out)
    return out


def build_graph(spark: SparkSession, relations: str, out_dir: str, name: str, top_k: int = 10, lexicon: str | None = None,
                tag: bool = True, svg: bool = False, title: str | None = None) -> dict:
    """Relations file -> GraphML, DOT and HTML parts plus the summary report."""
    edges = cut(graph.edges(readers.read_relations(spark, relations), lx.load(lexicon)))
    nodes = cut(graph.nodes(edges, tag))
    base = os.path.join(out_dir, name)
    writers.write_lines(writers.graphml_lines(nodes, edges), base + ".graphml")
    writers.write_lines(writers.dot_lines(nodes, edges), base + ".dot")
    writers.write_lines(writers.html_lines(nodes, edges, title or f"Spatial graph: {os.path.basename(relations)}"), base + ".html")
    report = writers.summary_dict(graph.summary(edges), graph.top_connected(nodes, top_k))
    if not tag:
        report["entity_kind_distribution"] = {graph.NONE: report["nodes"]}
    writers.write_small_json(report, base + ".summary.json")
    if svg:
        # Graphviz wants one file: join the parts while the folder is local
        parts = sorted(f for f in os.listdir(base + ".dot") if f.startswith("part-"))
        with open(base + ".joined.dot", "w", encoding="utf-8") as one:
            for part in parts:
                with open(os.path.join(base + ".dot", part), encoding="utf-8") as lines:
                    for line in lines:
                        one.write(line)
        writers.render_svg(base + ".joined.dot", base + ".svg")
    return report


# -- relations -> posterior -----------------------------------------------------

class Run:
    """Paths and settings of one staged run."""

    def __init__(self, spark: SparkSession, cfg: dict, force: bool = False, extractor=None):
        self.spark, self.cfg, self.force = spark, cfg, force
        self.extractor = extractor or extract.CueExtractor()
        self.data = cfg.get("data_dir", "data")
        self.fictional = sorted(set(FICTIONAL) | set(cfg.get("ner", {}).get("fictional_overrides", [])))
        c = cfg.get("constraints", {})
        self.settings = cn.Settings(
            c.get("projection_origin_lat", 40.7128), c.get("projection_origin_lon", -74.0060), c.get("epsilon_direction_km", 1.0),
            c.get("d_near_km", 10.0), c.get("d_far_km", 50.0), c.get("sigma_distance_km", 5.0),
            c.get("co_occurrence_weight", 0.1), c.get("min_constraints_per_latent", 1))

    def path(self, name: str) -> str:
        return os.path.join(self.data, name)

    def load(self, name: str) -> DataFrame:
        return readers._existing(lambda: self.spark.read.parquet(self.path(name)), self.path(name))

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    def wanted(self, *names: str) -> bool:
        if self.force or not all(exists(self.spark, self.path(n)) for n in names):
            return True
        log.info("%s exists, skipped", names)
        return False


def clean(r: Run) -> None:
    if not r.wanted("sentences"):
        return
    texts = readers.read_texts(r.spark, r.cfg["corpus"]["raw_dir"], replace=True)
    texts = texts.withColumn("doc_id", drop_leading_the(slug("doc_id")))
    only = r.cfg["corpus"].get("doc_filter") or []
    if only:
        texts = texts.where(F.col("doc_id").isin(only))
    arrays = segment.sentence_arrays(segment.clean_documents(texts, ellipsis=False), dedup=None)
    rows = segment.first_of_repeats_rows(segment.sentences(arrays), "doc_id", "sent_idx", "text")
    r.save("sentences", rows)
    r.save("metadata", r.load("sentences").groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_sentences")))


CHUNK = ["doc_id", "window_id"]


def _model_answers(r: Run, chunks: DataFrame) -> DataFrame:
    """Answers of all runs so far, after this run has asked for what is outstanding; dead letters go to ``failed_chunks``."""
    path, run = r.path("joint_answers"), 0
    todo = chunks
    if exists(r.spark, path):
        before = r.load("joint_answers")
        run = 1 + (before.agg(F.max("run")).first()[0] or 0)
        todo = jt.outstanding(chunks, before, CHUNK)
    asked = r.extractor.attach(todo).select(*CHUNK, "relations", "attempts", "_error")
    asked.write.mode("append").parquet(f"{path}/run={run}")
    answers = r.load("joint_answers")
    r.save("failed_chunks", jt.dead_letters(answers, CHUNK))
    r.save("answer_log", progress.answer_log(jt.latest(answers, CHUNK)))
    return jt.latest(answers.where(F.col("_error").isNull()), CHUNK)


def joint(r: Run) -> None:
    asks = isinstance(r.extractor, jt.RelationModel)
    left = asks and exists(r.spark, r.path("failed_chunks")) and not r.load("failed_chunks").isEmpty()
    if not left and not r.wanted("entities", "candidates"):
        return
    m = r.cfg.get("relations", {}).get("model", {})
    size, overlap, least = m.get("sentences_per_chunk", 6), m.get("chunk_overlap", 2), m.get("min_confidence", 0.55)
    chunks = sentence_windows(r.load("sentences"), size, max(1, size - overlap), partial_tail=True)
    if asks:
        chunks = cut(chunks)
        answers = _model_answers(r, chunks).join(chunks.select(*CHUNK, "sents"), CHUNK)
        valid = jt.relation_rows(answers.withColumnRenamed("window_id", "chunk"), ["doc_id", "chunk", "sents"], least)
    else:
        valid = extract.valid_relations(_cue_relations(r, chunks), least)
    valid = cut(valid)
    found = cut(en.chunk_entities(valid))
    entities = en.registry(found, r.fictional).withColumn("name", F.col("canonical_name"))
    r.save("entities", entities.withColumn("ord", F.regexp_extract("entity_id", r"(\d+)", 1).cast("long")))
    r.save("mentions", en.mention_table(found))
    r.save("candidates", en.remap(valid, found))


def _cue_relations(r: Run, chunks: DataFrame) -> DataFrame:
    """Relations typed by the cue words between two spans."""
    rows = extract.triple_rows(r.extractor.attach(chunks), ["doc_id", "window_id", "sents"])
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.col("window_id").alias("chunk"), "ord", "sents",
        lx.relation_of(F.col("spatial_indicator")).alias("relation_type"),
        F.col("location_1").alias("entity_1"), F.col("location_2").alias("entity_2"),
        *[none.alias(f"entity_{n}_{k}") for n in (1, 2) for k in ("type", "class")],
        F.when(F.contains("spatial_indicator", F.lit(" ")), "0.9").otherwise("0.7").alias("confidence"),
        none.alias("distance_value"), none.alias("distance_unit"))


def annotated(r: Run) -> None:
    """Registry out of an annotator's tables ``spans`` and, if there, ``span_clusters``: entities and mentions of their own."""
    if not exists(r.spark, r.path("spans")):
        log.info("no annotated spans, skipped")
        return
    if not r.wanted("span_entities", "span_mentions"):
        return
    n = r.cfg.get("ner", {})
    spans = r.load("spans")
    none = "doc_id string, chunk long, cluster int, pos long, mention string, sentence_id string, char_start int, char_end int"
    clusters = r.load("span_clusters") if exists(r.spark, r.path("span_clusters")) else r.spark.createDataFrame([], none)
    entities, mentions = en.clustered_registry(spans, clusters, tuple(n.get("entity_types", ["GPE", "LOC", "FAC"])), n.get("min_mention_count", 2),
                                               n.get("entity_blocklist", []), r.fictional)
    r.save("span_entities", entities)
    r.save("span_mentions", mentions)


def coref(r: Run) -> None:
    """Clusters of an annotator, written to ``coref_clusters``, extend the mentions."""
    if not exists(r.spark, r.path("coref_clusters")):
        log.info("no coreference clusters, skipped")
        return
    base = cut(en.without_coref(r.load("mentions")))
    fresh = en.propagate_coref(r.load("coref_clusters"), r.load("entities"), base, "ord")
    both = cut(base.unionByName(fresh.select(base.columns)))
    r.save("mentions", both)
    counts = both.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("mention_count"))
    r.save("entities", cut(r.load("entities").drop("mention_count").join(counts, "canonical_name")))


def ground(r: Run) -> None:
    if not r.wanted("grounded"):
        return
    g = r.cfg.get("grounding", {})
    shape = "name string, rank int, lat double, lon double, display_name string"
    places = readers.read_jsonl(r.spark, g["gazetteer"], shape, ["name", "lat", "lon"])
    extra = {k: (v["lat"], v["lon"], v.get("confidence", 0.9)) for k, v in g.get("coordinate_overrides", {}).items()}
    memory = CacheTable(r.spark, r.path("geocode_cache"))
    ents, now = r.load("entities"), int(time.time())
    oldest = now - g["retry_misses_after_s"] if g.get("retry_misses_after_s") is not None else None
    keys = ents.select(F.lower("canonical_name").alias("key")).distinct()
    known = cut(memory.status(keys, oldest))
    hits = known.where(F.col("state").isin("hit", "miss"))
    asked = known.where(~F.col("state").isin("hit", "miss")).select("key")
    r.save("grounded", grounding.ground(ents, places, hits.select("key", *memory.names), g.get("default_country_bias", "US"),
                                        fictional=r.fictional, overrides=extra))
    # what this run looked up: named places that no override and no remembered answer settled
    new = r.load("grounded").join(ents.select("canonical_name", F.col("type").alias("_was")), "canonical_name").where(
        (F.col("_was") != "fictional") & ~F.col("canonical_name").isin(r.fictional) & ~F.col("canonical_name").isin([*grounding.OVERRIDES, *extra]))
    looked = new.withColumn("key", F.lower("canonical_name")).join(asked, "key", "left_semi")
    memory.upsert(looked.select("key", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "confidence", F.lit(now).alias("seen")))
    log.info("%d names looked up", looked.count())


def relate(r: Run) -> None:
    if not r.wanted("relations"):
        return
    ents, cand = r.load("grounded"), r.load("candidates")
    names = cand.select(F.explode(F.array("entity_1", "entity_2")).alias("name")).where(F.col("name").isNotNull())
    mapping = cut(en.resolve(names, en.lookup_keys(ents, "ord")))
    good = rl.quality(ents, r.fictional)
    out = rl.commit(cand, mapping, good, ["doc_id", "chunk", "ord"])
    r.save("text_relations", out.drop("first_seen").withColumn("extraction_method", F.lit("model")))
    text = r.load("text_relations")
    edges = r.cfg.get("relations", {}).get("geographic_edges", {})
    real = rl.located_enough(ents, edges.get("min_mentions", 2))
    keep = ["relation_type", "entity_1", "entity_2", "distance_value", "distance_unit", "weight", "uncertainty", "extraction_method"]
    made = rl.real_edges(rl.related_real_pairs(text, real), edges.get("weight", 0.95)).select(keep).unionByName(
        rl.anchor_edges(text, ents, real, edges.get("anchor_radius_km", 50.0)).select(keep))
    every = text.select(keep).unionByName(made)
    ident = F.concat_ws("|", "extraction_method", "entity_1", "relation_type", F.coalesce("entity_2", F.lit("")))
    every = cut(every.withColumn("relation_id", ident).withColumn(
        "_made", (F.col("extraction_method") != "model").cast("int")))
    r.save("relations", with_global_position(every, ["_made", "relation_id"], "rel_ord").drop("_made"))


def constrain(r: Run) -> None:
    if not r.wanted("constraints", "latent", "fixed"):
        return
    ents = r.load("grounded")
    spec = cut(cn.specs(r.load("relations"), ents, r.settings))
    latent, kept = cn.prune(cn.latent_entities(ents), spec, r.settings.min_constraints)
    r.save("fixed", cn.fixed_entities(ents, r.settings))
    r.save("latent", latent)
    r.save("constraints", kept)
    writers.write_model(r.load("fixed"), r.load("latent"), r.load("constraints"), r.path("model"),
                        (r.settings.origin_lat, r.settings.origin_lon))


def infer(r: Run) -> None:
    if not r.wanted("samples"):
        return
    i = r.cfg.get("inference", {})
    s = sm.Settings(i.get("sweeps", i.get("num_samples", 200)), i.get("burn_in", 50), i.get("thin", 5), i.get("beta", 1.0), i.get("proposal_std_km", 10.0),
                    i.get("num_chains", 4), i.get("num_walkers", 32), i.get("random_seed", 42), i.get("init_bbox_radius_km", 500.0))
    model = r.load("constraints"), r.load("latent"), r.load("fixed")
    if i.get("method", "metropolis") == "metropolis":
        walk = sm.walk(*model, s)
        draws = walk.draws
        r.save("acceptance", walk.windows)
    else:
        draws = sm.infer(i["method"], *model, s)
    draws.write.mode("overwrite").partitionBy("chain_id").parquet(r.path("samples"))


def diagnose(r: Run) -> None:
    if not r.wanted("posterior"):
        return
    draws = r.load("samples")
    subset = r.cfg.get("diagnostics", {}).get("scored_samples")  # all, unless the configuration asks for fewer
    scores = dg.satisfaction_per_sample(r.load("constraints"), r.load("fixed"), draws if not subset else dg.every_kth(draws, subset))
    r.save("posterior", dg.posterior_summary(draws, r.load("latent"), cut(scores)))


def visualise(r: Run) -> None:
    """Data behind the plots: density grids, map overlay, ensemble draws, constraint graph."""
    if not r.wanted("plots/density"):
        return
    draws, s = r.load("samples"), r.settings
    r.save("plots/density", dg.density(draws, r.cfg.get("visualization", {}).get("heatmap_resolution", 100)))
    lat, lon = geo.unproject(F.col("mean_x"), F.col("mean_y"), s.origin_lat, s.origin_lon)
    r.save("plots/overlay", r.load("posterior").withColumn("lat", lat).withColumn("lon", lon).withColumn(
        "uncertainty_km", F.hypot("std_x", "std_y")))
    grid = cut(dg.smoothed(draws, r.cfg.get("visualization", {}).get("density_resolution", 20)))
    r.save("plots/smoothed", grid)
    r.save("plots/contours", dg.contour_levels(grid))
    some = cut(dg.evenly_spaced(draws, r.cfg.get("visualization", {}).get("ensemble_num_samples", 50)))
    r.save("plots/ensemble", some)
    r.save("plots/ensemble_lines", dg.ensemble_lines(some, r.load("constraints"), r.load("fixed")))
    pairs = r.load("constraints").where(F.col("e2").isNotNull()).groupBy(
        F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b")).agg(
        F.max_by(F.struct("type", "weight"), F.struct(F.length("constraint_id"), F.col("constraint_id"))).alias("l"))
    pairs = pairs.select("a", "b", "l.type", F.greatest(F.lit(1), F.floor(F.col("l.weight") * 8)).alias("width"))
    writers.write_lines(writers.constraint_plot_lines(pairs), r.path("plots/constraints.dot"))


STAGES = [("cleaning", clean), ("joint extraction", joint), ("coreference", coref), ("grounding", ground),
          ("relation graph", relate), ("constraints", constrain), ("inference", infer), ("diagnostics", diagnose),
          ("plot data", visualise), ("annotated spans", annotated)]


def run_stages(spark: SparkSession, cfg: dict, only: int | None = None, force: bool = False, extractor=None) -> None:
    """Run one stage (1-based) or all; the first failure ends the run."""
    if only is not None and not 1 <= only <= len(STAGES):
        raise ValueError(f"stage must lie between 1 and {len(STAGES)}")
    r = Run(spark, cfg, force, extractor)
    for i, (name, stage) in enumerate(STAGES, 1):
        if only in (None, i):
            log.info("stage %d: %s", i, name)
            began, status = time.time(), "error"
            try:
                with scratch(spark):  # a stage reads what others saved and saves its own
                    stage(r)
                status = "complete"
            finally:
                row = [(i, name, status, int(began), round(time.time() - began, 2))]
                spark.createDataFrame(row, "number int, stage string, status string, started long, seconds double").write.mode(
                    "append").parquet(r.path("run_log"))
