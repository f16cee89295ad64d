"""Registered queries over prose: cleaning, segmentation, extraction, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx, text as tx
from ..operators import extract, graph, segment
from ..session import cut
from .tables import document_windows, documents, sentence_arrays, spread, table, window_triples

# An e-book wrapped around each document, so the licence rules have work to do.
HEAD = "Title page\n*** START OF THE PROJECT GUTENBERG EBOOK %d ***\n\n\n\n"
TAIL = "\r\n*** END OF THIS PROJECT GUTENBERG EBOOK %d ***\nlicence text"


def _wrapped(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", F.concat(
        F.format_string(HEAD, "doc_id"), "text", F.format_string(TAIL, "doc_id")).alias("text"))


def clean_text(spark, sf):
    return segment.clean_documents(_wrapped(spark, sf)).select(
        "doc_id", F.col("text").alias("clean"), F.length("text").cast("long").alias("n"))


def clean_text_legacy(spark, sf):
    docs = segment.clean_documents(table(spark, sf, "conversations"), licence=False, ellipsis=False)
    return docs.select("conv_id", "turn", F.col("text").alias("clean"), tx.fold("text").alias("folded"))


def slugs(spark, sf):
    pages = table(spark, sf, "pages")
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    stem = F.concat(F.lit("The "), title)
    return pages.select(
        "page_id", tx.slug(title).alias("title_slug"), tx.slug("url").alias("url_slug"),
        tx.drop_leading_the(tx.slug(stem)).alias("doc_slug"),
        tx.safe_tag("url").alias("tag"), tx.safe_file(title).alias("file_name"))


def sentence_table(spark, sf):
    return segment.sentences(sentence_arrays(spark, sf))


def dedup_consecutive(spark, sf):
    turns = table(spark, sf, "conversations")
    lines = turns.select("conv_id", F.posexplode(segment.split_sentences(tx.tidy("text"), 1)).alias("i", "line"), "turn")
    lines = lines.select("conv_id", F.struct("turn", "i").alias("ord"), "line")
    kept = segment.drop_repeats_rows(lines, "conv_id", "ord", "line", coarse=F.floor(F.col("ord.turn") / 1024))
    return kept.select("conv_id", "ord.turn", "ord.i", "line")


def dedup_all(spark, sf):
    docs = segment.clean_documents(documents(spark, sf), licence=False, ellipsis=False)
    every = segment.sentences(segment.sentence_arrays(docs, dedup=None))
    kept = segment.first_of_repeats_rows(every, "doc_id", "sent_idx", "text")
    return kept.select("doc_id", "sent_idx", "sentence_id", "text")


def windows_fixed(spark, sf):
    return document_windows(spark, sf).select(
        "doc_id", "window_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), "sentence")


def windows_overlap(spark, sf):
    w = segment.windows(sentence_arrays(spark, sf), size=3, stride=2)
    return w.select("doc_id", "window_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), "sentence")


def windows_of_turns(spark, sf):
    w = segment.windows_rows(table(spark, sf, "conversations"), "conv_id", "turn", "text", size=3, stride=2)
    return w.select("conv_id", "window_id", F.array_join("members", ",").alias("turns"), "sentence")


def chunks_of_turns(spark, sf):
    w = segment.windows_rows(table(spark, sf, "conversations"), "conv_id", "turn", "text", size=6, stride=4,
                             partial_tail=True, one_line=False)
    return w.select("conv_id", "window_id", F.array_join("members", ",").alias("turns"), "sentence")


def chunks_overlap(spark, sf):
    c = segment.chunks(sentence_arrays(spark, sf))
    return c.select("doc_id", "chunk_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), "sentence")


def token_chunks(spark, sf):
    return segment.budget_chunks(sentence_arrays(spark, sf), budget=60)


def token_windows(spark, sf):
    return segment.budget_windows(sentence_arrays(spark, sf), budget=80, overlap=2)


def draw_windows(spark, sf):
    drawn = segment.draw_windows(document_windows(spark, sf), n=100, seed=42)
    return drawn.select("annotation_id", "doc_id", "window_id", "sentence")


def extract_triples(spark, sf):
    rows = window_triples(spark, sf)
    rows = extract.first_of_equal_triples(rows, ["doc_id", "window_id"])
    return rows.select("doc_id", "window_id", "ord", "location_1", "spatial_indicator", "location_2",
                       F.array_join("semantic_type", ",").alias("semantic_type"))


def validate_triples(spark, sf):
    rows = extract.valid_triples(window_triples(spark, sf))
    return rows.select("doc_id", "window_id", "ord", "location_1", "spatial_indicator", "location_2",
                       F.array_join("semantic_type", ",").alias("semantic_type"))


def _edges(spark, sf):
    return graph.edges(window_triples(spark, sf).drop("sentence"))


def graph_edges(spark, sf):
    e = _edges(spark, sf)
    return e.select(
        "doc_id", "window_id", "ord", "sentence_id", "location_1", "location_2", "indicator", "rcc8", "cdc",
        "distance_value", "distance_unit", "link", F.array_join("semantic_type", ",").alias("semantic_type"),
        lx.edge_label(F.col("rcc8"), F.col("cdc"), F.col("distance_value"), F.col("distance_unit"),
                      F.col("indicator")).alias("label"))


def graph_nodes(spark, sf):
    return graph.nodes(_edges(spark, sf))


def top_connected(spark, sf):
    return graph.top_connected(graph.nodes(_edges(spark, sf)), 10)


def rcc8_dist(spark, sf):
    return graph.distribution(_edges(spark, sf), "rcc8")


def cdc_dist(spark, sf):
    return graph.distribution(_edges(spark, sf), "cdc")


def kind_dist(spark, sf):
    return graph.distribution(graph.nodes(_edges(spark, sf)), "entity_kind")


def graph_summary(spark, sf):
    return graph.summary(_edges(spark, sf))


def two_hop(spark, sf):
    e = cut(_edges(spark, sf).select("location_1", "location_2"))  # read once per hop
    roots = graph.top_connected(graph.nodes(e, tag=False), 3).select("entity")
    return graph.neighbourhood(e, roots, 2)


# Fixed phrase lists: the cue texts rendered from line items below.
UNITS = ["miles", "km", "meters", "ft", "yards", "leagues", "mi"]
PHRASES = ["north of", "southeast of", "in the", "at the edge of", "across from", "not far from",
           "far from", "northwest of", "contains", "beyond", "left of", "south  of", "same as",
           "part of", "above", "across the bay from", "crosses"]


def cue_texts(items):
    """A free-text cue per line item, e.g. ``12.5 miles north of``."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.pmod(c, F.lit(len(values))) + 1).cast("int"))
    return items.select("l_orderkey", "l_linenumber", F.concat_ws(
        " ", (F.col("l_quantity") / 2).cast("string"),
        pick(UNITS, F.col("l_partkey")), F.upper(pick(PHRASES, F.col("l_suppkey")))).alias("cue"))


def cue_mapping(spark, sf):
    cues = cue_texts(spread(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey"))
    m = lx.map_cue("cue")
    out = cues.select("l_orderkey", "l_linenumber", "cue", *[c.alias(n) for n, c in m.items()],
                      lx.infer_type("cue").alias("semantic_type"))
    return out.withColumn("link", lx.link_kind(F.col("cdc"))).withColumn(
        "label", lx.edge_label(F.col("rcc8"), F.col("cdc"), F.col("distance_value"),
                               F.col("distance_unit"), F.col("cue")))


QUERIES = {
    "p03_clean_text": clean_text,
    "p05_clean_text_legacy": clean_text_legacy,
    "p01_slugs": slugs,
    "w01_sentence_segment": sentence_table,
    "d01_dedup_consecutive": dedup_consecutive,
    "d02_dedup_all": dedup_all,
    "w03_windows_fixed": windows_fixed,
    "w03_windows_overlap": windows_overlap,
    "w03_windows_of_turns": windows_of_turns,
    "w04_chunks_overlap": chunks_overlap,
    "w04_chunks_of_turns": chunks_of_turns,
    "w05_token_chunks": token_chunks,
    "w06_token_windows": token_windows,
    "w07_draw_windows": draw_windows,
    "x06_extract_triples": extract_triples,
    "f03_validate_triples": validate_triples,
    "m01_cue_mapping": cue_mapping,
    "a05_graph_edges": graph_edges,
    "a05_graph_nodes": graph_nodes,
    "d06_top_connected": top_connected,
    "a02_rcc8_distribution": rcc8_dist,
    "a03_cdc_distribution": cdc_dist,
    "a04_kind_distribution": kind_dist,
    "a01_graph_summary": graph_summary,
    "v07_two_hop_neighbours": two_hop,
}
