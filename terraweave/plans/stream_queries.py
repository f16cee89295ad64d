"""Registered queries that run as streams over the given tables and stop when
everything available is processed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import cut, shared_dir
from ..operators import extract
from ..sources import readers, writers
from ..streaming import incremental as inc
from . import text_queries as tq
from .tables import document_windows, table


def _folders(spark):
    base = os.path.join(shared_dir(spark), "streams", uuid.uuid4().hex)
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def _events(spark, sf):
    return inc.stream_of(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema)


def stream_counts(spark, sf):
    out, ckpt = _folders(spark)
    inc.running_counts(_events(spark, sf), "event_type", out, ckpt).awaitTermination()
    return inc.latest(spark, out)


def stream_first_seen(spark, sf):
    out, ckpt = _folders(spark)
    pairs = _events(spark, sf).select("user_id", "event_type")
    inc.first_seen(pairs, ["user_id", "event_type"], out, ckpt).awaitTermination()
    return spark.read.parquet(out)


def stream_recent(spark, sf):
    out, ckpt = _folders(spark)
    rows = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    inc.recent_buffer(rows, 20, ["ts", "event_id"], out, ckpt).awaitTermination()
    return inc.latest(spark, out).select("event_id", "event_type", "value")


def stream_buffers(spark, sf):
    """Last 8 purchases, 20 errors and 100 values of any event, as a run's rolling buffers."""
    out, ckpt = _folders(spark)
    rows = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    kind = F.when(F.col("event_type") == "purchase", F.array(F.lit("relation"), F.lit("duration"))).when(
        F.col("event_type") == "error", F.array(F.lit("error"), F.lit("duration"))).otherwise(F.array(F.lit("duration")))
    named = rows.withColumn("buffer", F.explode(kind))
    inc.rolling_buffers(named, {"relation": 8, "error": 20, "duration": 100}, ["ts", "event_id"], out, ckpt).awaitTermination()
    return inc.latest(spark, out).select("buffer", "event_id", "event_type", "value")


def stream_follow(spark, sf):
    """A consumer that follows the counters and ends once all events of the table are counted."""
    out, ckpt = _folders(spark)
    every = table(spark, sf, "events").count()
    query = inc.running_counts(_events(spark, sf), "event_type", out, ckpt, every="500 milliseconds")
    status = inc.follow(spark, query, out, lambda counts: counts.agg(F.sum("n")).first()[0] >= every, refresh=0.5, limit=3600.0)
    return inc.latest(spark, out).withColumn("status", F.lit(status))


def stream_triples(spark, sf):
    out, ckpt = _folders(spark)
    docs = inc.stream_of(spark, f"{sf}/documents*.parquet", table(spark, sf, "documents").schema)
    inc.extract_triples(docs.select("doc_id", "text"), out, ckpt).awaitTermination()
    rows = extract.triple_rows(spark.read.parquet(out), ["doc_id", "window_id"])
    return rows.select("doc_id", "window_id", "ord", "location_1", "spatial_indicator", "location_2")


# -- sinks ------------------------------------------------------------------------

def _graph(spark, sf):
    from ..operators import graph
    e = cut(graph.edges(tq.window_triples(spark, sf).drop("sentence")))  # nodes and edges both read it
    return graph.nodes(e), e


def dot_lines(spark, sf):
    return writers.dot_lines(*_graph(spark, sf)).groupBy("section", "key", "line").agg(F.count(F.lit(1)).alias("n"))


def graphml_lines(spark, sf):
    return writers.graphml_lines(*_graph(spark, sf)).groupBy("section", "key", "line").agg(F.count(F.lit(1)).alias("n"))


def html_lines(spark, sf):
    """The lines made from nodes and edges; head and tail are constant."""
    lines = writers.html_lines(*_graph(spark, sf)).where(F.col("section").isin(1, 2))
    return lines.groupBy("section", "key", "line").agg(F.count(F.lit(1)).alias("n"))


def jsonl_round_trip(spark, sf):
    """Window records written as JSON lines and loaded again as relations."""
    out, _ = _folders(spark)
    found = extract.CueExtractor().attach(document_windows(spark, sf)).drop("sents")
    writers.write_jsonl(found.withColumn("doc_id", F.col("doc_id").cast("string")), out)
    back = readers.read_relations(spark, out)
    return back.groupBy("sentence_id", "location_1", "spatial_indicator", "location_2").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "t04_stream_counts": stream_counts,
    "t03_stream_first_seen": stream_first_seen,
    "t06_stream_recent": stream_recent,
    "d08_stream_buffers": stream_buffers,
    "t05_stream_follow": stream_follow,
    "t01_stream_triples": stream_triples,
    "s15_dot_lines": dot_lines,
    "s14_graphml_lines": graphml_lines,
    "s16_html_lines": html_lines,
    "s12_jsonl_round_trip": jsonl_round_trip,
}
