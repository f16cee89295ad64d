"""Command line: ingest, extract, graph, run, score, sample, stages, progress."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession, functions as F

from .functions.text import safe_tag
from .operators import extract, progress, scoring, segment
from .plans import flows
from .session import DEFAULTS
from .sources import chat, config, readers, writers


def _spark() -> SparkSession:
    builder = SparkSession.builder.appName("terraweave")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _extractor(args):
    if not args.model:
        return extract.CueExtractor()
    return extract.ModelExtractor(chat.client(args.host, args.model, args.timeout), chat.SYSTEM, chat.USER, chat.STRICTER, name=args.model)


# What each command takes: name -> default, or a type where the value has to be given. Names and defaults are fixed
# values that users' scripts rely on.
TEXTS = {"input": str, "--cleaned-dir": "corpus/cleaned"}
WINDOWS = {"--window": 3, "--stride": 3, "--min-chars": 20, "--limit": 0, "--resume": False}
MODEL = {"--model": None, "--host": "http://localhost:11434", "--timeout": 90}
GRAPH = {"--top-k": 10, "--lexicon": None, "--no-tag": False, "--svg": False}
COMMANDS = {
    "ingest": ("clean and segment text files", TEXTS | {"--doc-id": None}),
    "extract": ("sentences -> window records", {"corpus": str, "--out": "data/relations"} | WINDOWS | MODEL),
    "graph": ("window records -> graph and report",
              {"relations": str, "--name": str, "--out-dir": None, "--title": None} | GRAPH),
    "run": ("ingest, extract and graph", TEXTS | {"--doc-id": "doc"} | WINDOWS | MODEL | GRAPH),
    "sample": ("draw windows to annotate",
               {"corpus": str, "--out": str, "--n": 100, "--window": 3, "--seed": 42, "--min-chars": 20}),
    "score": ("predictions against gold", {"--gold": str, "--pred": list, "--out-dir": str}),
    "stages": ("relations -> posterior, stage by stage",
               {"--config": "config.yaml", "--phase": int, "--force": False, "--verbose": False}),
    "progress": ("state of an extraction output", {"records": str}),
}
OPTIONAL = {"--phase"}  # typed, but may be left out


def _option(name: str, value) -> dict:
    """Settings of one argument."""
    if value is False:
        return {"action": "store_true"}
    if value is list:
        return {"nargs": "+", "required": True}
    if isinstance(value, type):
        return {"type": value} if not name.startswith("--") or name in OPTIONAL else {"type": value, "required": True}
    return {"default": value, "type": type(value) if value is not None else str}


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="terraweave")
    commands = ap.add_subparsers(dest="cmd", required=True)
    for command, (purpose, options) in COMMANDS.items():
        p = commands.add_parser(command, help=purpose)
        for name, value in options.items():
            p.add_argument(name, **_option(name, value))
    return ap


def score(spark: SparkSession, gold: str, preds: list[str], out_dir: str) -> list[dict]:
    shape = f"annotation_id string, {readers.WINDOW_RECORD}"
    load = lambda path: scoring.last_per_id(readers.read_jsonl(spark, path, shape, ["annotation_id"]).withColumn(
        "_o", F.monotonically_increasing_id()), "_o")
    os.makedirs(out_dir, exist_ok=True)
    g, totals, types = load(gold), None, None
    for path in preds:
        tag = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        for scheme in scoring.MATCHERS:
            m = scoring.matched(scoring.paired(g, load(path)), scheme)
            named = lambda df: df.withColumn("model", safe_tag(F.lit(tag))).withColumn("scheme", F.lit(scheme))
            t = named(scoring.overall(m))
            totals = t if totals is None else totals.unionByName(t)
            k = named(scoring.per_type(m))
            types = k if types is None else types.unionByName(k)
    # one row per model and scheme
    rows = [r.asDict() for r in totals.collect()]
    writers.write_small_json({"scores": rows, "per_type": [r.asDict() for r in types.collect()]}, os.path.join(out_dir, "scores.json"))
    head = ["| model | scheme | precision | recall | F1 | TP | FP | FN |", "|---|---|---:|---:|---:|---:|---:|---:|"]
    lines = [r["line"] for r in scoring.markdown(totals).orderBy("model", "scheme").collect()]
    with open(os.path.join(out_dir, "scores.md"), "w", encoding="utf-8") as out:
        out.write("\n".join(head + lines) + "\n")
    # one row per model and semantic type
    by_type = scoring.markdown_per_type(types.where(F.col("scheme") == "lenient")).orderBy("model", "semantic_type").collect()
    with open(os.path.join(out_dir, "scores_per_type.md"), "w", encoding="utf-8") as out:
        out.write("\n".join(scoring.TYPE_HEAD + [r["line"] for r in by_type]) + "\n")
    writers.render_f1_chart(rows, os.path.join(out_dir, "scores.png"))
    return rows


def sample(spark: SparkSession, corpus: str, out: str, n: int, window: int, seed: int, min_chars: int) -> None:
    wins = flows.sentence_windows(readers.read_sentences(spark, corpus, min_chars), window, 1)
    drawn = segment.draw_windows(wins, n, seed).drop("sents", "window_id")
    writers.write_jsonl(drawn.withColumn("location_relations", F.array().cast(readers.TRIPLES)).withColumn("_notes", F.lit("")), out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(args, "verbose", False) else logging.INFO)
    spark = _spark()
    if args.cmd == "ingest":
        flows.ingest(spark, args.input, args.cleaned_dir, args.doc_id)
    elif args.cmd == "extract":
        flows.extract_windows(spark, args.corpus, args.out, args.window, args.stride, args.min_chars, args.limit, args.resume, _extractor(args))
    elif args.cmd == "graph":
        flows.build_graph(spark, args.relations, args.out_dir or os.path.join("graphs", args.name), args.name,
                          args.top_k, args.lexicon, not args.no_tag, args.svg, args.title)
    elif args.cmd == "run":
        cleaned = flows.ingest(spark, args.input, os.path.join(args.cleaned_dir, args.doc_id), args.doc_id)
        out = flows.extract_windows(spark, cleaned, os.path.join("data", args.doc_id + ".relations"), args.window, args.stride,
                                    args.min_chars, args.limit, args.resume, _extractor(args))
        flows.build_graph(spark, out, os.path.join("graphs", args.doc_id), args.doc_id, args.top_k, args.lexicon, not args.no_tag, args.svg)
    elif args.cmd == "sample":
        sample(spark, args.corpus, args.out, args.n, args.window, args.seed, args.min_chars)
    elif args.cmd == "score":
        score(spark, args.gold, args.pred, args.out_dir)
    elif args.cmd == "stages":
        flows.run_stages(spark, config.load_config(args.config), args.phase, args.force)
    elif args.cmd == "progress":
        progress.window_stats(readers.read_jsonl(spark, args.records, readers.WINDOW_RECORD)).show(truncate=False)


if __name__ == "__main__":
    main()
