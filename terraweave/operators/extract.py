"""Triples out of windows: extractors, response parsing and validation.

An extractor is any object with ``attach(windows) -> windows`` that adds a
``location_relations ARRAY<STRUCT<location_1, location_2, spatial_indicator,
semantic_type ARRAY<STRING>>>`` column and an ``_error`` column. Models sit
behind that interface; everything around it is Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as lx
from ..functions.arrays import elements
from ..functions.text import col, fold, strip

TRIPLE = "struct<location_1:string,location_2:string,spatial_indicator:string,semantic_type:array<string>>"

# Our own default: phrases the rule-based extractor looks for between two spans.
COMPASS = ["north of", "south of", "east of", "west of", "northeast of", "northwest of",
           "southeast of", "southwest of"]
CUES = sorted([*lx.CUE_TYPES, *COMPASS], key=lambda c: (-len(c), c))


def span_pattern(bare: bool) -> str:
    article = r"(?:the|an|a) "
    return rf"(?:{article})?(\p{{L}}+)" if bare else rf"((?:{article})?\p{{L}}+)"


def cue_pattern(bare: bool = False) -> str:
    """Trajector, cue, landmark. ``bare`` keeps articles out of the spans."""
    span = span_pattern(bare)
    return rf"(?i){span} +({'|'.join(CUES)}) +{span}"


def _trie(words: list[str]) -> str:
    """The words as one pattern that reads a common beginning once and prefers the longer word."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    if not tails:
        return ""
    either = "|".join(c + _trie(rest) for c, rest in sorted(tails.items()))
    return f"(?:{either})?" if "" in words else f"(?:{either})" if len(tails) > 1 else either


def scan_pattern(bare: bool = False) -> str:
    """Finds what ``cue_pattern`` finds, from word boundaries on.

    A word or a run of blanks is taken whole and never given back (neither can end elsewhere), and the cues share their
    beginnings, so a word without a cue behind it costs a few steps, not a try of every cue for every shorter word.
    """
    span = span_pattern(bare).replace(r"\p{L}+", r"\p{L}++")
    return rf"(?i)(?<!\p{{L}}){span} ++({_trie(CUES)}) ++{span}"


@dataclass
class CueExtractor:
    """Deterministic default extractor: a cue phrase between two word spans.

    A match starts at a word boundary, so an article is only ever a whole word.
    """

    bare: bool = False
    name: str = "cue-rules"

    def triples(self, text: Column) -> Column:
        pattern, scan = cue_pattern(self.bare), scan_pattern(self.bare)
        return F.transform(
            F.regexp_extract_all(text, F.lit(scan), 0),
            lambda m: F.struct(
                F.regexp_extract(m, pattern, 1).alias("location_1"),
                F.regexp_extract(m, pattern, 3).alias("location_2"),
                F.lower(F.regexp_extract(m, pattern, 2)).alias("spatial_indicator"),
            ),
        )

    def attach(self, windows: DataFrame, text: str = "sentence") -> DataFrame:
        found = windows.withColumn("_found", self.triples(F.col(text)))
        typed = F.transform("_found", lambda t: F.struct(
            t["location_1"].alias("location_1"), t["location_2"].alias("location_2"),
            t["spatial_indicator"].alias("spatial_indicator"),
            F.array_compact(F.array(lx.infer_type(t["spatial_indicator"]))).alias("semantic_type")))
        return (
            found.withColumn("location_relations", typed).drop("_found")
            .withColumn("model", F.lit(self.name))
            .withColumn("_error", F.lit(None).cast("string"))
        )


@dataclass
class ModelExtractor:
    """Extractor backed by any ``chat(system, user, temperature) -> str`` callable.

    ``make_client`` is called once per task, so model handles and connections
    live on the executors. Failures are kept in the row (``_error``), never
    raised; retries wait ``backoff ** attempt`` and may grow the temperature.
    """

    make_client: Callable[[], Callable[[str, str, float], str]]
    system: str = ""
    user: str = "{sentence}"
    stricter: str = ""
    temperature: float = 0.1
    temperature_step: float = 0.0
    temperature_max: float = 0.3
    max_retries: int = 2
    backoff: float = 1.5
    name: str = "model"

    def respond(self, windows: DataFrame, text: str = "sentence") -> DataFrame:
        cfg = self

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chat = cfg.make_client()
            for batch in batches:
                answers, errors = [], []
                for sentence in batch[text]:
                    answer, error = None, None
                    for attempt in range(cfg.max_retries + 1):
                        system = cfg.system + (cfg.stricter if attempt else "")
                        heat = min(cfg.temperature + attempt * cfg.temperature_step,
                                   max(cfg.temperature, cfg.temperature_max))
                        try:
                            answer, error = chat(system, cfg.user.format(sentence=sentence), heat), None
                            break
                        except Exception as exc:  # kept with the row, not fatal
                            error = repr(exc)
                            if attempt < cfg.max_retries:
                                time.sleep(cfg.backoff ** attempt)
                    answers.append(answer)
                    errors.append(error)
                yield batch.assign(response=answers, _error=errors)

        from pyspark.sql.types import StringType, StructType
        schema = StructType(list(windows.schema.fields)).add("response", StringType()).add("_error", StringType())
        return windows.mapInPandas(ask, schema)

    def attach(self, windows: DataFrame, text: str = "sentence") -> DataFrame:
        answered = self.respond(windows, text)
        return answered.withColumn(
            "location_relations", F.coalesce(parse_triples("response"), F.array().cast(f"array<{TRIPLE}>"))
        ).withColumn("model", F.lit(self.name)).drop("response")


# -- parsing of model responses ---------------------------------------------

_LOOSE = ("array<struct<location_1:string,location_2:string,"
          "spatial_indicator:string,semantic_type:string>>")


def json_body(raw: Column | str) -> Column:
    """The response itself when it is JSON, else its widest ``{...}`` block, else null."""
    whole = F.try_parse_json(col(raw))
    block = F.nullif(F.regexp_extract(col(raw), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(whole.isNotNull(), col(raw)).otherwise(F.when(F.try_parse_json(block).isNotNull(), block))


def string_list(raw: Column) -> Column:
    """A JSON array of strings, or a bare string, as a list."""
    text = F.coalesce(raw, F.lit(""))
    listed = F.from_json(text, "array<string>")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.startswith(text, F.lit("[")), F.coalesce(listed, F.array().cast("array<string>")))
        .otherwise(F.array(text))
    )


def parse_triples(raw: Column | str, accept_lists: bool = False) -> Column:
    """Triples of a response under ``location_relations``.

    ``accept_lists`` also takes a top-level list and, where the first key is
    missing or empty, the key ``relations``. Null when nothing can be parsed.
    """
    body = json_body(raw)
    at = lambda key: F.from_json(F.get_json_object(body, f"$.{key}"), _LOOSE)
    items = at("location_relations")
    if accept_lists:
        full = lambda c: F.when(F.size(c) > 0, c)
        top = F.when(F.startswith(strip(body), F.lit("[")), F.from_json(body, _LOOSE))
        items = F.coalesce(top, full(items), full(at("relations")), items)
    trimmed = F.transform(items, lambda r: F.struct(
        strip(F.coalesce(r["location_1"], F.lit(""))).alias("location_1"),
        strip(F.coalesce(r["location_2"], F.lit(""))).alias("location_2"),
        strip(F.coalesce(r["spatial_indicator"], F.lit(""))).alias("spatial_indicator"),
        F.transform(string_list(r["semantic_type"]), F.upper).alias("semantic_type")))
    return F.filter(trimmed, complete)


def parse_relations(raw: Column | str) -> Column:
    """Typed relations of a joint response, a JSON object with the key ``relations``; all fields as strings.

    Prose around the object is ignored. An object without the key has no relations; null when nothing can be parsed.
    """
    body = json_body(raw)
    kind = "array<struct<" + ",".join(f"{c}:string" for c in sorted(_RELATION_COLUMNS)) + ">>"
    listed = F.from_json(F.get_json_object(body, "$.relations"), kind)
    whole = F.startswith(strip(body), F.lit("{"))
    return F.when(whole, F.coalesce(listed, F.array().cast(kind)))


def joint_relations(answers: DataFrame, raw: str, min_confidence: float | None = None) -> DataFrame:
    """Valid relations of joint responses, with the other columns of ``answers``."""
    keys = [c for c in answers.columns if c != raw]
    rows = answers.select(*keys, F.inline(elements(parse_relations(raw))))
    return valid_relations(rows, min_confidence)


def complete(t: Column) -> Column:
    return (t["location_1"] != "") & (t["location_2"] != "") & (t["spatial_indicator"] != "")


# -- validation -------------------------------------------------------------

def span_in(span: Column, sentence: Column) -> Column:
    return (span != "") & F.contains(fold(sentence), fold(span))


def triple_rows(attached: DataFrame, keep: list[str]) -> DataFrame:
    """One row per triple with its position ``ord`` inside the response."""
    return attached.select(*keep, F.posexplode(elements("location_relations")).alias("ord", "_t")).select(
        *keep, F.col("ord").cast("long").alias("ord"), "_t.*")


def valid_triples(rows: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Keep triples grounded in their sentence and type them.

    Complete, not a self relation, every span found verbatim, not an idiom,
    at least one semantic type.
    """
    a, b, cue, text = F.col("location_1"), F.col("location_2"), F.col("spatial_indicator"), F.col(sentence)
    return (
        rows.where((a != "") & (b != "") & (cue != ""))
        .where(fold(a) != fold(b))
        .where(span_in(a, text) & span_in(b, text) & span_in(cue, text))
        .where(~lx.metaphorical(text, cue, b))
        .withColumn("semantic_type", lx.clean_types(F.col("semantic_type"), cue))
        .where(F.size("semantic_type") > 0)
    )


def first_of_equal_triples(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Drop triples that repeat an earlier one of the same response up to case and spacing."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys, fold("location_1").alias("_a"), fold("spatial_indicator").alias("_c"),
                        fold("location_2").alias("_b")).agg(
        F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def valid_relations(rows: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Validate raw joint relations (all columns strings, as a model wrote them).

    Known type; names of two characters or more; a missing second entity only
    where the type allows it; not a self relation. Confidence defaults to 0.5
    and is clamped to [0, 1]; labels outside GPE/LOC/FAC become LOC.
    """
    trim = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    label = lambda c: F.when(F.upper(trim(c)).isin("GPE", "LOC", "FAC"), F.upper(trim(c))).otherwise("LOC")
    kind = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit("uncertain"))))
    second = trim("entity_2")
    e2 = F.when(~F.lower(second).isin("null", "none", "") & (F.length(second) >= 2), second)
    number = F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(0.5))
    out = rows.select(
        *[c for c in rows.columns if c not in _RELATION_COLUMNS],
        trim("relation_type").alias("relation_type"),
        trim("entity_1").alias("entity_1"), label("entity_1_type").alias("entity_1_type"),
        kind("entity_1_class").alias("entity_1_class"),
        e2.alias("entity_2"),
        F.when(e2.isNotNull(), label("entity_2_type")).alias("entity_2_type"),
        F.when(e2.isNotNull(), kind("entity_2_class")).alias("entity_2_class"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 3).alias("confidence"),
        F.expr("try_cast(distance_value AS DOUBLE)").alias("distance_value"),
        F.when(F.col("distance_unit").isin("miles", "km"), F.col("distance_unit")).alias("distance_unit"),
    )
    out = (
        out.where(F.col("relation_type").isin(lx.RELATION_TYPES))
        .where(F.length("entity_1") >= 2)
        .where(F.col("entity_2").isNotNull() | F.col("relation_type").isin(lx.UNARY_TYPES))
        .where(F.col("entity_2").isNull() | (fold("entity_1") != fold("entity_2")))
    )
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


_RELATION_COLUMNS = {
    "relation_type", "entity_1", "entity_1_type", "entity_1_class", "entity_2", "entity_2_type",
    "entity_2_class", "confidence", "distance_value", "distance_unit",
}


def pending(windows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Windows without a finished record; failed ones count as finished."""
    return windows.join(done.select(*keys).distinct(), keys, "left_anti")


# -- span annotators --------------------------------------------------------

SPAN = "array<struct<cluster:int,label:string,mention:string,start:int,end:int>>"


@dataclass
class SpanAnnotator:
    """Entity spans and coreference clusters of a window, from a model loaded once per task.

    The model maps a text to dictionaries with ``mention, start, end`` and, where
    known, ``label`` and ``cluster``. A window it fails on keeps its error.
    """

    make_model: Callable[[], Callable[[str], list[dict]]]

    def attach(self, windows: DataFrame, text: str = "sentence") -> DataFrame:
        make = self.make_model

        def annotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for batch in batches:
                spans, errors = [], []
                for body in batch[text]:
                    try:
                        spans.append([{k: s.get(k) for k in ("cluster", "label", "mention", "start", "end")} for s in model(body)])
                        errors.append(None)
                    except Exception as exc:  # kept with the row, not fatal
                        spans.append([])
                        errors.append(repr(exc))
                yield batch.assign(spans=spans, _error=errors)

        from pyspark.sql.types import StringType, StructField, StructType
        span = StructType.fromDDL(f"spans {SPAN}").fields[0]
        return windows.mapInPandas(annotate, StructType([*windows.schema.fields, span, StructField("_error", StringType())]))


def annotated_spans(annotated: DataFrame, fallback: bool = True) -> DataFrame:
    """One row per span, mapped from its window to its sentence.

    Spans that start between sentences go to the last one, or are dropped without ``fallback``.
    """
    from .segment import boundaries, to_sentence
    bounded = annotated.withColumn("_b", boundaries(F.col("sents"), F.col("doc_id")))
    rows = bounded.select("doc_id", "window_id", "_b", F.posexplode(elements("spans")).alias("pos", "s"))
    placed = rows.withColumn("at", to_sentence(F.col("s.start"), F.col("s.end"), F.col("_b"), fallback))
    return placed.where(F.col("at").isNotNull()).select(
        "doc_id", "window_id", F.col("pos").cast("long").alias("pos"), "s.cluster", "s.label", F.col("s.mention").alias("mention"),
        F.regexp_extract("at.sentence_id", r"(\d+)$", 1).cast("long").alias("sent_idx"), "at.sentence_id",
        F.col("at.local_start").alias("char_start"), F.col("at.local_end").alias("char_end"))
