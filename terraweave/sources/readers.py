"""Inputs: texts, JSON lines, relation files, documents behind a decoder."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.arrays import elements
from ..functions.text import slug, strip

SENTENCE = "doc_id string, sentence_id string, text string"
TRIPLES = ("array<struct<location_1:string,location_2:string,spatial_indicator:string,"
           "semantic_type:array<string>>>")
WINDOW_RECORD = (f"doc_id string, window_id bigint, sentence_ids array<string>, sentence_id string, "
                 f"sentence string, model string, location_relations {TRIPLES}, _error string")


def _existing(read: Callable[[], DataFrame], path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(
                f"input '{path}' does not exist; run the stage that writes it first") from exc
        raise


def read_texts(spark: SparkSession, path: str, replace: bool = False) -> DataFrame:
    """(doc_id, path, text), one row per file.

    UTF-8, else Latin-1; ``replace=True`` keeps UTF-8 and marks bad bytes instead.
    A byte-order mark stays in the text.
    """
    raw = _existing(lambda: spark.read.format("binaryFile").load(path), path)
    body = F.col("content").cast("string")
    text = F.make_valid_utf8(body) if replace else F.when(F.is_valid_utf8(body), body).otherwise(
        F.decode("content", "ISO-8859-1"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return raw.select(slug(stem).alias("doc_id"), "path", text.alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None,
               check: Column | None = None) -> DataFrame:
    """JSON lines. Blank lines are skipped; a line that is not JSON is fatal; with a
    schema, rows that lack a required field or fail ``check`` are skipped."""
    if schema is None:
        return _existing(lambda: spark.read.option("mode", "FAILFAST").json(path), path)
    lines = _existing(lambda: spark.read.text(path), path).where(strip("value") != "")
    shape = StructType.fromDDL(schema)
    # parse_json raises on malformed text, from_json applies the schema
    parsed = lines.where(F.parse_json("value").isNotNull()).select(F.from_json("value", shape).alias("r")).select("r.*")
    for name in required or []:
        parsed = parsed.where(F.col(name).isNotNull())
    return parsed if check is None else parsed.where(check)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return _existing(lambda: reader.json(path), path)


def read_sentences(spark: SparkSession, path: str, min_chars: int = 0) -> DataFrame:
    """Sentence table; short sentences are dropped before any windowing."""
    rows = read_jsonl(spark, path, SENTENCE, ["doc_id", "sentence_id", "text"])
    number = F.regexp_extract("sentence_id", r"(\d+)$", 1).cast("long")
    rows = rows.withColumn("sent_idx", number)
    return rows.where(F.length(strip("text")) >= min_chars) if min_chars else rows


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """One row per triple of a window file, with the sentence it stems from.

    The sentence is the first of ``sentence_ids``, else ``sentence_id``, else
    empty. A record without ``location_relations`` is an error.
    """
    records = read_jsonl(spark, path, WINDOW_RECORD)
    return flatten_records(records)


def flatten_records(records: DataFrame) -> DataFrame:
    known = F.when(F.col("location_relations").isNull(), F.raise_error(F.lit(
        "record without `location_relations`: re-run the extraction"))).otherwise(F.col("location_relations"))
    first = F.coalesce(F.get("sentence_ids", F.lit(0)), "sentence_id", F.lit(""))
    return records.select(first.alias("sentence_id"), F.coalesce("sentence", F.lit("")).alias("source_text"),
                          F.inline(elements(known)))


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Finished window ids of an output that may end in a torn line."""
    rows = spark.read.option("mode", "PERMISSIVE").schema("doc_id string, window_id bigint, _bad string").option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("window_id").isNotNull()).select("doc_id", "window_id").distinct()


def read_pdfs(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, text) of scanned documents, pages joined by a blank line.

    ``pages`` turns the bytes of one file into page texts; the default needs the
    optional OCR packages on the workers.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = pages or _ocr
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": ["\n\n".join(read(b)) for b in batch["content"]]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(decode, "path string, text string")


def _ocr(body: bytes, dpi: int = 300) -> list[str]:
    try:
        import pytesseract
        from pdf2image import convert_from_bytes
    except ImportError as exc:
        raise RuntimeError("reading scanned PDFs needs pdf2image and pytesseract on the workers") from exc
    return [pytesseract.image_to_string(page) for page in convert_from_bytes(body, dpi=dpi)]


def fetch(url: str, dest: str) -> str:
    """Download a file once (driver side)."""
    if not os.path.exists(dest):
        os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
        with urllib.request.urlopen(url, timeout=60) as answer, open(dest, "wb") as out:
            out.write(answer.read())
    return dest
