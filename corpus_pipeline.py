"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules drop rejected documents; line dedup takes boilerplate lines of a
source out of the texts and drops nothing; of each group of near duplicates one
row stays, of the document with the smallest id (null ids last); documents with
benchmark passages go; the rest is encoded to piece ids.

Null ids and texts are kept as far as the stages' operators say. Columns besides
those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraweave.llm import decontaminate, line_dedup, ngram_join, quality, sentence_pieces
from terraweave.llm.common import new_folder, table
from terraweave.session import cut, remove, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(ngram_join.near_duplicates(docs).select("comp", "uid", "doc_id"))  # a large component's join stays splittable
    found = cut(found.groupBy("comp", "uid", "doc_id").agg(F.count(F.lit(1)).alias("rows")))
    stays = found.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "uid"))["uid"].alias("stays"))
    judged = cut(found.join(stays, "comp").select("uid", "rows", (F.col("uid") == F.col("stays")).alias("stays")))
    uid = ngram_join.document_uid(F.col("doc_id").cast("long"), F.col("text"))
    left = docs.withColumn("uid", uid).join(judged.where("not stays").select("uid"), "uid", "left_anti")
    repeated = judged.where("stays and rows > 1").select("uid")  # of these, one of the rows
    once = left.join(repeated, "uid", "left_anti")
    return once.unionByName(left.join(repeated, "uid", "left_semi").dropDuplicates(["uid"])).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.decode(sentence_pieces.encode(docs.select(*COLUMNS), model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", drop_leaks),
    ("sentence_pieces", encode_pieces),
]

# Smith-Waterman scores and piece ids have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; of what they write, only the last one's output stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline/{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
