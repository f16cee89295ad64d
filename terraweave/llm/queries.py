"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from terraweave.llm import (chat_format, decontaminate, hard_negatives, html_extract, katz, line_dedup, merkle, ngram_join, quality,
                            sentence_pieces, suffix_dedup, token_store, warc)
from terraweave.llm.common import new_folder, table
from terraweave.llm.sql import SQL
from terraweave.session import cut


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.with_verdict(docs, quality.RULES, measured="_m")
    m = F.col("_m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return judged.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores, _ = katz.learn_and_score(docs, ~held_out)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup.drop_boilerplate(docs, "source", dropped="n_dropped")
    return cleaned.select(
        "doc_id", "source", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    cut(warc.write_archives(pages, warc.resolve(warc.headers(pages)), folder))
    found = cut(warc.read_archives(spark, folder).drop("payload"))
    return warc.link_revisits(found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder, manifest = token_store.store(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_store.digests(token_store.read_documents(spark, folder))
    return token_store.with_global_start(found, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.md5("decoded").alias("decoded_md5"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove(suffix_dedup.mark(docs)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", tampered,
                         {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))})
    return merkle.prove(merkle.manifest(rows)).withColumnRenamed("key", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), marks.alias("text"))
    return chat_format.digests(cut(chat_format.format_turns(turns.unionByName(more))))


OPERATORS = (op1_quality_rules, op2_token_store, op3_katz, op4_line_dedup, op5_ngram_join, op6_warc, op7_sentence_pieces,
             op8_suffix_dedup, op9_html_extract, op10_decontaminate, op11_merkle_manifest,
             op12_hard_negatives, op13_chat_format)
QUERIES = {**{f.__name__: f for f in OPERATORS}, "pipeline": corpus_pipeline.run}
__all__ = ["QUERIES", "SQL"]
