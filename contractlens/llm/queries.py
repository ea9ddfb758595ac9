"""One query per operator over its whole table, and the SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.llm import chat, collocations, extraction, jaccard, mixing, negatives, passages, quality, tokens, toxicity, vectors, warc
from contractlens.llm.common import table
from contractlens.llm.licenses import scan_licenses

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = quality.measured_rows(docs, ["doc_id"])
    return quality.judge_measured(measured).select("doc_id", *quality.BASE, "base_failed", "kept")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = (public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    encoded = tokens.encode(docs, *vocab, keep_text=False)
    return tokens.decode(encoded, *vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.length("text").alias("mass"))
    mixed = mixing.mix_sources(docs, mass="mass")
    return mixed.select("doc_id", "source", "lang", "n_chars", "mix_copies", "mix_copy", "mix_key")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "kept_doc_id", "start_word", "n_words")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, chat.REPLY, chat.PROBE)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(turns.unionByName(probe)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(vecs, F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_warc": op2_warc,
        "op3_quality": op3_quality,
        "op4_jaccard": op4_jaccard,
        "op5_tokens": op5_tokens,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_vectors": op8_vectors,
        "op9_passages": op9_passages,
        "op10_license_scan": op10_license_scan,
        "op11_chat_examples": op11_chat_examples,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE,
        "op3_quality": quality.oracle_sql(),
        "op4_jaccard": jaccard.ORACLE,
        "op7_mixing": mixing.oracle_sql(),
        "op8_vectors": vectors.ORACLE,
        "op11_chat_examples": chat.oracle_sql(),
        "op12_hard_negatives": negatives.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
