"""Registered queries over texts: packing, fingerprints, encoding, quality, joins of texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.session import settle

from . import (
    automaton,
    fingerprints,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    quality,
    word_coding,
)
from .registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), VOCABULARY)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query()
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    known = settle(fingerprints.compare_edited(table(spark, folder, "documents")))
    near = fingerprints.near_counts(known)
    searched = known.join(near, list(fingerprints.WORDS64), "left")
    return searched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text("f0", "f1").alias("fingerprint"),
        fingerprints.as_text("e0", "e1").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
    )


@query()
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = automaton.encode(table(spark, folder, "documents"), VOCABULARY, round_trip=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.judge(documents, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query()
def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return cut.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_cut")


@query()
def op10_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"))


@query()
def op13_words(spark: SparkSession, folder: str) -> DataFrame:
    coded = word_coding.encode(table(spark, folder, "documents"), RANKS)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
