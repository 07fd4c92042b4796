"""The corpus pipeline: four stages from raw documents to packed sequences.

Each stage works on all documents that the one before has kept, and its result is written and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from clientela.llm import line_dedup, ngram_join, packing, quality  # noqa: E402
from clientela.llm.text_queries import VOCABULARY  # noqa: E402
from clientela.session import settle_alone  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (null ids as well), unchanged."""
    verdicts = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # An id that several rows share is kept if any of them is.
    kept = verdicts.where("kept").select(F.struct("doc_id").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.struct("doc_id"))
    return keyed.join(kept, "__key", "left_semi").select(docs.columns)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages cut; a document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.where("n_cut is null or n_cut = 0 or trim(text) <> ''")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; rows without an id stay."""
    groups = ngram_join.similar_groups(docs)
    later = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, VOCABULARY).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_copies", line_copies),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

# Exact binomial tests, extended matches and packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage stores on its way is deleted when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle_alone(spark, functools.partial(stage, spark, docs, sf_dir))
    return docs
