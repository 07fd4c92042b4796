"""Registered queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import whitening
from .registry import query, table


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
