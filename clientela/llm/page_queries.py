"""Registered queries over web pages: archives and main texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.session import scratch_folder

from . import html_text, warc
from .registry import query, table


@query()
def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query()
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.mark_revisits(table(spark, folder, "pages")), path)
    return warc.read_warc(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
