"""CSV files with line breaks inside quotes, read by many tasks.

Spark reads such a file in one task, as a break may belong to a field. Here every split is read as
lines, and the quotes are counted on the way: a line starts a record if the number of quotes before it
in the file is even. The counts per split, a row each, give every split its start. A line that holds
whole records by this stays where it is; only lines of records with breaks are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientela.session import settle
from clientela.shipping import ship

QUOTE = '"'


def _starts(per_split: DataFrame, amount: str, name: str) -> DataFrame:
    """What the earlier splits of a file add up to."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("file", "block", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias(name))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with the quotes before them in their split, and those that would begin a record if the
    split begins inside none (``even``) or one (``odd``); a split's lines come in order, in one task."""
    split, totals = None, np.zeros(3, dtype=np.int64)
    for frame in frames:
        file, block = frame["file"].to_numpy(), frame["block"].to_numpy()
        change = np.ones(len(frame), dtype=bool)
        change[1:] = (block[1:] != block[:-1]) | (file[1:] != file[:-1])
        starts = np.flatnonzero(change)
        parts = []
        for start, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            if split != (file[start], block[start]):
                split, totals = (file[start], block[start]), np.zeros(3, dtype=np.int64)
            quotes = frame["quotes"].to_numpy()[start:end]
            before = totals[0] + np.cumsum(quotes) - quotes
            even = totals[1] + np.cumsum(before % 2 == 0)
            odd = totals[2] + np.cumsum(before % 2 == 1)
            parts.append((before, even, odd))
            totals = np.array([before[-1] + quotes[-1], even[-1], odd[-1]])
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield frame.assign(before=columns[0], even=columns[1], odd=columns[2])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record`` (from 1 in each file) and its ``text``, line breaks kept."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).cast("long").alias("quotes"),
        "value",
    )
    split = ["file", "block"]
    # The order of lines is that of their reading, so it is used and stored before anything else.
    stored = settle(
        lines.mapInPandas(
            _counted, "file string, block long, quotes long, value string, before long, even long, odd long"
        )
    )
    quotes = stored.groupBy(*split).agg(
        F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd")
    )
    opened = quotes.join(_starts(quotes, "quotes", "earlier"), split).withColumn(
        "inside", F.col("earlier") % 2 == 1
    )
    counts = opened.withColumn("records", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    starts = opened.select(*split, "inside").join(_starts(counts, "records", "records"), split)
    placed = stored.join(F.broadcast(settle(starts)), split)  # a row per split
    odd_before = (F.col("before") % 2 == 1) != F.col("inside")
    numbered = placed.select(
        *split, "value", "before", "even", "odd",
        (F.col("records") + F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))).alias("record"),
        # Whole records on a line of their own: it begins one, and its quotes are closed.
        (~odd_before & (F.col("quotes") % 2 == 0)).alias("whole"),
    )
    whole = numbered.where("whole").select("file", "record", F.col("value").alias("text"))
    # A line's place in its split: the lines that begin a record under either start add up to it.
    at = F.col("even") + F.col("odd")
    ordered = F.sort_array(F.collect_list(F.struct("block", at.alias("at"), "value")))
    broken = numbered.where("NOT whole").groupBy("file", "record").agg(
        F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("text")
    )
    return whole.unionByName(broken)


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings; names come from the header, which every file has.

    Quotes inside a quoted field are doubled, and quotes only occur around fields. Blank lines are
    no records.
    """
    names = spark.read.csv(path, header=True, sep=sep, quote=QUOTE, escape=QUOTE).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    records = quoted_records(spark, path).where(F.col("record") > 1).select(  # the header is the first
        F.regexp_replace("text", "\r$", "").alias("text")
    )
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE}
    parsed = F.from_csv("text", schema, options).alias("r")
    return records.where(F.trim("text") != "").select(parsed).select("r.*")
