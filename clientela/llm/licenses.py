"""License texts in documents: MinHash bands find candidate templates, exact containment decides.

Words are compared in lower case without punctuation, in shingles of three, as the shortest notices
have three words. Texts are read in overlapping windows, and templates are cut into pieces of that
length. A window and a piece are candidates if they agree in one of the bands; as many bands are
used as it takes for a piece that lies in a window to be found with probability ``SURE`` at least,
even if the rest of the window is foreign.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.session import settle

from .expressions import bind, hashes_of, windows

SHINGLE, WINDOW, STEP = 3, 16, 8
SURE, CONTAINED = 0.99, 0.8
BANDS = math.ceil(math.log(1 - SURE) / math.log(1 - 1 / (WINDOW - SHINGLE + 1)))

# Notices of public licenses.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under "
    "the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
    "this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits; null and blank texts have none."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def shingles(text: Column) -> Column:
    return bind(hashes_of(plain_words(text)), lambda h: windows(h, SHINGLE))


def stretches(grams: Column) -> Column:
    """Windows as (start, grams), ``start`` the word (from 1) that each begins with."""
    last = F.greatest(F.size(grams) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(STEP)),
        lambda at: F.struct(
            (at + 1).alias("start"),
            F.slice(grams, at + 1, WINDOW - SHINGLE + 1).alias("grams"),
        ),
    )


def bands(grams: Column) -> Column:
    """(band, value): the least hash of the shingles under each band's hash function."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda band: F.struct(
            band.alias("band"),
            F.array_min(F.transform(grams, lambda g: F.xxhash64(g, band))).alias("value"),
        ),
    )


def scan(
    df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and template that it holds: id, license, ``start`` (first word of the
    best place, from 1) and ``containment`` (share of the template's shingles found there).

    Null texts and texts of fewer than three words hold none. Of repeated rows and places the best
    and then first place counts once for each id. Templates need three words at least.
    """
    spark = df.sparkSession
    named = spark.createDataFrame(
        list((TEMPLATES if templates is None else templates).items()), "license string, text string"
    )
    # The templates are given by the caller, not found in the data; pieces fit on the driver.
    whole = named.select("license", F.array_distinct(shingles(F.col("text"))).alias("wanted"))
    known = [(r["license"], r["wanted"]) for r in whole.collect()]
    if any(not wanted for _, wanted in known):
        raise ValueError("a template needs three words")
    pieces = (
        named.select("license", F.explode(stretches(shingles(F.col("text")))).alias("s"))
        .where(F.size("s.grams") > 0)
        .select("license", F.explode(bands(F.col("s.grams"))).alias("b"))
        .select("license", "b.band", "b.value")
        .distinct()
    )
    every = sorted({gram for _, wanted in known for gram in wanted})
    literal = F.array(*[F.lit(gram).cast("long") for gram in every])

    def holds(grams: Column) -> Column:
        return F.arrays_overlap(grams, literal)

    # A window can only agree with a piece in a shingle that both have. With it goes what lies
    # around, as far as a template can reach; the rest of the text stays behind.
    reach = max(len(wanted) for _, wanted in known) + WINDOW
    ahead = 2 * reach + WINDOW

    def surroundings(grams: Column) -> Column:
        held = F.filter(stretches(grams), lambda s: holds(s["grams"]))
        return F.transform(
            held,
            lambda s: F.struct(
                bands(s["grams"]).alias("bands"),
                F.greatest(s["start"] - reach, F.lit(1)).alias("first"),
                F.slice(grams, F.greatest(s["start"] - reach, F.lit(1)), ahead).alias("near"),
            ),
        )

    texts = settle(
        df.select(F.col(id_col).alias("id"), shingles(F.col(text_col)).alias("grams")).where(
            holds(F.col("grams"))
        )
    )
    parts = texts.select("id", F.explode(surroundings(F.col("grams"))).alias("s"))
    candidates = (
        parts.select("id", "s.first", "s.near", F.explode("s.bands").alias("b"))
        .select("id", "first", "near", "b.band", "b.value")
        .join(F.broadcast(pieces), ["band", "value"])  # some pieces of each template given
        .select("id", "license", "first", "near")
        .distinct()  # a window agrees in many bands
        .join(F.broadcast(spark.createDataFrame(known, "license string, wanted array<bigint>")),
              "license")
    )
    found = F.array_intersect("wanted", "near")
    place = F.array_position(F.transform("near", lambda g: F.array_contains("wanted", g)), F.lit(True))
    return (
        candidates.select(
            "id",
            "license",
            (F.col("first") + place.cast("int") - 1).alias("start"),
            (F.size(found) / F.size("wanted")).alias("containment"),
        )
        .where(F.col("containment") >= CONTAINED)
        .groupBy(F.col("id").alias(id_col), "license")
        .agg(F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("best"))
        .select(id_col, "license", (-F.col("best.start")).alias("start"), "best.containment")
    )
