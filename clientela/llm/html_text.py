"""Main texts of web pages by the wrappers of their hosts."""

from __future__ import annotations

import functools
import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.session import settle

from . import wrappers
from .shipping import ship

HOSTS_HELD = 2_000  # wrappers a task holds before it hands them on
SALTS = 32


def host_of(url: Column) -> Column:
    """Lower-case host name; empty where there is none."""
    return F.coalesce(
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)),
        F.lit(""),
    )


def infer_wrappers(
    df: DataFrame, url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``host``, ``wrapper`` (pickled ``wrappers.Node``): one row per host.

    All pages of a host are aligned: within each task first, then what the tasks found, in two
    steps, so that a host with most of the pages is spread over all tasks. Pages without a host
    share one wrapper.
    """
    ship(df.sparkSession)

    def of_pages(frames):
        import pandas as pd

        held: dict[str, wrappers.Node] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame(
                {"host": list(held), "wrapper": [pickle.dumps(w) for w in held.values()]}
            )
            held.clear()
            return out

        for frame in frames:
            for host, page in zip(frame["host"], frame["html"]):
                node = wrappers.folded(wrappers.tree(page))
                held[host] = wrappers.align(held[host], node) if host in held else node
                if len(held) >= HOSTS_HELD:
                    yield hand_on()
        if held:  # a frame without rows has no types
            yield hand_on()

    def joined(frame):
        import pandas as pd

        found = [pickle.loads(w) for w in sorted(frame["wrapper"], key=lambda w: (len(w), w))]
        whole = pickle.dumps(functools.reduce(wrappers.align, found))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [whole], "salt": [0]})

    parts = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = parts.mapInPandas(of_pages, "host string, wrapper binary")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    for keys in (["host", "salt"], ["host"]):
        salted = salted.groupBy(*keys).applyInPandas(
            joined, "host string, wrapper binary, salt long"
        )
    return salted.drop("salt")


def expressions(known: DataFrame) -> DataFrame:
    """``host``, ``expression``: the regular expression of each wrapper (see ``wrappers.matches``)."""
    ship(known.sparkSession)

    def described(frames):
        for frame in frames:
            frame["host"] = frame["host"].astype(object)
            frame["expression"] = [pickle.loads(w).expression() for w in frame.pop("wrapper")]
            yield frame

    return known.select("host", "wrapper").mapInPandas(described, "host string, expression string")


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, url, ``text`` and ``n_chars`` of every row; null and empty pages have an empty text.

    Repeated rows give a row each. Columns other than these are left out.
    """
    host = host_of(F.col(url_col))
    known = settle(infer_wrappers(df, url_col, html_col))

    def batches(frames):
        @functools.lru_cache(maxsize=256)
        def of_host(packed: bytes):
            return wrappers.regions(pickle.loads(packed))

        for frame in frames:
            frame["url"], frame["id"] = frame["url"].astype(object), frame["id"].astype(object)
            frame["text"] = [
                wrappers.main_text(page, of_host(bytes(packed)))
                for page, packed in zip(frame.pop("html"), frame.pop("wrapper"))
            ]
            yield frame

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(
            F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
            host.alias("host"),
        )
        .join(known, "host")
        .select("id", "url", "html", "wrapper")
        .mapInPandas(batches, f"id {kind}, url string, text string")
        .select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
    )
