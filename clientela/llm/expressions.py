"""Column expressions shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the separators of words, blank and the control characters from tab to return.
SEPARATORS = r"[\x20\x09-\x0D]"
SEPARATOR_CHARACTERS = " \t\n\x0b\f\r"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARACTERS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"{SEPARATORS}+")
    )


def hashes_of(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def windows(items: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` items; none if there are fewer."""
    starts = F.when(
        F.size(items) >= width, F.sequence(F.lit(1), F.size(items) - (width - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(items, i, width)))
