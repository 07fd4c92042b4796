"""Checks on the raw tables, and review deduplication."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(AssertionError):
    """A table breaks a rule that later operators rely on."""


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_unique(df: DataFrame, key: str) -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise QualityError(f"{key} has duplicates")


def check_not_null(df: DataFrame, column: str) -> None:
    if not df.where(F.col(column).isNull()).isEmpty():
        raise QualityError(f"{column} has missing values")


def null_summary(df: DataFrame, column: str) -> DataFrame:
    """Rows, missing values and distinct values of one column, as one row."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c.isNull()).alias("n_null"),
        F.count_distinct(c).alias("n_distinct"),
    )


def check_orders(orders: DataFrame) -> None:
    check_unique(orders, "order_id")
    check_not_null(orders, "order_purchase_timestamp")


def check_customers(customers: DataFrame) -> None:
    check_unique(customers, "customer_id")
    missing = customers.where(F.col("customer_unique_id").isNull()).count()
    if missing:
        warnings.warn(f"{missing} customers without customer_unique_id", stacklevel=2)


def check_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_snapshot(orders: DataFrame, snapshot: str, ts: str = "order_purchase_timestamp") -> None:
    """Fail when a purchase lies after the snapshot; equality and no dates at all pass."""
    if not orders.where(F.col(ts) > F.lit(snapshot).cast("timestamp_ntz")).isEmpty():
        raise QualityError(f"purchases after the snapshot {snapshot}")


def keep_one_per_key(
    df: DataFrame, key: str, by: Sequence[Column], last: bool = False
) -> DataFrame:
    """One whole row per key: the first in the order ``by`` (or the last).

    An aggregate, not a window, so that the rows of a hot key are reduced before the shuffle.
    The result stays partitioned by ``key``. Rows without a key are dropped.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    order = F.struct(*by)
    chosen = F.max_by(row, order) if last else F.min_by(row, order)
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(chosen.alias("_row"))
    return kept.select([F.col(c if c == key else f"_row.`{c}`") for c in df.columns])


def _review_order(reviews: DataFrame, ties: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in ties if c in reviews.columns]


def latest_review(
    reviews: DataFrame,
    date: str = "review_creation_date",
    ties: Sequence[str] = ("review_id",),
) -> DataFrame:
    """Latest review per order. A review without a date counts as the latest."""
    by = [F.col(date).isNull(), F.col(date), *_review_order(reviews, ties)]
    return keep_one_per_key(reviews, "order_id", by, last=True)


def first_review(
    reviews: DataFrame,
    date: str = "review_creation_date",
    ties: Sequence[str] = ("review_id",),
) -> DataFrame:
    """Earliest review per order, dateless ones after all others: the label of the risk model."""
    by = [F.col(date).isNull(), F.col(date), *_review_order(reviews, ties)]
    return keep_one_per_key(reviews, "order_id", by)


def quality_report(df: DataFrame, name: str) -> DataFrame:
    """Rows, missing values and type per column, one row per column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("coluna"), F.lit(t).alias("tipo"), F.col(f"n{i}").alias("nulos")
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return (
        counts.select("_rows", F.explode(per_column).alias("c"))
        .select(F.lit(name).alias("tabela"), "c.coluna", "c.tipo", "c.nulos",
                F.col("_rows").alias("linhas"))
    )
