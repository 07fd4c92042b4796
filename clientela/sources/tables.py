"""Loading the order tables."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.sources.quoted_csv import read_quoted_csv

# Columns that operators rely on, with their types. Others are kept as read.
TABLE_TYPES: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_state": "string",
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "price": "decimal(18,2)",
        "freight_value": "decimal(18,2)",
    },
    "payments": {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "decimal(18,2)",
    },
    "reviews": {
        "review_id": "string",
        "order_id": "string",
        "review_score": "int",
        "review_creation_date": "timestamp_ntz",
    },
    "products": {"product_id": "string", "product_category_name": "string"},
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}
OPTIONAL_TABLES = ("products", "category_translation")


@dataclass(frozen=True)
class Tables:
    """The order model. ``products`` and ``category_translation`` may be missing."""

    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame | None = None
    category_translation: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Tables:
        return replace(self, **tables)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the known columns; values that do not parse become null."""
    known = {c: t for c, t in types.items() if c in df.columns}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in known.items()})


def _read(spark: SparkSession, path: str, fmt: str, free_text: bool) -> DataFrame:
    try:
        if fmt == "csv" and free_text:  # only review comments contain line breaks
            return read_quoted_csv(spark, path)
        if fmt == "csv":
            return spark.read.csv(path, header=True, quote='"', escape='"')
        return spark.read.format(fmt).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(path) from missing
        raise


def load_tables(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    file_names: Mapping[str, str] | None = None,
) -> Tables:
    """Read the five required tables and, where present, the two optional ones.

    Raises ``FileNotFoundError`` for a missing required table and warns for an optional one.
    """
    found: dict[str, DataFrame] = {}
    for table, types in TABLE_TYPES.items():
        name = (file_names or {}).get(table, f"{table}.{fmt}")
        try:
            raw = _read(spark, f"{folder.rstrip('/')}/{name}", fmt, free_text=table == "reviews")
        except FileNotFoundError:
            if table not in OPTIONAL_TABLES:
                raise
            warnings.warn(f"optional table {table} not found: {name}", stacklevel=2)
            continue
        found[table] = typed(raw, types)
    return Tables(**found)
