"""Writing marts: typed customer and order exports, locale CSV, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientela.functions.scalars import half_even, text_or_nan

BYTE_ORDER_MARK = "\ufeff"


def write_locale_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write ``;``-separated UTF-8 text with a byte-order mark and decimal commas.

    ``single_file`` is for small marts that a spreadsheet opens; large ones stay in parts.
    """
    columns: list[Column] = []
    for i, field in enumerate(df.schema):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            value = F.replace(value.cast("string"), F.lit("."), F.lit(","))
        columns.append(value.alias((BYTE_ORDER_MARK if i == 0 else "") + field.name))
    out = df.select(columns)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, sep=";", header=True, encoding="UTF-8", emptyValue="")


def write_parquet_mart(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def _cast_present(df: DataFrame, casts: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: c for name, c in casts.items() if name in df.columns})


def _rounded(name: str, digits: int) -> Column:
    return half_even(F.col(name).cast("double"), digits).cast("float")


def customer_export(rfm: DataFrame, export_date: str, version: str = "v1.0") -> DataFrame:
    """The customer mart with its storage types and two columns that trace the export."""
    casts: dict[str, Column] = {
        "customer_unique_id": text_or_nan("customer_unique_id"),
        "Recency": F.col("Recency").cast("int"),
        "Frequency": F.col("Frequency").cast("smallint"),
        "Cluster": F.col("Cluster").cast("tinyint"),
    }
    for name in ("Monetary", "Avg_Order_Value", "Avg_Review", "CLV_12m"):
        casts[name] = _rounded(name, 2)
    for name in ("R_score", "F_score", "M_score", "RFM_score"):
        casts[name] = F.col(name).try_cast("tinyint")
    for name in (
        "RFM_bucket",
        "RFM_segment",
        "Revenue_segment",
        "Recency_segment",
        "Strategic_segment",
        "Cluster_Name",
    ):
        casts[name] = text_or_nan(name)
    return _cast_present(rfm, casts).withColumns(
        {"dt_exportacao": F.lit(export_date), "versao_modelo": F.lit(version)}
    )


def order_export(orders: DataFrame) -> DataFrame:
    """The order mart with its storage types; the purchase time is reduced to its date."""
    casts: dict[str, Column] = {
        "order_id": text_or_nan("order_id"),
        "customer_unique_id": text_or_nan("customer_unique_id"),
        "total_payment": _rounded("total_payment", 2),
        "total_items_value": _rounded("total_items_value", 2),
        "review_score": _rounded("review_score", 1),
        "n_items": F.col("n_items").try_cast("smallint"),
        "Cluster": F.col("Cluster").cast("tinyint"),
        "order_purchase_timestamp": F.date_format("order_purchase_timestamp", "yyyy-MM-dd"),
    }
    for name in ("Cluster_Name", "payment_type", "product_category"):
        casts[name] = text_or_nan(name)
    return _cast_present(orders, casts)
