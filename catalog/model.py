"""Tables that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientela.operators.orders import enrich_orders, orders_base
from clientela.operators.quality import latest_review
from clientela.operators.rfm import rfm
from clientela.operators.segments import assign_cluster_names, lifetime_value
from clientela.session import settle
from clientela.sources.star_schema import SNAPSHOT, STATUS, model_tables
from clientela.sources.tables import Tables


def tidy(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Whole numbers as bigint, decimals as double; doubles rounded where order of sums matters."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DoubleType) and digits is not None:
            scale = float(10**digits)
            c = F.rint(c * scale) / scale
        columns.append(c.alias(field.name))
    return df.select(columns)


def tables(spark: SparkSession, folder: str, with_delivery: bool = False) -> Tables:
    found = model_tables(spark, folder, with_delivery)
    return found.with_(reviews=latest_review(found.reviews))


def base(spark: SparkSession, folder: str, category: bool = False) -> DataFrame:
    """The order base; its category is looked up only for those who read it."""
    return orders_base(tables(spark, folder), STATUS, with_category=category)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return rfm(orders_base(tables(spark, folder), STATUS, with_category=False), SNAPSHOT)


def stored_customers(spark: SparkSession, folder: str) -> DataFrame:
    return settle(customers(spark, folder))


def rule_cluster() -> Column:
    """A fixed grouping that stands in for fitted clusters where results must be repeatable."""
    return (
        F.when(F.col("Recency") > 365, 2)
        .when(F.col("Frequency") >= 5, 0)
        .when(F.col("Monetary") >= 500_000, 3)
        .otherwise(1)
    )


def marts(
    spark: SparkSession, folder: str, payments: bool = False, category: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The customer mart with named groups and lifetime value, and the order mart, whose category is
    looked up only for those who read it."""
    found = tables(spark, folder)
    orders = settle(orders_base(found, STATUS, with_category=category))
    people = settle(
        lifetime_value(rfm(orders, SNAPSHOT).withColumn("Cluster", rule_cluster()))
    )
    people = assign_cluster_names(people)
    return people, enrich_orders(orders, people, found.payments if payments else None)


def customer_mart(spark: SparkSession, folder: str) -> DataFrame:
    """The customer mart alone."""
    people = customers(spark, folder).withColumn("Cluster", rule_cluster())
    return assign_cluster_names(settle(lifetime_value(people)))
