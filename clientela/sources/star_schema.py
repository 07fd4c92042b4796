"""The order model read from order, line-item, customer and part tables.

Lets the operators run on the star schema of a trading company: lines are items, the lines
already billed (status F) are payments, and the quantity of a line stands for its rating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.functions.scalars import money
from clientela.sources.tables import Tables

STATUS = "F"
SNAPSHOT = "2001-09-01"
EVENT_SNAPSHOT = "2024-02-01"
PROMISED_DAYS = 36


# Known schemas spare the job that would read them from a file footer.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    reader = spark.read
    if table in SCHEMAS:
        reader = reader.schema(SCHEMAS[table])
    return reader.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def model_tables(spark: SparkSession, folder: str, with_delivery: bool = False) -> Tables:
    """The five tables of the order model, products and category names.

    ``with_delivery`` adds the delivery dates, which need a pass over the lines.
    """
    orders = read(spark, folder, "orders")
    lines = read(spark, folder, "lineitem")
    part = read(spark, folder, "part")
    customer, nation = read(spark, folder, "customer"), read(spark, folder, "nation")

    model_orders = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    if with_delivery:
        delivered = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.max("l_shipdate").alias("order_delivered_customer_date")
        )
        model_orders = model_orders.join(delivered, "order_id", "left").withColumn(
            "order_estimated_delivery_date",
            F.col("order_purchase_timestamp") + F.expr(f"INTERVAL {PROMISED_DAYS} DAYS"),
        )

    price, tax = money("l_extendedprice"), F.col("l_tax").cast("decimal(4,2)")
    rebate = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        F.round(price * tax, 2).cast("decimal(18,2)").alias("freight_value"),
    )
    payments = lines.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.pmod(F.col("l_partkey"), F.lit(12)).cast("int").alias("payment_installments"),
        F.round(price * rebate, 2).cast("decimal(18,2)").alias("payment_value"),
    )
    reviews = lines.select(
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.pmod(F.col("l_quantity").cast("int"), F.lit(5)) + 1).alias("review_score"),
        F.when(F.col("l_discount") > 0, F.col("l_shipdate")).alias("review_creation_date"),
    )
    category = F.when(
        F.col("p_size") % 10 != 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"), category.alias("product_category_name")
    )
    translation = (
        products.where(
            F.col("product_category_name").isNotNull()
            & ~F.col("product_category_name").startswith("small")
        )
        .select("product_category_name")
        .distinct()
        .withColumn("product_category_name_english", F.upper("product_category_name"))
    )
    customers = customer.join(
        nation, customer.c_nationkey == nation.n_nationkey, "left"
    ).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
    )
    return Tables(
        orders=model_orders,
        customers=customers,
        order_items=items,
        payments=payments,
        reviews=reviews,
        products=products,
        category_translation=translation,
    )


def event_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as an order base with times of day."""
    return (
        read(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_unique_id"),
            F.col("ts").alias("order_purchase_timestamp"),
            money("value").alias("monetary_value"),
            F.lit(1).cast("bigint").alias("n_items"),
            F.lit(None).cast("double").alias("review_score"),
        )
    )
