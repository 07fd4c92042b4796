"""Order-grain tables: per-order totals, the order base, and enrichments.

Every one-to-many side is reduced to one row per order before it is joined, so no join
multiplies rows and all of them share the partitioning by ``order_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.scalars import exact_mean, money, title_words
from clientela.sources.tables import Tables

NO_ITEMS = "Não informado"  # fixed value: order without items
NO_CATEGORY = "nao_informado"  # fixed value: item without category
UNTRANSLATED = "desconhecida"  # fixed value: category without translation


def _zero_if_empty(total: Column) -> Column:
    """A sum over rows that are all null is zero, not null."""
    return F.coalesce(total, F.lit(0).cast("decimal(18,2)"))


def dearest_product() -> Column:
    """Aggregate: product of the dearest item."""
    price = F.col("price")
    order = F.struct(price.isNull(), -money(price), F.col("order_item_id"), F.col("product_id"))
    return F.min_by(F.col("product_id"), order)


def order_item_totals(items: DataFrame, with_product: bool = False) -> DataFrame:
    """Item value and item count per order; with the dearest item's product on request."""
    extra = [dearest_product().alias("product_id")] if with_product else []
    return items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        _zero_if_empty(F.sum(money("price"))).alias("total_items_value"),
        F.count("order_item_id").alias("n_items"),
        *extra,
    )


def order_payment_totals(payments: DataFrame) -> DataFrame:
    """Paid value and number of payment steps per order."""
    return payments.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        _zero_if_empty(F.sum(money("payment_value"))).alias("total_payment"),
        F.max("payment_sequential").alias("n_payments"),
    )


def order_review_mean(reviews: DataFrame) -> DataFrame:
    """Mean review score per order."""
    score = F.col("review_score")
    return reviews.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        exact_mean(F.sum(score.cast("decimal(18,2)")), F.count(score)).alias("review_score")
    )


def dearest_item_product(items: DataFrame) -> DataFrame:
    """The product of the dearest item per order.

    An item without a price counts as the cheapest; ties go to the lowest item and product.
    """
    return (
        items.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(dearest_product().alias("product_id"))
    )


def dominant_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Display category of the dearest item per order."""
    return _with_category(dearest_item_product(items), products).select(
        "order_id", "product_category"
    )


def _with_category(per_order: DataFrame, products: DataFrame) -> DataFrame:
    category = products.select("product_id", "product_category_name")
    return per_order.join(category, "product_id", "left").withColumn(
        "product_category",
        title_words(F.coalesce("product_category_name", F.lit(NO_CATEGORY))),
    )


def translated_names(products: DataFrame, translation: DataFrame) -> DataFrame:
    """The translated category of every product that has one."""
    return products.select("product_id", "product_category_name").join(
        translation, "product_category_name", "left"
    ).drop("product_category_name")


def translated_category(
    items: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Translated category of the dearest item per order."""
    return (
        dearest_item_product(items)
        .join(translated_names(products, translation), "product_id", "left")
        .select(
            "order_id",
            F.coalesce("product_category_name_english", F.lit(UNTRANSLATED)).alias("cat"),
        )
    )


def largest_payment_type() -> Column:
    """Aggregate: type of the single largest payment; ties go to the lowest step."""
    value = F.col("payment_value")
    order = F.struct(
        value.isNull(), -money(value), F.col("payment_sequential"), F.col("payment_type")
    )
    return F.min_by("payment_type", order)


def dominant_payment_row(payments: DataFrame) -> DataFrame:
    """Type of the single largest payment per order."""
    return (
        payments.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(largest_payment_type().alias("payment_type"))
    )


def dominant_payment_sum(payments: DataFrame) -> DataFrame:
    """Payment type with the largest total per order; ties go to the first name."""
    by_type = (
        payments.where(F.col("order_id").isNotNull() & F.col("payment_type").isNotNull())
        .groupBy("order_id", "payment_type")
        .agg(_zero_if_empty(F.sum(money("payment_value"))).alias("value"))
    )
    order = F.struct(-F.col("value"), F.col("payment_type"))
    return by_type.groupBy("order_id").agg(F.min_by("payment_type", order).alias("payment_type"))


def orders_base(
    tables: Tables, status: str = "delivered", with_category: bool = True
) -> DataFrame:
    """One row per order of the given status with value, items, review, customer and category.

    The order value is what was paid, or the item value where no payment is known. The
    category needs ``products``; leave it out where nobody reads it.
    """
    with_product = with_category and tables.products is not None
    base = (
        tables.orders.where(F.col("order_status") == status)
        .select("order_id", "customer_id", "order_purchase_timestamp")
        .join(order_item_totals(tables.order_items, with_product), "order_id", "left")
        .join(order_payment_totals(tables.payments), "order_id", "left")
        .join(order_review_mean(tables.reviews), "order_id", "left")
        .join(
            tables.customers.select("customer_id", "customer_unique_id", "customer_state"),
            "customer_id",
            "left",
        )
        .withColumn("monetary_value", F.coalesce("total_payment", "total_items_value"))
    )
    if not with_product:
        return base
    category = tables.products.select("product_id", "product_category_name")
    return (
        base.join(category, "product_id", "left")
        .withColumn(
            "product_category",
            F.when(F.col("n_items").isNull(), F.lit(NO_ITEMS)).otherwise(
                title_words(F.coalesce("product_category_name", F.lit(NO_CATEGORY)))
            ),
        )
        .drop("product_id", "product_category_name")
    )


def enrich_orders(
    orders: DataFrame, customers: DataFrame, payments: DataFrame | None = None
) -> DataFrame:
    """Add the customer's cluster and, given payments, the order's main payment type."""
    if payments is not None:
        orders = orders.join(dominant_payment_sum(payments), "order_id", "left")
    return orders.join(
        customers.select("customer_unique_id", "Cluster", "Cluster_Name"),
        "customer_unique_id",
        "left",
    )


def payment_mix(enriched: DataFrame) -> DataFrame:
    """Orders per cluster and payment type, and their share within the cluster."""
    counts = (
        enriched.where(F.col("payment_type").isNotNull() & F.col("Cluster_Name").isNotNull())
        .groupBy("Cluster_Name", "payment_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_cluster = F.sum("n").over(Window.partitionBy("Cluster_Name"))
    return counts.withColumn("pct", F.col("n") / in_cluster)
