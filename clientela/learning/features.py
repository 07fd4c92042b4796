"""Feature tables of the two models: risk of a bad review, and repeat purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.functions.scalars import (
    at_least,
    money,
    number,
    safe_ratio,
    text_or_nan,
    weekday_from_monday,
    whole_days,
)
from clientela.operators.ordering import quantiles
from clientela.operators.orders import (
    UNTRANSLATED,
    dearest_product,
    largest_payment_type,
    translated_names,
)
from clientela.operators.quality import first_review
from clientela.session import settle
from clientela.sources.tables import Tables

BAD_REVIEW = 2  # fixed value: highest score of a bad review

# Feature names of the two models.
REVIEW_NUMERIC = [
    "atraso_dias",
    "tempo_entrega_dias",
    "prazo_estimado_dias",
    "atrasou",
    "price_total",
    "freight_total",
    "freight_ratio",
    "valor_por_item",
    "n_items",
    "n_sellers",
    "n_products",
    "payment_value",
    "installments",
    "n_payment_methods",
    "mes",
    "dow",
]
REVIEW_CATEGORIES = ["cat", "customer_state", "payment_type"]
REPEAT_NUMERIC = [
    "first_payment",
    "first_items_value",
    "n_items",
    "n_payments",
    "review_score",
    "freight_proxy",
    "avg_item_value",
    "review_missing",
    "month",
    "quarter",
    "dow",
    "year",
]
REPEAT_CATEGORIES = ["state", "category"]


def delivery_time_features(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """Delays in whole days, late flag, month and weekday of delivered orders.

    Orders that lack one of the three dates are left out.
    """
    bought = "order_purchase_timestamp"
    delivered = "order_delivered_customer_date"
    promised = "order_estimated_delivery_date"
    known = orders.where(F.col("order_status") == status).dropna(
        subset=[bought, delivered, promised]
    )
    return known.withColumns(
        {
            "atraso_dias": whole_days(promised, delivered),
            "tempo_entrega_dias": whole_days(bought, delivered),
            "prazo_estimado_dias": whole_days(bought, promised),
            "mes": F.month(bought),
            "dow": weekday_from_monday(bought),
        }
    ).withColumn("atrasou", (F.col("atraso_dias") > 0).cast("int"))


def item_features(items: DataFrame, with_product: bool = False) -> DataFrame:
    """Value, freight, items, distinct sellers and products per order, in one pass over the items;
    with the dearest item's product on request.

    The items are brought together as they are, once: distinct counts would send every row three
    times, and sums by order before the shuffle spare little, as an order has few items.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    extra = [dearest_product().alias("product_id")] if with_product else []
    narrow = items.where(F.col("order_id").isNotNull()).select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"
    )

    def distinct(name: str) -> Column:
        return F.size(F.collect_set(name)).cast("bigint")

    return narrow.repartition("order_id").groupBy("order_id").agg(
        F.coalesce(F.sum(money("price")), zero).alias("price_total"),
        F.coalesce(F.sum(money("freight_value")), zero).alias("freight_total"),
        F.count("order_item_id").alias("n_items"),
        distinct("seller_id").alias("n_sellers"),
        distinct("product_id").alias("n_products"),
        *extra,
    )


def payment_features(payments: DataFrame) -> DataFrame:
    """Paid value, highest number of instalments and of payment steps, and main type per order."""
    zero = F.lit(0).cast("decimal(18,2)")
    return payments.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.coalesce(F.sum(money("payment_value")), zero).alias("payment_value"),
        F.max("payment_installments").alias("installments"),
        F.max("payment_sequential").alias("n_payment_methods"),
        largest_payment_type().alias("payment_type"),
    )


def review_features(tables: Tables, status: str = "delivered") -> DataFrame:
    """Order id, features known at delivery, and the target ``y``: a first review of 2 or less."""
    label = first_review(tables.reviews).select("order_id", "review_score")
    items = item_features(tables.order_items, with_product=True)
    joined = (
        delivery_time_features(tables.orders, status)
        .join(items, "order_id")
        .join(label, "order_id")
        .join(translated_names(tables.products, tables.category_translation), "product_id", "left")
        .withColumn("cat", F.coalesce("product_category_name_english", F.lit(UNTRANSLATED)))
        .join(payment_features(tables.payments), "order_id", "left")
        .join(tables.customers.select("customer_id", "customer_state"), "customer_id", "left")
    )
    price = number("price_total")
    complete = joined.withColumns(
        {
            "freight_ratio": safe_ratio(number("freight_total"), price),
            "valor_por_item": safe_ratio(price, "n_items"),
        }
    )
    bad = F.coalesce(F.col("review_score") <= BAD_REVIEW, F.lit(False))
    return complete.select(
        "order_id",
        *[number(c).alias(c) for c in REVIEW_NUMERIC],
        *[text_or_nan(c).alias(c) for c in REVIEW_CATEGORIES],
        bad.cast("int").alias("y"),
    )


def first_order_per_customer(orders: DataFrame, mode: str = "column") -> DataFrame:
    """One row per customer from the earliest orders (ties by order id), with ``n_orders``.

    ``column`` takes the first known value of each column by itself, so that columns may come
    from different orders; ``row`` takes the first order as it is.
    """
    columns = [c for c in orders.columns if c != "customer_unique_id"]
    order = F.struct("order_purchase_timestamp", "order_id")
    known = orders.where(F.col("customer_unique_id").isNotNull())
    ordered = F.when(F.col("order_purchase_timestamp").isNotNull(), order)
    if mode == "row":
        first = [F.min_by(F.struct(*columns), ordered).alias("_first")]
        chosen = ["_first.*"]
    elif mode == "column":
        first = [
            F.min_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(c) for c in columns
        ]
        chosen = columns
    else:
        raise ValueError(f"unknown mode {mode}")
    grouped = known.groupBy("customer_unique_id").agg(
        *first, F.count(F.lit(1)).alias("n_orders")
    )
    return grouped.select("customer_unique_id", *chosen, "n_orders")


def repeat_features(orders: DataFrame, mode: str = "column") -> DataFrame:
    """Customer id, features of the first order, and the target ``y``: two or more orders.

    ``orders`` is the order mart, whose purchase times are dates. Missing review scores
    become the median of the known ones.
    """
    dated = orders.withColumn(
        "order_purchase_timestamp", F.to_date("order_purchase_timestamp")
    )
    first = settle(first_order_per_customer(dated, mode))
    middle = quantiles(first, "review_score", {"median": 0.5}).first()
    median = middle["median"] if middle is not None else None
    paid, items = number("total_payment"), number("total_items_value")
    ts = "order_purchase_timestamp"
    return first.select(
        "customer_unique_id",
        paid.alias("first_payment"),
        items.alias("first_items_value"),
        number("n_items").alias("n_items"),
        number("n_payments").alias("n_payments"),
        F.coalesce(number("review_score"), F.lit(median).cast("double")).alias("review_score"),
        at_least(
            (F.col("total_payment") - F.col("total_items_value")).cast("double"), 0.0
        ).alias("freight_proxy"),
        safe_ratio(items, "n_items").alias("avg_item_value"),
        number(F.col("review_score").isNull().cast("int")).alias("review_missing"),
        number(F.month(ts)).alias("month"),
        number(F.quarter(ts)).alias("quarter"),
        number(weekday_from_monday(ts)).alias("dow"),
        number(F.year(ts)).alias("year"),
        text_or_nan("customer_state").alias("state"),
        text_or_nan("product_category").alias("category"),
        (F.col("n_orders") >= 2).cast("int").alias("y"),
    )


def repeat_targets(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """For every customer whether two or more orders are known; customers without any have 0."""
    counts = orders.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("n"))
    people = customers.select("customer_unique_id")
    repeat = (F.coalesce("n", F.lit(0)) >= 2).cast("int")
    return people.join(counts, "customer_unique_id", "left").select(
        "customer_unique_id", repeat.alias("repeat")
    )
