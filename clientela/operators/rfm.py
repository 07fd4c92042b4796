"""Customer-grain recency, frequency and value, and cohort retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.scalars import (
    exact_mean,
    half_even,
    half_year,
    money,
    month_key,
    months_between_months,
    whole_days,
)


def _guarded(latest: Column, snapshot: Column) -> Column:
    message = F.lit("snapshot lies before the latest purchase")
    return F.when(latest > snapshot, F.raise_error(message)).otherwise(latest)


def rfm(orders: DataFrame, snapshot: str, one_row_per_order: bool = True) -> DataFrame:
    """One row per customer: recency in whole days, orders, value, mean value, items, review.

    ``orders`` is the order base, which holds each order once; pass
    ``one_row_per_order=False`` for input that repeats orders. The query fails when a
    purchase lies after the snapshot.
    """
    at = F.lit(snapshot).cast("timestamp_ntz")
    value = money("monetary_value")
    frequency = F.count("order_id") if one_row_per_order else F.count_distinct("order_id")
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        orders.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            whole_days(_guarded(F.max("order_purchase_timestamp"), at), at).alias("Recency"),
            frequency.alias("Frequency"),
            F.coalesce(F.sum(value), zero).cast("decimal(18,2)").alias("Monetary"),
            exact_mean(F.sum(value), F.count(value)).alias("Avg_Order_Value"),
            F.coalesce(F.sum("n_items"), F.lit(0)).alias("Items"),
            F.avg("review_score").alias("Avg_Review"),
        )
    )


def first_purchase(orders: DataFrame) -> DataFrame:
    """The order table with each customer's first purchase on every row.

    Joined back from an aggregate, so that a customer with very many orders is reduced
    before the shuffle and the join can be split.
    """
    firsts = (
        orders.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.min("order_purchase_timestamp").alias("first_purchase"))
    )
    return orders.join(firsts, "customer_unique_id")


def customer_months(orders: DataFrame) -> DataFrame:
    """Customer, cohort month and month index: one row per customer and active month."""
    months = (
        orders.where(F.col("customer_unique_id").isNotNull())
        .select(
            "customer_unique_id",
            F.trunc("order_purchase_timestamp", "month").alias("month"),
        )
        .distinct()
    )
    # At most one row per customer and calendar month is left, so the window stays small.
    start = F.min("month").over(Window.partitionBy("customer_unique_id"))
    return months.select(
        "customer_unique_id",
        month_key(start).alias("Safra"),
        months_between_months(start, F.col("month")).cast("smallint").alias("MesIndice"),
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Customers that return, by month of first purchase and months since then."""
    retained = customer_months(orders).groupBy("Safra", "MesIndice").agg(
        F.count(F.lit(1)).alias("Clientes_Retidos")
    )
    at_start = F.when(F.col("MesIndice") == 0, F.col("Clientes_Retidos"))
    size = F.max(at_start).over(Window.partitionBy("Safra"))
    return (
        retained.withColumn("Tamanho_Safra", size)
        .withColumn("Pct_Retencao", half_even(F.col("Clientes_Retidos") / F.col("Tamanho_Safra"), 4))
        .orderBy("Safra", "MesIndice")
    )


def weighted_retention(cohort: DataFrame, *by: str) -> DataFrame:
    """Retained customers over cohort sizes. Cohorts without a row do not count.

    The grid is sparse: a cohort from which nobody returned in a month has no row there.
    """
    keyed = cohort.withColumn("Semestre", half_year("Safra"))
    return keyed.groupBy(*by).agg(
        F.sum("Clientes_Retidos").alias("Clientes_Retidos"),
        F.sum("Tamanho_Safra").alias("Tamanho_Safra"),
        F.try_divide(F.sum("Clientes_Retidos"), F.sum("Tamanho_Safra")).alias("Retencao"),
    )


def dense_retention(cohort: DataFrame) -> DataFrame:
    """The retention grid with a row for every month that a cohort could have been seen.

    A cohort from which nobody returned in a month has 0 there, and so counts in
    :func:`weighted_retention`. The last month is the last one in which anybody bought.
    """
    month = F.to_date(F.concat("Safra", F.lit("-01")))
    seen = F.add_months(month, F.col("MesIndice").cast("int"))
    last = cohort.agg(F.max(seen).alias("last"), F.lit(1).alias("one"))
    sizes = cohort.where(F.col("MesIndice") == 0).select(
        "Safra", F.col("Clientes_Retidos").alias("Tamanho_Safra"), F.lit(1).alias("one")
    )
    months = F.months_between("last", month).cast("int")
    grid = sizes.join(F.broadcast(last), "one").select(  # one row per cohort
        "Safra", "Tamanho_Safra", F.explode(F.sequence(F.lit(0), months)).alias("MesIndice")
    )
    found = cohort.select("Safra", F.col("MesIndice").cast("int").alias("MesIndice"), "Clientes_Retidos")
    kept = F.coalesce("Clientes_Retidos", F.lit(0))
    return grid.join(found, ["Safra", "MesIndice"], "left").select(
        "Safra",
        "MesIndice",
        kept.alias("Clientes_Retidos"),
        "Tamanho_Safra",
        half_even(kept / F.col("Tamanho_Safra"), 4).alias("Pct_Retencao"),
    )


def retention_heatmap(cohort: DataFrame, from_half_year: str = "2017-S1", months: int = 6) -> DataFrame:
    """Weighted retention per half-year and month index 1 to ``months``."""
    cells = cohort.where(
        F.col("MesIndice").between(1, months) & (half_year("Safra") >= from_half_year)
    )
    return weighted_retention(cells, "Semestre", "MesIndice")
