"""Quality checks, scalar functions, order-grain and customer-grain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.model import base, customers, tables, tidy
from catalog.prelude import base as sql_base
from catalog.prelude import days, half_even, title
from catalog.prelude import model as sql_model
from catalog.prelude import rfm as sql_rfm
from catalog.registry import query
from clientela.functions import scalars as fn
from clientela.operators import orders as orders_
from clientela.operators import quality
from clientela.operators.ordering import quantiles
from clientela.operators.rfm import first_purchase
from clientela.operators.rfm import rfm as build_rfm
from clientela.sources.star_schema import (
    EVENT_SNAPSHOT,
    STATUS,
    event_orders,
    model_tables,
    read,
)

# ---------------------------------------------------------------- quality


@query(
    "SELECT l_orderkey AS order_id, count(*) AS n FROM lineitem "
    "GROUP BY l_orderkey HAVING count(*) > 1"
)
def check_unique(spark: SparkSession, folder: str) -> DataFrame:
    items = model_tables(spark, folder).order_items
    return quality.duplicate_keys(items, "order_id")


@query(
    sql_model(
        "SELECT count(*) AS n_rows, count(*) FILTER (review_creation_date IS NULL) AS n_null, "
        "count(DISTINCT review_creation_date) AS n_distinct FROM m_all_reviews"
    )
)
def count_null_warn(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_summary(model_tables(spark, folder).reviews, "review_creation_date")


@query(
    sql_model(
        "SELECT order_id, review_id, review_score FROM m_all_reviews "
        "WHERE review_creation_date IS NULL"
    )
)
def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    reviews = model_tables(spark, folder).reviews
    missing = reviews.where(F.col("review_creation_date").isNull())
    return tidy(missing.select("order_id", "review_id", "review_score"))


@query(sql_model("SELECT order_id, review_id, review_score FROM m_reviews"))
def dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    latest = quality.latest_review(model_tables(spark, folder).reviews)
    return tidy(latest.select("order_id", "review_id", "review_score"))


@query(
    sql_model(
        "SELECT order_id, review_id, review_score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY order_id ORDER BY review_creation_date NULLS LAST, review_id) AS rn "
        "FROM m_all_reviews) WHERE rn = 1"
    )
)
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    first = quality.first_review(model_tables(spark, folder).reviews)
    return tidy(first.select("order_id", "review_id", "review_score"))


@query(
    "SELECT o_orderstatus AS order_status, count(*) FILTER (o_orderdate > "
    "TIMESTAMP '2001-01-01') AS n_after FROM orders GROUP BY ALL"
)
def validate_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    orders = model_tables(spark, folder).orders
    quality.check_snapshot(orders, "2001-09-01")
    late = F.col("order_purchase_timestamp") > F.lit("2001-01-01").cast("timestamp_ntz")
    return orders.groupBy("order_status").agg(F.count_if(late).alias("n_after"))


@query(
    sql_model(
        "SELECT 'reviews' AS tabela, coluna, nulos, linhas, CASE coluna WHEN 'review_score' THEN 'int' "
        "WHEN 'order_id' THEN 'bigint' WHEN 'review_id' THEN 'string' ELSE 'timestamp_ntz' END AS tipo "
        "FROM (SELECT count(*) AS linhas, "
        "count(*) - count(review_id) AS review_id, count(*) - count(order_id) AS order_id, "
        "count(*) - count(review_score) AS review_score, "
        "count(*) - count(review_creation_date) AS review_creation_date FROM m_all_reviews) "
        "UNPIVOT (nulos FOR coluna IN (review_id, order_id, review_score, review_creation_date))"
    )
)
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(model_tables(spark, folder).reviews, "reviews")


@query(sql_rfm("SELECT count(*) AS n, count(Recency) AS n_recency FROM rfm"))
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    people = customers(spark, folder)
    quality.check_columns(people, ["Recency", "Frequency", "Monetary"])
    return people.agg(F.count(F.lit(1)).alias("n"), F.count("Recency").alias("n_recency"))


# ---------------------------------------------------------------- projection and filters


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders WHERE o_orderstatus='F'")
def status_filter(spark: SparkSession, folder: str) -> DataFrame:
    orders = model_tables(spark, folder).orders
    return orders.where(F.col("order_status") == STATUS).select("order_id", "customer_id")


@query(
    sql_model(
        "SELECT order_id, review_id FROM m_all_reviews "
        "WHERE review_creation_date IS NOT NULL AND review_score IS NOT NULL"
    )
)
def drop_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    reviews = model_tables(spark, folder).reviews
    return reviews.dropna(subset=["review_creation_date", "review_score"]).select(
        "order_id", "review_id"
    )


@query(sql_model("SELECT order_id, payment_type FROM m_payments"))
def column_subset(spark: SparkSession, folder: str) -> DataFrame:
    return model_tables(spark, folder).payments.select("order_id", "payment_type")


@query(
    sql_base(
        "SELECT order_id, CAST(monetary_value AS DOUBLE) AS monetary_value, "
        "total_payment IS NULL AS fell_back FROM ob"
    )
)
def payment_fallback(spark: SparkSession, folder: str) -> DataFrame:
    orders = base(spark, folder)
    return tidy(
        orders.select(
            "order_id", "monetary_value", F.col("total_payment").isNull().alias("fell_back")
        )
    )


@query(sql_base("SELECT product_category, count(*) AS n FROM ob GROUP BY product_category"))
def literal_fill(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, category=True).groupBy("product_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql_model(
        f"SELECT product_id, {title('product_category_name')} AS display FROM m_products"
    )
)
def prettify_category(spark: SparkSession, folder: str) -> DataFrame:
    products = model_tables(spark, folder).products
    return products.select("product_id", fn.title_words("product_category_name").alias("display"))


@query(
    f"SELECT event_id, {days('ts', 'TIMESTAMP ' + repr(EVENT_SNAPSHOT))} AS age, "
    f"{days('TIMESTAMP ' + repr(EVENT_SNAPSHOT), 'ts')} AS lead FROM events"
)
def whole_days(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit(EVENT_SNAPSHOT).cast("timestamp_ntz")
    return tidy(
        read(spark, folder, "events").select(
            "event_id", fn.whole_days("ts", at).alias("age"), fn.whole_days(at, "ts").alias("lead")
        )
    )


@query(
    sql_model(
        "SELECT order_id, (year(order_purchase_timestamp) - year(f)) * 12 "
        "+ month(order_purchase_timestamp) - month(f) AS months FROM (SELECT order_id, "
        "order_purchase_timestamp, min(order_purchase_timestamp) OVER (PARTITION BY customer_id) "
        "AS f FROM m_orders)"
    )
)
def month_difference(spark: SparkSession, folder: str) -> DataFrame:
    orders = model_tables(spark, folder).orders
    dated = first_purchase(orders.withColumnRenamed("customer_id", "customer_unique_id"))
    months = fn.months_between_months("first_purchase", "order_purchase_timestamp")
    return tidy(dated.select("order_id", months.alias("months")))


@query(
    "SELECT o_orderkey AS order_id, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter, "
    "isodow(o_orderdate) - 1 AS dow, year(o_orderdate) AS year FROM orders"
)
def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    ts = "order_purchase_timestamp"
    return tidy(
        model_tables(spark, folder).orders.select(
            "order_id",
            F.month(ts).alias("month"),
            F.quarter(ts).alias("quarter"),
            fn.weekday_from_monday(ts).alias("dow"),
            F.year(ts).alias("year"),
        )
    )


@query(
    """SELECT doc_id, count(n) AS n_numbers, CAST(coalesce(sum(n), 0) AS DOUBLE) AS total FROM (
    SELECT doc_id, CASE WHEN regexp_full_match(w, '[0-9]{1,9}') THEN try_cast(w AS DOUBLE) END AS n FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents)) GROUP BY doc_id"""
)
def coerce_text(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers among the words of every whole text; a word that is none becomes null."""
    words = F.transform(
        F.split(F.coalesce("text", F.lit("")), " "),
        lambda w: F.when(w.rlike("^[0-9]{1,9}$"), fn.to_number(w)),
    )
    numbers = F.filter(words, lambda n: n.isNotNull())
    return read(spark, folder, "documents").select(
        "doc_id",
        F.size(numbers).cast("bigint").alias("n_numbers"),
        F.aggregate(numbers, F.lit(0.0), lambda total, n: total + n).alias("total"),
    )


_DATE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 25:61:00'
    WHEN 2 THEN strftime(o_orderdate, '%Y') || '-02-30' WHEN 3 THEN NULL
    WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


@query(
    f"""SELECT o_orderkey AS order_id, strftime(try_cast(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment
    FROM (SELECT o_orderkey, {_DATE_TEXT} AS t FROM orders)"""
)
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written as text, a third of them no dates: those become null."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.pmod(F.col("o_orderkey"), F.lit(6))
    text = (
        F.when(kind == 0, F.col("o_orderpriority"))
        .when(kind == 1, F.concat(day, F.lit(" 25:61:00")))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
        .when(kind == 4, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 5, day)
    )
    orders = read(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format(fn.to_moment(text), "yyyy-MM-dd HH:mm:ss").alias("moment"),
    )


@query(
    sql_base(
        "SELECT order_id, CASE WHEN total_payment IS NOT NULL THEN greatest("
        "CAST(total_payment - total_items_value AS DOUBLE), 0.0) END AS freight_proxy FROM ob"
    )
)
def clip_at_zero(spark: SparkSession, folder: str) -> DataFrame:
    gap = (F.col("total_payment") - F.col("total_items_value")).cast("double")
    return base(spark, folder).select("order_id", fn.at_least(gap, 0.0).alias("freight_proxy"))


@query(
    sql_base(
        "SELECT order_id, CAST(total_items_value AS DOUBLE) / nullif(n_items, 0) AS per_item, "
        "CAST(total_items_value AS DOUBLE) / nullif(n_payments - 1, 0) AS per_step FROM ob"
    )
)
def safe_ratio(spark: SparkSession, folder: str) -> DataFrame:
    value = fn.number("total_items_value")
    return base(spark, folder).select(
        "order_id",
        fn.safe_ratio(value, "n_items").alias("per_item"),
        fn.safe_ratio(value, F.col("n_payments") - 1).alias("per_step"),
    )


@query(
    sql_base(
        "SELECT order_id, CAST(total_payment IS NULL AS BIGINT) AS missing, coalesce("
        "CAST(total_payment AS DOUBLE), (SELECT quantile_cont(CAST(total_payment AS DOUBLE), 0.5) "
        "FROM ob)) AS payment FROM ob"
    )
)
def median_fill(spark: SparkSession, folder: str) -> DataFrame:
    orders = base(spark, folder)
    middle = quantiles(orders, "total_payment", {"m": 0.5}).first()["m"]
    return tidy(
        orders.select(
            "order_id",
            F.col("total_payment").isNull().cast("int").alias("missing"),
            F.coalesce(fn.number("total_payment"), F.lit(middle)).alias("payment"),
        )
    )


@query(
    sql_rfm(
        "SELECT customer_unique_id, round(ln(1 + Frequency), 9) AS f_log, "
        "round(ln(1 + CAST(Monetary AS DOUBLE)), 9) AS m_log FROM rfm"
    )
)
def log1p_features(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).select(
        "customer_unique_id",
        F.round(F.log1p(fn.number("Frequency")), 9).alias("f_log"),
        F.round(F.log1p(fn.number("Monetary")), 9).alias("m_log"),
    )


@query(
    sql_rfm(
        f"SELECT customer_unique_id, {half_even('Avg_Order_Value', 2)} AS aov, "
        f"{half_even('Avg_Review', 1)} AS review FROM rfm"
    )
)
def round_half_even(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).select(
        "customer_unique_id",
        fn.half_even("Avg_Order_Value", 2).alias("aov"),
        fn.half_even("Avg_Review", 1).alias("review"),
    )


@query(
    sql_base(
        "SELECT max(order_purchase_timestamp) AS latest, customer_state, strftime(CASE WHEN "
        "CAST(max(order_purchase_timestamp) AS DATE) < last_day(max(order_purchase_timestamp)) "
        "THEN max(order_purchase_timestamp) - INTERVAL 1 MONTH ELSE max(order_purchase_timestamp) "
        "END, '%Y-%m') AS closed FROM ob GROUP BY customer_state"
    )
)
def last_closed_month(spark: SparkSession, folder: str) -> DataFrame:
    latest = base(spark, folder).groupBy("customer_state").agg(
        F.max("order_purchase_timestamp").alias("latest")
    )
    return latest.withColumn("closed", fn.month_key(fn.last_closed_month("latest")))


@query(
    sql_base(
        "SELECT strftime(order_purchase_timestamp, '%Y-%m') AS mes, list_extract(['Jan','Fev','Mar',"
        "'Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'], "
        "month(order_purchase_timestamp)) || '/' || strftime(order_purchase_timestamp, '%y') "
        "AS label, count(*) AS n FROM ob GROUP BY ALL"
    )
)
def month_label(spark: SparkSession, folder: str) -> DataFrame:
    months = base(spark, folder).groupBy(fn.month_key("order_purchase_timestamp").alias("mes")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return months.withColumn("label", fn.month_label_pt("mes"))


@query(
    sql_base(
        "SELECT upper('nation_3') AS uf, count(*) AS n FROM ob "
        "WHERE customer_state = upper('nation_3')"
    )
)
def state_argument(spark: SparkSession, folder: str) -> DataFrame:
    state = F.upper(F.lit("nation_3"))
    chosen = base(spark, folder).where(F.col("customer_state") == state)
    return chosen.agg(F.count(F.lit(1)).alias("n")).select(state.alias("uf"), "n")


# ---------------------------------------------------------------- order-grain tables


@query(
    sql_base(
        "SELECT order_id, CAST(total_items_value AS DOUBLE) AS total_items_value, n_items "
        "FROM items_agg"
    )
)
def order_item_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(orders_.order_item_totals(model_tables(spark, folder).order_items))


@query(
    sql_base(
        "SELECT order_id, CAST(total_payment AS DOUBLE) AS total_payment, CAST(n_payments AS BIGINT) AS n_payments FROM pay_agg"
    )
)
def order_payment_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(orders_.order_payment_totals(model_tables(spark, folder).payments))


@query(
    sql_model(
        "SELECT order_id, CAST(sum(review_score) AS DOUBLE) / count(*) AS review_score "
        "FROM m_all_reviews GROUP BY order_id"
    )
)
def order_review_mean(spark: SparkSession, folder: str) -> DataFrame:
    return orders_.order_review_mean(model_tables(spark, folder).reviews)


@query(
    sql_base(
        f"SELECT order_id, {title(chr(39).join(['coalesce(product_category_name, ', 'nao_informado', ')']))} "
        "AS product_category FROM dear LEFT JOIN m_products USING (product_id)"
    )
)
def dominant_category(spark: SparkSession, folder: str) -> DataFrame:
    found = model_tables(spark, folder)
    return orders_.dominant_category(found.order_items, found.products)


@query(
    sql_base(
        "SELECT order_id, coalesce(product_category_name_english, 'desconhecida') AS cat "
        "FROM dear LEFT JOIN m_products USING (product_id) "
        "LEFT JOIN m_translation USING (product_category_name)"
    )
)
def translated_category(spark: SparkSession, folder: str) -> DataFrame:
    found = model_tables(spark, folder)
    return orders_.translated_category(
        found.order_items, found.products, found.category_translation
    )


@query(
    sql_model(
        "SELECT order_id, payment_type FROM (SELECT *, row_number() OVER (PARTITION BY order_id "
        "ORDER BY payment_value DESC, payment_sequential, payment_type) AS rn FROM m_payments) "
        "WHERE rn = 1"
    )
)
def dominant_payment_row(spark: SparkSession, folder: str) -> DataFrame:
    return orders_.dominant_payment_row(model_tables(spark, folder).payments)


@query(
    sql_model(
        "SELECT order_id, payment_type FROM (SELECT order_id, payment_type, row_number() OVER "
        "(PARTITION BY order_id ORDER BY sum(payment_value) DESC, payment_type) AS rn "
        "FROM m_payments GROUP BY order_id, payment_type) WHERE rn = 1"
    )
)
def dominant_payment_sum(spark: SparkSession, folder: str) -> DataFrame:
    return orders_.dominant_payment_sum(model_tables(spark, folder).payments)


@query(
    sql_base(
        "SELECT order_id, customer_id, order_purchase_timestamp, "
        "CAST(total_items_value AS DOUBLE) AS total_items_value, n_items, "
        "CAST(total_payment AS DOUBLE) AS total_payment, CAST(n_payments AS BIGINT) AS n_payments, review_score, "
        "customer_unique_id, customer_state, CAST(monetary_value AS DOUBLE) AS monetary_value, "
        "product_category FROM ob"
    )
)
def orders_base(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(base(spark, folder, category=True))


# ---------------------------------------------------------------- customer grain

_RFM_COLUMNS = (
    "customer_unique_id, Recency, Frequency, CAST(Monetary AS DOUBLE) AS Monetary, "
    "Avg_Order_Value, Items, Avg_Review"
)


@query(sql_rfm(f"SELECT {_RFM_COLUMNS} FROM rfm"))
def rfm(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(customers(spark, folder))


@query(
    f"""SELECT user_id AS customer_unique_id,
    {days("max(ts)", "TIMESTAMP '2024-02-01'")} AS Recency, count(*) AS Frequency,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS Monetary,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS Avg_Order_Value
    FROM events WHERE event_type = 'purchase' GROUP BY user_id"""
)
def rfm_of_events(spark: SparkSession, folder: str) -> DataFrame:
    people = build_rfm(event_orders(spark, folder), EVENT_SNAPSHOT)
    return tidy(people.drop("Items", "Avg_Review"))


@query(
    sql_base(
        "SELECT order_id, min(order_purchase_timestamp) OVER (PARTITION BY customer_unique_id) "
        "AS first_purchase FROM ob WHERE customer_unique_id IS NOT NULL"
    )
)
def first_purchase_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    return first_purchase(base(spark, folder)).select("order_id", "first_purchase")


@query(sql_base("SELECT DISTINCT customer_unique_id, customer_state FROM ob"))
def distinct_customer_states(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select("customer_unique_id", "customer_state").distinct()


@query(
    sql_base(
        "SELECT order_id, count(*) AS n FROM ob JOIN m_reviews USING (order_id) "
        "JOIN items_agg USING (order_id) GROUP BY order_id"
    )
)
def inner_order_join(spark: SparkSession, folder: str) -> DataFrame:
    found = tables(spark, folder)
    orders = found.orders.where(F.col("order_status") == STATUS).select("order_id")
    items = orders_.order_item_totals(found.order_items)
    return (
        orders.join(items, "order_id")
        .join(found.reviews.select("order_id"), "order_id")
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
