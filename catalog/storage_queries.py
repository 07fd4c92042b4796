"""Reading and writing: raw tables, locale CSV, Parquet marts, exports, the full job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.model import customer_mart, marts, tidy
from catalog.prelude import BASE, LABELLED, half_even
from catalog.registry import query
from clientela.operators.orders import orders_base as build_base
from clientela.operators.segments import rfm_scores, strategic_segments
from clientela.session import scratch_folder, settle
from clientela.sinks import marts as sinks
from clientela.sources.marts import read_locale_csv, register_marts
from clientela.sources.star_schema import STATUS, model_tables
from clientela.sources.tables import load_tables as load

_TABLES = ["orders", "customers", "order_items", "payments", "reviews", "products",
           "category_translation"]


@query(
    f"""WITH {BASE}, totals AS (SELECT order_id, sum(review_score)::DOUBLE / count(*) AS score
      FROM m_all_reviews GROUP BY 1)
    SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_unique_id AS VARCHAR) AS
    customer_unique_id, CAST(monetary_value AS DOUBLE) AS monetary_value, n_items,
    score AS review_score, product_category FROM ob LEFT JOIN totals USING (order_id)"""
)
def load_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The raw tables written as CSV, read back by the loader and turned into the order base."""
    raw = scratch_folder(spark, "raw")
    found = model_tables(spark, folder)
    for name in _TABLES:
        getattr(found, name).write.csv(f"{raw}/{name}.csv", header=True)
    loaded = load(spark, raw)
    return tidy(
        build_base(loaded, STATUS).select(
            "order_id", "customer_unique_id", "monetary_value", "n_items", "review_score",
            "product_category",
        )
    )


_EXPORT = f"""WITH {LABELLED} SELECT CAST(customer_unique_id AS VARCHAR) AS customer_unique_id,
    Recency, Frequency, CAST(Monetary AS DOUBLE) AS Monetary,
    {half_even("Avg_Order_Value", 2)} AS Avg_Order_Value, {half_even("Avg_Review", 2)} AS Avg_Review,
    CLV_12m, Cluster_Name, '2001-09-01' AS dt_exportacao, 'v1.0' AS versao_modelo FROM cust"""
_EXPORTED = ["customer_unique_id", "Recency", "Frequency", "Monetary", "Avg_Order_Value",
             "Avg_Review", "CLV_12m", "Cluster_Name", "dt_exportacao", "versao_modelo"]




@query(
    _EXPORT.replace("CAST(Monetary AS DOUBLE) AS Monetary", "CAST(CAST(Monetary AS FLOAT) AS DOUBLE) AS Monetary")
    .replace(f"{half_even('Avg_Order_Value', 2)} AS Avg_Order_Value", f"CAST(CAST({half_even('Avg_Order_Value', 2)} AS FLOAT) AS DOUBLE) AS Avg_Order_Value")
    .replace(f"{half_even('Avg_Review', 2)} AS Avg_Review", f"CAST(CAST({half_even('Avg_Review', 2)} AS FLOAT) AS DOUBLE) AS Avg_Review")
    .replace("CLV_12m, Cluster_Name, '2001", "CAST(CAST(CLV_12m AS FLOAT) AS DOUBLE) AS CLV_12m, Cluster_Name, '2001")
)
def export_customers(spark: SparkSession, folder: str) -> DataFrame:
    mart = sinks.customer_export(customer_mart(spark, folder), "2001-09-01")
    return tidy(mart.select(_EXPORTED))


@query(
    f"""WITH {LABELLED} SELECT CAST(order_id AS VARCHAR) AS order_id,
    CAST(customer_unique_id AS VARCHAR) AS customer_unique_id,
    strftime(order_purchase_timestamp, '%Y-%m-%d') AS order_purchase_timestamp,
    CAST(CAST(total_payment AS FLOAT) AS DOUBLE) AS total_payment,
    CAST(CAST(total_items_value AS FLOAT) AS DOUBLE) AS total_items_value, n_items,
    CAST(CAST({half_even("review_score", 1)} AS FLOAT) AS DOUBLE) AS review_score,
    CAST(Cluster AS BIGINT) AS Cluster, Cluster_Name, coalesce(payment_type, 'nan') AS payment_type,
    product_category FROM ord"""
)
def export_orders(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True, category=True)
    mart = sinks.order_export(orders)
    return tidy(
        mart.select(
            "order_id", "customer_unique_id", "order_purchase_timestamp", "total_payment",
            "total_items_value", "n_items", "review_score", "Cluster", "Cluster_Name",
            "payment_type", "product_category",
        )
    )


@query(_EXPORT)
def locale_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The customer mart written as locale CSV and read back; amounts kept in cents."""
    path = scratch_folder(spark, "csv")
    mart = customer_mart(spark, folder).select(
        "customer_unique_id", "Recency", "Frequency", "Monetary",
        *[(F.rint(F.col(c) * 100) / 100).alias(c) for c in ("Avg_Order_Value", "Avg_Review")],
        "CLV_12m", "Cluster_Name",
        F.lit("2001-09-01").alias("dt_exportacao"), F.lit("v1.0").alias("versao_modelo"),
    )
    sinks.write_locale_csv(mart, path)
    types = {"Recency": "bigint", "Frequency": "bigint", "Monetary": "double",
             "Avg_Order_Value": "double", "Avg_Review": "double", "CLV_12m": "double"}
    return read_locale_csv(spark, path, types)


@query(
    f"""WITH {LABELLED} SELECT Cluster_Name, count(*) AS pedidos,
    CAST(sum(monetary_value) AS DOUBLE) AS receita FROM ord GROUP BY 1"""
)
def parquet_mart(spark: SparkSession, folder: str) -> DataFrame:
    """Both marts stored as Parquet, registered by name and queried with SQL."""
    path = scratch_folder(spark, "marts")
    people, orders = marts(spark, folder, category=True)
    sinks.write_parquet_mart(people, path, "fato_rfm_clientes")
    sinks.write_parquet_mart(orders.drop("Cluster", "Cluster_Name"), path, "fato_pedidos")
    register_marts(spark, path, ["fato_rfm_clientes", "fato_pedidos"])
    return spark.sql(
        "SELECT Cluster_Name, count(*) AS pedidos, CAST(sum(monetary_value) AS DOUBLE) AS receita "
        "FROM fato_pedidos JOIN fato_rfm_clientes USING (customer_unique_id) GROUP BY Cluster_Name"
    )


_BIN = (
    "CAST(greatest(1, ceil((row_number() OVER (ORDER BY {v}, customer_unique_id) - 1) * 5 "
    "/ (count(*) OVER () - 1)::DOUBLE)) AS BIGINT)"
)


@query(
    f"""WITH {LABELLED}, e AS (SELECT quantile_cont(Recency, [0.2, 0.4, 0.6, 0.8]) AS q FROM cust),
    s AS (SELECT *, CAST(CASE WHEN Recency <= q[1] THEN 5 WHEN Recency <= q[2] THEN 4
        WHEN Recency <= q[3] THEN 3 WHEN Recency <= q[4] THEN 2 ELSE 1 END AS BIGINT) AS R_score,
      {_BIN.format(v="Frequency")} AS F_score, {_BIN.format(v="Monetary")} AS M_score,
      CAST(sum(Monetary) OVER (ORDER BY Monetary DESC, customer_unique_id ROWS UNBOUNDED PRECEDING)
        AS DOUBLE) / CAST(sum(Monetary) OVER () AS DOUBLE) AS cum_revenue_pct FROM cust, e)
    SELECT customer_unique_id, Recency, Frequency, CAST(Monetary AS DOUBLE) AS Monetary,
      Avg_Order_Value, Items, Avg_Review, CAST(Cluster AS BIGINT) AS Cluster, Freq_Mensal, CLV_12m,
      Cluster_Name, R_score, F_score, M_score, concat(R_score, F_score, M_score) AS RFM_bucket,
      R_score + F_score + M_score AS RFM_score, cum_revenue_pct,
      CASE WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'Champions'
        WHEN R_score >= 4 AND F_score >= 3 AND M_score >= 3 THEN 'Loyal Customers'
        WHEN R_score >= 4 AND M_score >= 4 AND F_score <= 3 THEN 'Big Spenders (New/Occasional)'
        WHEN R_score = 5 AND F_score <= 2 THEN 'New Customers'
        WHEN R_score >= 3 AND F_score <= 2 AND M_score <= 2 THEN 'Potential Loyalists'
        WHEN R_score <= 2 AND (F_score >= 4 OR M_score >= 4) THEN 'At Risk'
        WHEN R_score = 1 AND F_score = 1 AND M_score = 1 THEN 'Lost' ELSE 'Others'
      END AS RFM_segment,
      CASE WHEN cum_revenue_pct <= 0.05::DOUBLE THEN 'Elite (Top 5%)'
        WHEN cum_revenue_pct <= 0.15::DOUBLE THEN 'High Value (Next 10%)'
        WHEN cum_revenue_pct <= 0.35::DOUBLE THEN 'Mid Value (Next 20%)' ELSE 'Base'
      END AS Revenue_segment,
      CASE WHEN Recency <= 30 THEN 'Ativo' WHEN Recency <= 90 THEN 'Recente'
        WHEN Recency <= 180 THEN 'Morno' ELSE 'Em Risco' END AS Recency_segment,
      Revenue_segment || ' - ' || Recency_segment AS Strategic_segment FROM s"""
)
def full_customer_mart(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the customer mart: scores, segments, named groups, lifetime value."""
    people = customer_mart(spark, folder)
    return tidy(strategic_segments(settle(rfm_scores(people))))
