"""The order model and the marts in SQL, as common table expressions."""

from __future__ import annotations


def half_even(x: str, digits: int) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def half_up(x: str, digits: int) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(round(({x}) * {scale}) / {scale})"


def title(x: str) -> str:
    words = f"string_split(replace({x}, '_', ' '), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def mean(x: str) -> str:
    return f"(CAST(sum({x}) AS DOUBLE) / count({x}))"


MODEL = f"""
m_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp FROM orders),
m_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS freight_value
  FROM lineitem),
m_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         l_returnflag AS payment_type, l_partkey % 12 AS payment_installments,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2))
              * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS payment_value
  FROM lineitem WHERE l_linestatus = 'F'),
m_all_reviews AS (
  SELECT l_linenumber || '-' || l_partkey || '-' || l_suppkey AS review_id,
         l_orderkey AS order_id, CAST(l_quantity AS BIGINT) % 5 + 1 AS review_score,
         CASE WHEN l_discount > 0 THEN l_shipdate END AS review_creation_date
  FROM lineitem),
m_reviews AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id
      ORDER BY review_creation_date DESC NULLS FIRST, review_id DESC) AS rn
    FROM m_all_reviews) WHERE rn = 1),
m_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_size % 10 <> 0 THEN replace(p_name, ' ', '_') END AS product_category_name
  FROM part),
m_translation AS (
  SELECT DISTINCT product_category_name,
         upper(product_category_name) AS product_category_name_english
  FROM m_products WHERE product_category_name IS NOT NULL
    AND NOT starts_with(product_category_name, 'small'))
"""

BASE = f"""{MODEL},
items_agg AS (SELECT order_id, sum(price) AS total_items_value, count(order_item_id) AS n_items
              FROM m_items GROUP BY order_id),
pay_agg AS (SELECT order_id, sum(payment_value) AS total_payment,
                   max(payment_sequential) AS n_payments FROM m_payments GROUP BY order_id),
rev_agg AS (SELECT order_id, avg(review_score) AS review_score FROM m_reviews GROUP BY order_id),
dear AS (SELECT order_id, product_id FROM (
           SELECT *, row_number() OVER (PARTITION BY order_id
             ORDER BY price DESC NULLS LAST, order_item_id, product_id) AS rn FROM m_items)
         WHERE rn = 1),
ob AS (
  SELECT o.order_id, o.customer_id, o.order_purchase_timestamp, i.total_items_value, i.n_items,
         p.total_payment, p.n_payments, r.review_score, c.customer_unique_id, c.customer_state,
         coalesce(p.total_payment, i.total_items_value) AS monetary_value,
         CASE WHEN i.n_items IS NULL THEN 'Não informado'
              ELSE {title("coalesce(pr.product_category_name, 'nao_informado')")}
         END AS product_category
  FROM m_orders o
  LEFT JOIN items_agg i USING (order_id) LEFT JOIN pay_agg p USING (order_id)
  LEFT JOIN rev_agg r USING (order_id) LEFT JOIN m_customers c USING (customer_id)
  LEFT JOIN dear d USING (order_id) LEFT JOIN m_products pr ON pr.product_id = d.product_id
  WHERE o.order_status = 'F')
"""

RFM = f"""{BASE},
rfm AS (
  SELECT customer_unique_id,
         {days("max(order_purchase_timestamp)", "TIMESTAMP '2001-09-01'")} AS Recency,
         count(DISTINCT order_id) AS Frequency,
         coalesce(sum(monetary_value), 0) AS Monetary,
         {mean("monetary_value")} AS Avg_Order_Value,
         CAST(coalesce(sum(n_items), 0) AS BIGINT) AS Items,
         avg(review_score) AS Avg_Review
  FROM ob WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id)
"""

LABELLED = f"""{RFM},
grouped AS (
  SELECT *, CASE WHEN Recency > 365 THEN 2 WHEN Frequency >= 5 THEN 0
                 WHEN Monetary >= 500000 THEN 3 ELSE 1 END AS Cluster FROM rfm),
profile AS (
  SELECT Cluster, avg(Recency) AS r, avg(Frequency) AS f, avg(CAST(Monetary AS DOUBLE)) AS m
  FROM grouped GROUP BY Cluster),
at_risk AS (SELECT Cluster FROM profile ORDER BY r DESC, Cluster LIMIT 1),
champions AS (SELECT Cluster FROM profile WHERE Cluster NOT IN (FROM at_risk)
              ORDER BY f * m DESC, Cluster LIMIT 1),
spenders AS (SELECT Cluster FROM profile WHERE Cluster NOT IN (FROM at_risk)
             AND Cluster NOT IN (FROM champions) ORDER BY m DESC, Cluster LIMIT 1),
cust AS (
  SELECT *, CASE WHEN Cluster IN (FROM at_risk) THEN 'Em Risco / Hibernando'
                 WHEN Cluster IN (FROM champions) THEN 'Campeões'
                 WHEN Cluster IN (FROM spenders) THEN 'Big Spenders (Não-Recorrentes)'
                 ELSE 'Novos / Ocasionais' END AS Cluster_Name,
         Frequency / 24.0::DOUBLE AS Freq_Mensal,
         {half_even("Avg_Order_Value * (Frequency / 24.0::DOUBLE) * 12", 2)} AS CLV_12m
  FROM grouped),
pay_main AS (SELECT order_id, payment_type FROM (
    SELECT order_id, payment_type, row_number() OVER (PARTITION BY order_id
             ORDER BY sum(payment_value) DESC, payment_type) AS rn
    FROM m_payments GROUP BY order_id, payment_type) WHERE rn = 1),
ord AS (SELECT ob.*, pm.payment_type, cu.Cluster, cu.Cluster_Name
        FROM ob LEFT JOIN pay_main pm USING (order_id)
        LEFT JOIN cust cu USING (customer_unique_id)),
cohort_rows AS (
  SELECT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS m,
         min(date_trunc('month', order_purchase_timestamp))
           OVER (PARTITION BY customer_unique_id) AS first_m FROM ob),
cohort_counts AS (
  SELECT strftime(first_m, '%Y-%m') AS Safra,
         (year(m) - year(first_m)) * 12 + month(m) - month(first_m) AS MesIndice,
         count(DISTINCT customer_unique_id) AS Clientes_Retidos
  FROM cohort_rows GROUP BY ALL),
cohort AS (
  SELECT c.Safra, c.MesIndice, c.Clientes_Retidos, z.Clientes_Retidos AS Tamanho_Safra,
         {half_even("c.Clientes_Retidos / z.Clientes_Retidos::DOUBLE", 4)} AS Pct_Retencao
  FROM cohort_counts c LEFT JOIN cohort_counts z ON z.Safra = c.Safra AND z.MesIndice = 0)
"""


def model(select: str) -> str:
    return f"WITH {MODEL} {select}"


def base(select: str) -> str:
    return f"WITH {BASE} {select}"


def rfm(select: str) -> str:
    return f"WITH {RFM} {select}"


def labelled(select: str) -> str:
    return f"WITH {LABELLED} {select}"
