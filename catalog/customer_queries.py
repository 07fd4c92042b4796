"""Scores and segments, cohorts, concentration, key figures, distributions, tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.model import (
    base,
    customer_mart,
    customers,
    marts,
    rule_cluster,
    stored_customers,
    tidy,
)
from catalog.prelude import base as sql_base
from catalog.prelude import half_even, half_up, labelled, mean
from catalog.prelude import rfm as sql_rfm
from catalog.registry import query
from clientela.functions import probability
from clientela.functions.scalars import half_year
from clientela.operators import concentration, distributions, hypothesis, kpis, ordering, segments
from clientela.operators import rfm as rfm_
from clientela.operators.orders import payment_mix
from clientela.session import settle
from clientela.sources.dimensions import AT_RISK, SEGMENTS, calendar_of, dim_segments
from clientela.sources.star_schema import SNAPSHOT, model_tables

# ---------------------------------------------------------------- bins, scores, segments


@query(
    sql_rfm(
        """, e AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), 0.2) AS a,
        quantile_cont(CAST(Monetary AS DOUBLE), 0.4) AS b,
        quantile_cont(CAST(Monetary AS DOUBLE), 0.6) AS c,
        quantile_cont(CAST(Monetary AS DOUBLE), 0.8) AS d FROM rfm)
        SELECT customer_unique_id, CAST(1 + (Monetary > a)::INT + (Monetary > b)::INT
        + (Monetary > c)::INT + (Monetary > d)::INT AS BIGINT) AS bin FROM rfm, e"""
    )
)
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    binned = segments.quantile_bins(stored_customers(spark, folder), "Monetary", 5)
    return tidy(binned.select("customer_unique_id", "bin"))


_RANK_BIN = (
    "CAST(greatest(1, ceil((row_number() OVER (ORDER BY {v}, customer_unique_id) - 1) * 5 "
    "/ (count(*) OVER () - 1)::DOUBLE)) AS BIGINT)"
)


@query(sql_rfm(f"SELECT customer_unique_id, {_RANK_BIN.format(v='Frequency')} AS bin FROM rfm"))
def rank_bins(spark: SparkSession, folder: str) -> DataFrame:
    binned = segments.rank_bins(
        stored_customers(spark, folder), "Frequency", "customer_unique_id", 5
    )
    return tidy(binned.select("customer_unique_id", "bin"))


_SCORED = f"""{{cte}}, edges AS (SELECT quantile_cont(Recency, 0.2) AS a, quantile_cont(Recency, 0.4) AS b,
    quantile_cont(Recency, 0.6) AS c, quantile_cont(Recency, 0.8) AS d FROM rfm),
  scored AS (SELECT customer_unique_id,
    CASE WHEN Recency <= a THEN 5 WHEN Recency <= b THEN 4 WHEN Recency <= c THEN 3
         WHEN Recency <= d THEN 2 ELSE 1 END AS r,
    {_RANK_BIN.format(v="Frequency")} AS f, {_RANK_BIN.format(v="Monetary")} AS m
    FROM rfm, edges)"""


def _scored(select: str) -> str:
    return sql_rfm(_SCORED.replace("{cte}", "") + " " + select)


@query(
    _scored(
        "SELECT customer_unique_id, CAST(r AS BIGINT) AS R_score, f AS F_score, m AS M_score, "
        "concat(r, f, m) AS RFM_bucket, CAST(r + f + m AS BIGINT) AS RFM_score FROM scored"
    )
)
def rfm_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = segments.rfm_scores(stored_customers(spark, folder))
    return tidy(
        scored.select(
            "customer_unique_id", "R_score", "F_score", "M_score", "RFM_bucket", "RFM_score"
        )
    )


@query(
    _scored(
        """SELECT customer_unique_id, CASE
        WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions'
        WHEN r >= 4 AND f >= 3 AND m >= 3 THEN 'Loyal Customers'
        WHEN r >= 4 AND m >= 4 AND f <= 3 THEN 'Big Spenders (New/Occasional)'
        WHEN r = 5 AND f <= 2 THEN 'New Customers'
        WHEN r >= 3 AND f <= 2 AND m <= 2 THEN 'Potential Loyalists'
        WHEN r <= 2 AND (f >= 4 OR m >= 4) THEN 'At Risk'
        WHEN r = 1 AND f = 1 AND m = 1 THEN 'Lost' ELSE 'Others' END AS RFM_segment FROM scored"""
    )
)
def rfm_segment(spark: SparkSession, folder: str) -> DataFrame:
    scored = segments.rfm_scores(stored_customers(spark, folder))
    return scored.select("customer_unique_id", "RFM_segment")


_SHARED = """, shared AS (SELECT customer_unique_id, Recency,
    CAST(sum(Monetary) OVER (ORDER BY Monetary DESC, customer_unique_id
         ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(Monetary) OVER () AS DOUBLE)
    AS cum_revenue_pct FROM rfm)"""
_REVENUE_SEGMENT = (
    "CASE WHEN cum_revenue_pct <= 0.05::DOUBLE THEN 'Elite (Top 5%)' "
    "WHEN cum_revenue_pct <= 0.15::DOUBLE THEN 'High Value (Next 10%)' "
    "WHEN cum_revenue_pct <= 0.35::DOUBLE THEN 'Mid Value (Next 20%)' ELSE 'Base' END"
)
_RECENCY_SEGMENT = (
    "CASE WHEN Recency <= 30 THEN 'Ativo' WHEN Recency <= 90 THEN 'Recente' "
    "WHEN Recency <= 180 THEN 'Morno' ELSE 'Em Risco' END"
)


@query(sql_rfm(_SHARED + " SELECT customer_unique_id, cum_revenue_pct FROM shared"))
def cumulative_share(spark: SparkSession, folder: str) -> DataFrame:
    shared = segments.cumulative_share(
        customers(spark, folder), "Monetary", "customer_unique_id"
    )
    return shared.select("customer_unique_id", "cum_revenue_pct")


@query(sql_rfm(_SHARED + f" SELECT {_REVENUE_SEGMENT} AS Revenue_segment, count(*) AS n FROM shared GROUP BY ALL"))
def revenue_segment(spark: SparkSession, folder: str) -> DataFrame:
    labelled_ = segments.strategic_segments(customers(spark, folder))
    return labelled_.groupBy("Revenue_segment").agg(F.count(F.lit(1)).alias("n"))


@query(sql_rfm(f"SELECT customer_unique_id, {_RECENCY_SEGMENT} AS Recency_segment FROM rfm"))
def recency_segment(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).select(
        "customer_unique_id", segments.recency_segment("Recency").alias("Recency_segment")
    )


@query(
    sql_rfm(
        _SHARED + f" SELECT customer_unique_id, {_REVENUE_SEGMENT} || ' - ' || {_RECENCY_SEGMENT} "
        "AS Strategic_segment FROM shared"
    )
)
def strategic_segment(spark: SparkSession, folder: str) -> DataFrame:
    return segments.strategic_segments(customers(spark, folder)).select(
        "customer_unique_id", "Strategic_segment"
    )


@query(labelled("SELECT customer_unique_id, Freq_Mensal, CLV_12m FROM cust"))
def clv_simple(spark: SparkSession, folder: str) -> DataFrame:
    return segments.lifetime_value(customers(spark, folder)).select(
        "customer_unique_id", "Freq_Mensal", "CLV_12m"
    )


_PROFILE = (
    "SELECT CAST(Cluster AS BIGINT) AS Cluster, "
    f"{half_even('avg(Recency)', 6)} AS R_mean, {half_even('avg(Frequency)', 6)} AS F_mean, "
    f"{half_even('avg(CAST(Monetary AS DOUBLE))', 6)} AS M_mean, "
    f"{half_even('avg(Avg_Order_Value)', 6)} AS AOV_mean, count(*) AS n_clientes"
)


@query(labelled(_PROFILE + " FROM cust GROUP BY Cluster"))
def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    people = customers(spark, folder).withColumn("Cluster", rule_cluster())
    return tidy(segments.cluster_profile(people), 6)


@query(labelled(_PROFILE + ", Cluster_Name FROM cust GROUP BY Cluster, Cluster_Name"))
def name_clusters(spark: SparkSession, folder: str) -> DataFrame:
    people = customer_mart(spark, folder)
    names = people.select("Cluster", "Cluster_Name").distinct()
    return tidy(segments.cluster_profile(people).join(names, "Cluster"), 6)


@query(labelled("SELECT customer_unique_id, Cluster_Name FROM cust"))
def assign_cluster_names(spark: SparkSession, folder: str) -> DataFrame:
    return customer_mart(spark, folder).select("customer_unique_id", "Cluster_Name")


@query(
    labelled(
        """SELECT CAST(Cluster AS BIGINT) AS Cluster, count(*) AS Qtd_Clientes,
        round_even(avg(Recency) * 1e6, 0) / 1e6 AS Recency_mean,
        round_even(quantile_cont(CAST(Recency AS DOUBLE), 0.5) * 1e6, 0) / 1e6 AS Recency_median,
        round_even(avg(Frequency) * 1e6, 0) / 1e6 AS Frequency_mean,
        round_even(quantile_cont(CAST(Frequency AS DOUBLE), 0.5) * 1e6, 0) / 1e6 AS Frequency_median,
        round_even(avg(CAST(Monetary AS DOUBLE)) * 1e6, 0) / 1e6 AS Monetary_mean,
        round_even(quantile_cont(CAST(Monetary AS DOUBLE), 0.5) * 1e6, 0) / 1e6 AS Monetary_median,
        round_even(avg(Avg_Order_Value) * 1e6, 0) / 1e6 AS AOV_mean,
        round_even(avg(Avg_Review) * 1e6, 0) / 1e6 AS Review_mean FROM cust GROUP BY Cluster"""
    )
)
def cluster_profile_full(spark: SparkSession, folder: str) -> DataFrame:
    people = settle(customers(spark, folder).withColumn("Cluster", rule_cluster()))
    return tidy(distributions.full_profile(people), 6)


_NORMALISED = ", ".join(
    f"round_even((({c}) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9) * 1e6, 0) / 1e6 AS {c}"
    for c in ("R_mean", "F_mean", "M_mean", "AOV_mean")
)


@query(
    labelled(
        f"SELECT CAST(Cluster AS BIGINT) AS Cluster, {_NORMALISED} FROM (SELECT Cluster, "
        "avg(Recency) AS R_mean, avg(Frequency) AS F_mean, avg(CAST(Monetary AS DOUBLE)) AS M_mean, "
        "avg(Avg_Order_Value) AS AOV_mean FROM cust GROUP BY Cluster)"
    )
)
def normalised_profile(spark: SparkSession, folder: str) -> DataFrame:
    people = customers(spark, folder).withColumn("Cluster", rule_cluster())
    profile = segments.cluster_profile(people).drop("n_clientes")
    return tidy(distributions.min_max(profile, ["R_mean", "F_mean", "M_mean", "AOV_mean"]), 6)


@query(
    labelled(
        """SELECT CAST(Cluster AS BIGINT) AS Cluster, CAST(r_ AS DOUBLE) AS R_rank,
        CAST(f_ AS DOUBLE) AS F_rank, CAST(m_ AS DOUBLE) AS M_rank,
        CAST(r_ + f_ + m_ AS DOUBLE) AS Score FROM (
          SELECT Cluster, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS r_,
          rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS f_,
          rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS m_
          FROM profile)"""
    )
)
def cluster_rank_score(spark: SparkSession, folder: str) -> DataFrame:
    people = customers(spark, folder).withColumn("Cluster", rule_cluster())
    return tidy(distributions.rank_score(segments.cluster_profile(people)))


@query(
    labelled(
        "SELECT p.payment_type, p.order_id, CAST(c.Cluster AS BIGINT) AS Cluster, c.Cluster_Name "
        "FROM ord p LEFT JOIN cust c USING (customer_unique_id)"
    )
)
def enrich_orders(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True)
    return tidy(orders.select("order_id", "payment_type", "Cluster", "Cluster_Name"))


# ---------------------------------------------------------------- cohorts and calendar


@query(labelled("SELECT * FROM cohort"))
def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(rfm_.cohort_retention(base(spark, folder)))


_HALF_YEAR = "left(Safra, 4) || CASE WHEN right(Safra, 2) <= '06' THEN '-S1' ELSE '-S2' END"


@query(
    labelled(
        f"SELECT {_HALF_YEAR} AS Semestre, MesIndice, CAST(sum(Clientes_Retidos) AS BIGINT) AS "
        "Clientes_Retidos, CAST(sum(Tamanho_Safra) AS BIGINT) AS Tamanho_Safra, "
        "sum(Clientes_Retidos)::DOUBLE / sum(Tamanho_Safra)::DOUBLE AS Retencao FROM cohort "
        f"WHERE MesIndice BETWEEN 1 AND 6 AND {_HALF_YEAR} >= '1996-S1' GROUP BY ALL"
    )
)
def cohort_weighted_retention(spark: SparkSession, folder: str) -> DataFrame:
    cohort = rfm_.cohort_retention(base(spark, folder))
    return tidy(rfm_.retention_heatmap(cohort, from_half_year="1996-S1"))


_DENSE = labelled(
    f""", seen AS (SELECT max(CAST(Safra || '-01' AS DATE) + to_months(CAST(MesIndice AS INTEGER))) AS m FROM cohort),
    grid AS (SELECT Safra, Clientes_Retidos AS Tamanho_Safra, CAST(unnest(range(CAST(
      (year(m) - CAST(left(Safra, 4) AS INTEGER)) * 12 + month(m) - CAST(right(Safra, 2) AS INTEGER) + 1 AS BIGINT)))
      AS BIGINT) AS MesIndice FROM cohort, seen WHERE MesIndice = 0),
    dense AS (SELECT g.Safra, g.MesIndice, coalesce(c.Clientes_Retidos, 0) AS Clientes_Retidos, g.Tamanho_Safra,
      {half_even("coalesce(c.Clientes_Retidos, 0) / g.Tamanho_Safra::DOUBLE", 4)} AS Pct_Retencao
      FROM grid g LEFT JOIN cohort c USING (Safra, MesIndice))"""
)


@query(_DENSE + " SELECT * FROM dense")
def cohort_retention_dense(spark: SparkSession, folder: str) -> DataFrame:
    cohort = settle(rfm_.cohort_retention(base(spark, folder)))
    return tidy(rfm_.dense_retention(cohort))


@query(
    _DENSE + """ SELECT MesIndice, CAST(sum(Clientes_Retidos) AS BIGINT) AS Clientes_Retidos,
    CAST(sum(Tamanho_Safra) AS BIGINT) AS Tamanho_Safra,
    sum(Clientes_Retidos)::DOUBLE / sum(Tamanho_Safra)::DOUBLE AS Retencao FROM dense GROUP BY 1"""
)
def cohort_weighted_retention_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Retention by month, where cohorts from which nobody returned count as well."""
    cohort = settle(rfm_.cohort_retention(base(spark, folder)))
    return tidy(rfm_.weighted_retention(rfm_.dense_retention(cohort), "MesIndice"))


@query(labelled(f"SELECT Safra, MesIndice, {_HALF_YEAR} AS Semestre FROM cohort"))
def cohort_semester(spark: SparkSession, folder: str) -> DataFrame:
    cohort = rfm_.cohort_retention(base(spark, folder))
    return tidy(cohort.select("Safra", "MesIndice", half_year("Safra").alias("Semestre")))


@query(
    """SELECT strftime(d, '%Y-%m-%d') AS Data, year(d) AS Ano, month(d) AS Mes, day(d) AS Dia,
    quarter(d) AS Trimestre, strftime(d, '%Y-%m') AS AnoMes, monthname(d) AS NomeMes,
    dayname(d) AS DiaSemana, isodow(d) AS NumDiaSemana, isodow(d) >= 6 AS FimDeSemana
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d
    FROM orders)"""
)
def dim_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(calendar_of(model_tables(spark, folder).orders, "order_purchase_timestamp"))


_SEGMENT_ROWS = ", ".join(
    "(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")"
    for row in SEGMENTS
)


@query(
    labelled(
        f"""SELECT d.Cluster_Name, d.Descricao, d.Cor_Hex, d.Acao_CRM, CAST(d.Prioridade AS BIGINT) AS Prioridade,
        d.Cor_Power_BI, count(*) AS clientes FROM cust JOIN (VALUES {_SEGMENT_ROWS})
        AS d(Cluster_Name, Descricao, Cor_Hex, Acao_CRM, Prioridade, Cor_Power_BI) USING (Cluster_Name)
        GROUP BY ALL"""
    )
)
def dim_segments_join(spark: SparkSession, folder: str) -> DataFrame:
    people = customer_mart(spark, folder)
    counts = people.groupBy("Cluster_Name").agg(F.count(F.lit(1)).alias("clientes"))
    return tidy(counts.join(dim_segments(spark), "Cluster_Name"))


# ---------------------------------------------------------------- concentration


@query(
    sql_rfm(
        f"SELECT {half_even('2 * sum(CAST(i * Monetary AS DOUBLE)) / (max(n) * CAST(sum(Monetary) AS DOUBLE)) - (max(n) + 1) / max(n)::DOUBLE', 9)}"
        " AS gini FROM (SELECT Monetary, row_number() OVER (ORDER BY Monetary) AS i, "
        "count(*) OVER () AS n FROM rfm)"
    )
)
def gini(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(concentration.gini(customers(spark, folder), "Monetary"), 9)


@query(
    sql_rfm(
        """SELECT ordem, ordem / n::DOUBLE * 100 AS cumulative_customers_pct,
        CAST(c AS DOUBLE) / CAST(t AS DOUBLE) * 100 AS cumulative_monetary_pct FROM (
        SELECT row_number() OVER w AS ordem, count(*) OVER () AS n,
        sum(Monetary) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(Monetary) OVER () AS t FROM rfm
        WINDOW w AS (ORDER BY Monetary, customer_unique_id))"""
    )
)
def lorenz_asc(spark: SparkSession, folder: str) -> DataFrame:
    return concentration.lorenz_curve(customers(spark, folder), "Monetary", "customer_unique_id")


@query(
    sql_rfm(
        """SELECT customer_unique_id, CAST(Monetary AS DOUBLE) AS Monetary, ordem,
        CAST(c AS DOUBLE) AS Receita_Acumulada,
        CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS Pct_Receita_Acumulada,
        ordem / n::DOUBLE AS Pct_Clientes_Acumulada FROM (
        SELECT customer_unique_id, Monetary, row_number() OVER w AS ordem, count(*) OVER () AS n,
        sum(Monetary) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(Monetary) OVER () AS t FROM rfm
        WINDOW w AS (ORDER BY Monetary DESC, customer_unique_id))"""
    )
)
def pareto_table(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(
        concentration.pareto_table(customers(spark, folder), "Monetary", "customer_unique_id")
    )


_POINTS = f"""{{start}}, ranked AS (SELECT row_number() OVER w AS k, count(*) OVER () AS n,
    CAST(sum(Monetary) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c,
    CAST(sum(Monetary) OVER () AS DOUBLE) AS t FROM rfm
    WINDOW w AS (ORDER BY Monetary DESC, customer_unique_id)),
  size AS (SELECT max(n) AS n FROM ranked),
  target AS (SELECT DISTINCT least(greatest(CAST(trunc((CASE WHEN i = 199 THEN 1.0::DOUBLE
      ELSE i * ((1.0::DOUBLE - 1.0::DOUBLE / n) / 199.0::DOUBLE) + 1.0::DOUBLE / n END) * n)
      AS BIGINT), 1), n) AS k FROM size, range(200) AS r(i)),
  points AS (SELECT row_number() OVER (ORDER BY k) - 1 AS ordem, x AS pct_clientes,
      y AS pct_receita FROM (
        SELECT 0 AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL
        SELECT min(k), x, arg_min(y, k) FROM (SELECT k, {half_even("k / n::DOUBLE", 5)} AS x,
        {half_even("c / t", 5)} AS y FROM ranked JOIN target USING (k)) GROUP BY x))"""


def _points(select: str) -> str:
    return sql_rfm(_POINTS.replace("{start}", "") + " " + select)


@query(_points("SELECT * FROM points"))
def lorenz_points(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(concentration.lorenz_points(customers(spark, folder), "Monetary"))


@query(_points("SELECT * FROM points ORDER BY abs(pct_clientes - 0.2::DOUBLE), ordem LIMIT 1"))
def nearest_point(spark: SparkSession, folder: str) -> DataFrame:
    curve = concentration.lorenz_points(customers(spark, folder), "Monetary")
    return tidy(concentration.nearest_point(curve))


def _top(share: str) -> str:
    return sql_rfm(
        f"""SELECT {share}::DOUBLE AS top_pct_clientes, count(*) FILTER (rn <= k)
        AS n_clientes_no_top, CAST(sum(Monetary) FILTER (rn <= k) AS DOUBLE) AS receita_no_top,
        CAST(sum(Monetary) AS DOUBLE) AS receita_total,
        {half_even("CAST(sum(Monetary) FILTER (rn <= k) AS DOUBLE) / CAST(sum(Monetary) AS DOUBLE)", 4)}
        AS pct_receita_concentrada FROM (SELECT Monetary, row_number() OVER
        (ORDER BY Monetary DESC) AS rn, floor(count(*) OVER () * {share}) AS k FROM rfm)"""
    )


@query(_top("0.2"))
def top_n_share_rownum(spark: SparkSession, folder: str) -> DataFrame:
    return concentration.top_share(customers(spark, folder), "Monetary", 0.2)


@query(_top("0.1"))
def top_n_share_cut(spark: SparkSession, folder: str) -> DataFrame:
    return concentration.top_share(customers(spark, folder), "Monetary", 0.1)


@query(
    sql_rfm(
        """SELECT CAST(sum(Monetary) FILTER (rk <= k) AS DOUBLE) AS receita_top,
        CAST(sum(Monetary) AS DOUBLE) AS receita_total, CAST(sum(Monetary) FILTER (rk <= k)
        AS DOUBLE) / CAST(sum(Monetary) AS DOUBLE) AS pct_concentracao FROM (SELECT Monetary,
        rank() OVER (ORDER BY Monetary DESC) AS rk, floor(count(*) OVER () * 0.2) AS k FROM rfm)"""
    )
)
def top_n_share_ties(spark: SparkSession, folder: str) -> DataFrame:
    return concentration.top_share_with_ties(customers(spark, folder), "Monetary")


# ---------------------------------------------------------------- key figures

_BASE_MEASURES = f"""count(*) AS total_clientes, CAST(sum(Monetary) AS DOUBLE) AS receita_total,
    avg(Recency) AS recencia_media, avg(Frequency) AS frequency_media,
    {mean("CAST(CLV_12m AS DECIMAL(18,2))")} AS clv_medio,
    {half_even("avg(Avg_Order_Value)", 6)} AS ticket_medio_cliente,
    count(*) FILTER (Recency > 365) AS clientes_em_risco,
    count(*) FILTER (Frequency = 1) AS clientes_1_compra,
    coalesce(CAST(sum(Monetary) FILTER (Recency > 365) AS DOUBLE), 0) AS receita_em_risco"""
_ORDER_MEASURES = """count(*) AS total_pedidos, CAST(sum(monetary_value) AS DOUBLE) AS receita_pedidos,
    count(DISTINCT customer_unique_id) AS clientes_ativos,
    avg(review_score) AS review_medio"""
_DERIVED = """receita_total / total_pedidos AS ticket_medio,
    clientes_em_risco / total_clientes::DOUBLE AS pct_em_risco,
    clientes_1_compra / total_clientes::DOUBLE AS pct_compra_unica,
    receita_em_risco / receita_total AS pct_receita_em_risco"""


@query(
    labelled(
        f"SELECT *, {_DERIVED} FROM (SELECT {_BASE_MEASURES} FROM cust), "
        f"(SELECT {_ORDER_MEASURES} FROM ord)"
    )
)
def base_measures(spark: SparkSession, folder: str) -> DataFrame:
    people, orders = marts(spark, folder)
    found = kpis.measures(people, orders)
    ticket = F.rint(F.col("ticket_medio_cliente") * 1e6) / 1e6
    return tidy(found.withColumn("ticket_medio_cliente", ticket))


@query(
    labelled(
        f"SELECT *, {_DERIVED} FROM (SELECT Cluster_Name, {_BASE_MEASURES} FROM cust GROUP BY 1) "
        f"JOIN (SELECT Cluster_Name, {_ORDER_MEASURES} FROM ord GROUP BY 1) USING (Cluster_Name)"
    )
)
def measures_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    people, orders = marts(spark, folder)
    found = kpis.measures(people, orders, ["Cluster_Name"])
    ticket = F.rint(F.col("ticket_medio_cliente") * 1e6) / 1e6
    return tidy(found.withColumn("ticket_medio_cliente", ticket))


@query(
    labelled(
        "SELECT " + ", ".join(
            f"count(*) FILTER (Cluster_Name = '{n}') / count(*)::DOUBLE AS {c}"
            for c, n in (
                ("pct_campeoes", "Campeões"),
                ("pct_big_spenders", "Big Spenders (Não-Recorrentes)"),
                ("pct_novos", "Novos / Ocasionais"),
            )
        ) + " FROM cust"
    )
)
def cluster_shares(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.cluster_shares(customer_mart(spark, folder))


@query(
    labelled(
        f"""SELECT *, {half_even("clientes_1_compra / total_clientes::DOUBLE", 4)} AS pct_1_compra,
        {half_even("clientes_em_risco / total_clientes::DOUBLE", 4)} AS pct_em_risco FROM (
        SELECT count(*) AS total_clientes,
        {half_up("CAST(sum(Monetary) AS DOUBLE)", 2)} AS receita_total_brl,
        {half_up(mean("Monetary"), 2)} AS ticket_medio_brl,
        {half_up("avg(Recency)", 1)} AS recency_media_dias,
        {half_up("avg(Frequency)", 2)} AS frequency_media,
        count(*) FILTER (Frequency = 1) AS clientes_1_compra,
        count(*) FILTER (Recency > 365) AS clientes_em_risco FROM cust)"""
    )
)
def overall_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.overall_kpis(customers(spark, folder))


@query(
    labelled(
        f"""SELECT Cluster_Name, count(*) AS n_clientes,
        {half_up("avg(Recency)", 1)} AS recency_media_dias,
        {half_up("avg(Frequency)", 2)} AS frequency_media,
        {half_up(mean("Monetary"), 2)} AS monetary_medio,
        {half_up("CAST(sum(Monetary) AS DOUBLE)", 2)} AS receita_total,
        {half_up(mean("CAST(CLV_12m AS DECIMAL(18,2))"), 2)} AS clv_12m_medio,
        {half_up("avg(Avg_Review)", 2)} AS review_score_medio FROM cust GROUP BY Cluster_Name"""
    )
)
def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.cluster_summary(customer_mart(spark, folder))


def _state(where: str) -> str:
    return labelled(
        f"""SELECT *, n_clientes > 0 AS encontrado FROM (SELECT
        count(DISTINCT c.customer_unique_id) AS n_clientes,
        {half_up("avg(Recency)", 1)} AS recency_media,
        {half_up("avg(Frequency)", 2)} AS frequency_media,
        {half_up(mean("Monetary"), 2)} AS monetary_medio,
        {half_up("CAST(sum(Monetary) AS DOUBLE)", 2)} AS receita_total,
        {half_up(mean("CAST(CLV_12m AS DECIMAL(18,2))"), 2)} AS clv_medio
        FROM cust c JOIN (SELECT DISTINCT customer_unique_id, customer_state FROM ord) s
        USING (customer_unique_id) WHERE {where})"""
    )


@query(_state("customer_state = 'NATION_3'"))
def filter_by_state(spark: SparkSession, folder: str) -> DataFrame:
    people, orders = marts(spark, folder)
    return kpis.filter_by_state(people, orders, "nation_3")


@query(_state(f"customer_state = 'NATION_5' AND Cluster_Name = '{AT_RISK}'"))
def filter_by_state_and_cluster(spark: SparkSession, folder: str) -> DataFrame:
    people, orders = marts(spark, folder)
    return kpis.filter_by_state(people, orders, "nation_5", AT_RISK)


@query(
    labelled(
        """SELECT customer_unique_id, Cluster_Name, Recency, Frequency,
        CAST(Monetary AS DOUBLE) AS Monetary, CLV_12m FROM cust
        ORDER BY CLV_12m DESC, customer_unique_id LIMIT 10"""
    )
)
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.top_customers(customer_mart(spark, folder)))


@query(
    labelled(
        f"""SELECT customer_unique_id, Cluster_Name, Recency, Frequency,
        CAST(Monetary AS DOUBLE) AS Monetary, CLV_12m FROM cust WHERE Cluster_Name = '{AT_RISK}'
        ORDER BY CLV_12m DESC, customer_unique_id LIMIT 25"""
    )
)
def top_customers_of_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.top_customers(customer_mart(spark, folder), AT_RISK, 25))


def _states(value: str, name: str) -> str:
    return sql_base(
        f"""SELECT UF, {name}, {half_even(f"{name} / CAST(sum(CAST({name} AS DECIMAL(18,2))) OVER () AS DOUBLE) * 100", 2)}
        AS pct FROM (SELECT customer_state AS UF, {value} AS {name} FROM ob
        WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
    )


@query(_states("CAST(sum(monetary_value) AS DOUBLE)", "receita_total"))
def state_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.state_distribution(base(spark, folder))


@query(_states("count(DISTINCT customer_unique_id)", "n_clientes"))
def state_distribution_customers(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.state_distribution(base(spark, folder), "clientes")


_MONTHLY = """, months AS (SELECT date_trunc('month', order_purchase_timestamp) AS m,
    CAST(sum(monetary_value) AS DOUBLE) AS receita, count(*) AS pedidos,
    count(DISTINCT customer_unique_id) AS clientes_ativos,
    CAST(sum(monetary_value) AS DOUBLE) / count(*) AS ticket,
    max(order_purchase_timestamp) AS latest FROM ob GROUP BY 1),
  ref AS (SELECT date_trunc('month', CASE WHEN CAST(max(latest) AS DATE) < last_day(max(latest))
    THEN max(latest) - INTERVAL 1 MONTH ELSE max(latest) END) AS r FROM months)"""


@query(
    sql_base(
        _MONTHLY + " SELECT strftime(m, '%Y-%m-%d') AS mes, receita, pedidos, clientes_ativos, "
        "ticket FROM months"
    )
)
def monthly_measures(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.monthly(base(spark, folder)).drop("ultima_compra"))


_MOM = ["receita", "pedidos", "clientes_ativos", "ticket"]


@query(
    sql_base(
        _MONTHLY + ", cur AS (SELECT months.* FROM months, ref WHERE m = r), prev AS "
        "(SELECT months.* FROM months, ref WHERE m = r - INTERVAL 1 MONTH) "
        "SELECT strftime(r, '%Y-%m') AS mes_referencia, "
        + ", ".join(f"cur.{n} AS {n}_mes, prev.{n} AS {n}_mes_anterior, "
                    f"(cur.{n} - prev.{n}) / CAST(prev.{n} AS DOUBLE) AS {n}_mom" for n in _MOM)
        + " FROM ref LEFT JOIN cur ON true LEFT JOIN prev ON true"
    )
)
def month_over_month(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.month_over_month(base(spark, folder)))


@query(
    sql_base(
        _MONTHLY + " SELECT strftime(s, '%Y-%m') AS mes, receita, pedidos, clientes_ativos, ticket "
        "FROM (SELECT unnest(generate_series(r - INTERVAL 11 MONTH, r, INTERVAL 1 MONTH)) AS s "
        "FROM ref) LEFT JOIN months ON m = s"
    )
)
def month_series(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.last_months(base(spark, folder)))


@query(
    labelled(
        "SELECT Cluster_Name, count(*) AS clientes, CAST(sum(Monetary) AS DOUBLE) AS receita, "
        "count(*) FILTER (Recency > 365) AS clientes_em_risco, coalesce(CAST(sum(Monetary) "
        "FILTER (Recency > 365) AS DOUBLE), 0) AS receita_em_risco FROM cust GROUP BY 1"
    )
)
def revenue_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.by_cluster(customer_mart(spark, folder))


@query(
    labelled(
        f"""SELECT Cluster_Name, mult, metrica, valor FROM (SELECT Cluster_Name,
        t AS "Ticket atual", v AS "CLV 12m", v / t AS mult FROM (
          SELECT Cluster_Name, {mean("CAST(CLV_12m AS DECIMAL(18,2))")} AS v,
          CAST(sum(Monetary) AS DOUBLE) / (SELECT count(*) FROM ord o
            WHERE o.Cluster_Name = c.Cluster_Name) AS t FROM cust c GROUP BY Cluster_Name))
        UNPIVOT (valor FOR metrica IN ("Ticket atual", "CLV 12m"))"""
    )
)
def clv_vs_ticket(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.value_against_ticket(*marts(spark, folder))


@query(
    labelled(
        """SELECT coalesce(CAST(sum(Monetary) FILTER (Cluster_Name = 'Em Risco / Hibernando'
        AND Recency > 365) AS DOUBLE), 0) AS receita_risco,
        coalesce(CAST(sum(Monetary) FILTER (Cluster_Name = 'Big Spenders (Não-Recorrentes)')
        AS DOUBLE), 0) AS receita_big_spenders,
        coalesce(CAST(sum(Monetary) FILTER (Cluster_Name = 'Novos / Ocasionais') AS DOUBLE), 0)
        AS receita_novos,
        coalesce(CAST(sum(Monetary) FILTER (Cluster_Name = 'Campeões') AS DOUBLE), 0)
        AS receita_campeoes,
        count(*) FILTER (Frequency = 1) / count(*)::DOUBLE AS pct_compra_unica FROM cust"""
    )
)
def action_plan(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.action_plan(customer_mart(spark, folder))


@query(
    labelled(
        """SELECT * FROM (SELECT count(*) FILTER (Frequency = 1) / count(*)::DOUBLE
        AS pct_compra_unica, coalesce(CAST(sum(Monetary) FILTER (Recency > 365) AS DOUBLE), 0)
        AS receita_em_risco, count(*) FILTER (Recency > 365) / count(*)::DOUBLE AS pct_em_risco
        FROM cust), (SELECT sum(Clientes_Retidos)::DOUBLE / sum(Tamanho_Safra)::DOUBLE
        AS retencao_mes_1 FROM cohort WHERE MesIndice = 1)"""
    )
)
def diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    orders = settle(base(spark, folder))
    return kpis.diagnostic(rfm_.rfm(orders, SNAPSHOT), rfm_.cohort_retention(orders))


@query(
    labelled(
        """, s AS (SELECT CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS ord, unnest(['Base (1+ compra)',
        '2+ compras', '3+ compras', '5+ compras']) AS Etapa, unnest([
        count(*) FILTER (Frequency = 1), count(*) FILTER (Frequency = 2),
        count(*) FILTER (Frequency BETWEEN 3 AND 4), count(*) FILTER (Frequency >= 5)]) AS qtd
        FROM cust), c AS (SELECT *, CAST(sum(qtd) OVER (ORDER BY ord DESC) AS BIGINT) AS cum FROM s)
        SELECT *, cum / lag(cum) OVER (ORDER BY ord)::DOUBLE AS conv FROM c"""
    )
)
def funnel(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(kpis.funnel(customers(spark, folder)))


_RISK = """, states AS (SELECT customer_state AS UF, count(*) AS Pedidos,
    count(*) FILTER (review_score <= 2) AS Alto_Risco,
    round_even(count(*) FILTER (review_score <= 2) / count(*)::DOUBLE * 10000, 0) / 10000
    AS Pct_Alto_Risco FROM ob GROUP BY 1)"""


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.coalesce(F.col("review_score") <= 2, F.lit(False)).cast("int")
    return base(spark, folder).withColumn("alto_risco", bad)


@query(sql_base(_RISK + " SELECT * FROM states"))
def state_risk(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.state_risk(_flagged(spark, folder))


@query(
    sql_base(
        _RISK + " SELECT UF, Pedidos, Pct_Alto_Risco, round_even(media * 1e9, 0) / 1e9 AS media, rk "
        "FROM (SELECT *, sum(Pct_Alto_Risco * Pedidos) OVER () / sum(Pedidos) OVER ()::DOUBLE AS "
        "media, rank() OVER (ORDER BY Pct_Alto_Risco DESC) AS rk FROM states) WHERE rk <= 14"
    )
)
def rank_filter(spark: SparkSession, folder: str) -> DataFrame:
    ranking = kpis.risk_ranking(kpis.state_risk(_flagged(spark, folder)))
    return tidy(ranking, 9)


@query(
    labelled(
        "SELECT Cluster_Name, count(*) AS n, CAST(sum(Monetary) AS DOUBLE) AS receita FROM cust "
        "GROUP BY 1 HAVING count(*) > 10"
    )
)
def guarded_sql(spark: SparkSession, folder: str) -> DataFrame:
    customer_mart(spark, folder).createOrReplaceTempView("fato_rfm_clientes")
    rows, refusal = kpis.guarded_sql(
        spark,
        "SELECT Cluster_Name, count(*) AS n, CAST(sum(Monetary) AS DOUBLE) AS receita "
        "FROM fato_rfm_clientes GROUP BY Cluster_Name HAVING count(*) > 10",
    )
    if rows is None:
        raise ValueError(refusal)
    return rows


# ---------------------------------------------------------------- distributions


@query(
    sql_rfm(
        """SELECT Frequency, n AS Qtd_Clientes, n / sum(n) OVER ()::DOUBLE AS Pct_Clientes,
        CAST(sum(n) OVER (ORDER BY Frequency) AS DOUBLE) / sum(n) OVER ()::DOUBLE AS Pct_Acumulado
        FROM (SELECT Frequency, count(*) AS n FROM rfm GROUP BY 1)"""
    )
)
def value_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.value_distribution(customers(spark, folder), "Frequency")


@query(
    sql_rfm(
        """SELECT unnest(['1 compra', '2+ compras', '3+ compras']) AS Grupo,
        unnest([a, b, c]) AS Qtd_Clientes, unnest([a / n::DOUBLE, b / n::DOUBLE, c / n::DOUBLE])
        AS Pct_Clientes FROM (SELECT count(*) FILTER (Frequency = 1) AS a,
        count(*) FILTER (Frequency >= 2) AS b, count(*) FILTER (Frequency >= 3) AS c,
        count(*) AS n FROM rfm)"""
    )
)
def threshold_summary(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.threshold_summary(customers(spark, folder))


def _bands(where: str) -> str:
    return sql_rfm(
        f"""SELECT Faixa_Recency, n AS Qtd_Clientes, n / sum(n) OVER ()::DOUBLE AS Pct_Clientes
        FROM (SELECT CASE WHEN Recency <= 30 THEN '0-30' WHEN Recency <= 90 THEN '31-90'
        WHEN Recency <= 180 THEN '91-180' WHEN Recency <= 365 THEN '181-365' ELSE '365+' END
        AS Faixa_Recency, count(*) AS n FROM rfm WHERE {where} GROUP BY 1)"""
    )


@query(_bands("Recency >= 0"))
def recency_bands(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.recency_bands(customers(spark, folder))


@query(_bands("Frequency > 1 AND Recency > 0"))
def recency_bands_repeat(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.recency_bands_of_repeaters(customers(spark, folder))


@query(
    sql_rfm(
        """, e AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM rfm)
        SELECT Faixa_Monetary, n AS Qtd_Clientes, n / sum(n) OVER ()::DOUBLE AS Pct_Clientes FROM (
        SELECT CASE WHEN Monetary <= q[1] THEN 'Muito Baixo' WHEN Monetary <= q[2] THEN 'Baixo'
        WHEN Monetary <= q[3] THEN 'Médio' WHEN Monetary <= q[4] THEN 'Alto' ELSE 'Muito Alto' END
        AS Faixa_Monetary, count(*) AS n FROM rfm, e GROUP BY 1)"""
    )
)
def monetary_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    return distributions.value_quintiles(stored_customers(spark, folder))


@query(
    labelled(
        "SELECT Cluster_Name, count(*) FILTER (payment_type = 'A') AS A, "
        "count(*) FILTER (payment_type = 'N') AS N, count(*) FILTER (payment_type = 'R') AS R "
        "FROM ord WHERE payment_type IS NOT NULL GROUP BY 1"
    )
)
def crosstab(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True)
    return distributions.crosstab(orders, "Cluster_Name", "payment_type")


@query(
    labelled(
        """SELECT Cluster_Name, payment_type, n, n / sum(n) OVER (PARTITION BY Cluster_Name)::DOUBLE
        AS pct FROM (SELECT Cluster_Name, payment_type, count(*) AS n FROM ord
        WHERE payment_type IS NOT NULL GROUP BY ALL)"""
    )
)
def share_within_group(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True)
    return payment_mix(orders)


@query(
    labelled(
        "SELECT Cluster_Name, " + ", ".join(
            f"count(*) FILTER (payment_type = '{t}') / count(*)::DOUBLE AS {t}" for t in "ANR"
        ) + " FROM ord WHERE payment_type IS NOT NULL GROUP BY 1"
    )
)
def share_pivot(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True)
    return distributions.share_pivot(payment_mix(orders), "Cluster_Name", "payment_type", "pct")


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, count(v) AS count, {half_even("avg(v)", 6)} AS mean,
    {half_even("quantile_cont(v, 0.5)", 6)} AS median, {half_even("stddev_samp(v)", 6)} AS std,
    min(v) AS min, {half_even("quantile_cont(v, 0.25)", 6)} AS p25,
    {half_even("quantile_cont(v, 0.75)", 6)} AS p75, {half_even("quantile_cont(v, 0.95)", 6)} AS p95,
    max(v) AS max, {half_even("skewness(v)", 6)} AS skew
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM rfm)"""
    for c in ("Recency", "Frequency", "Monetary")
)


@query(sql_rfm(_DESCRIBE))
def describe_skew(spark: SparkSession, folder: str) -> DataFrame:
    people = stored_customers(spark, folder)
    return tidy(distributions.describe(people, ["Recency", "Frequency", "Monetary"]), 6)


@query(
    sql_rfm(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS metric, {half_even("q1", 6)} AS q1, {half_even("q3", 6)} AS q3,
            {half_even("q3 - q1", 6)} AS iqr, {half_even("q3 + 1.5 * (q3 - q1)", 6)} AS upper_fence,
            {half_even("greatest(q3 + 1.5 * (q3 - q1), p95)", 6)} AS plot_limit FROM (SELECT
            quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75)
            AS q3, quantile_cont(CAST({c} AS DOUBLE), 0.95) AS p95 FROM rfm)"""
            for c in ("Recency", "Frequency", "Monetary")
        )
    )
)
def iqr_bounds(spark: SparkSession, folder: str) -> DataFrame:
    found = distributions.iqr_bounds(customers(spark, folder), ["Recency", "Frequency", "Monetary"])
    return tidy(found, 6)


@query(
    sql_rfm(
        "SELECT customer_unique_id, CAST(Monetary AS DOUBLE) AS Monetary FROM rfm WHERE "
        "CAST(Monetary AS DOUBLE) <= (SELECT quantile_cont(CAST(Monetary AS DOUBLE), 0.99) FROM rfm)"
    )
)
def outlier_cap_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = distributions.without_outliers(stored_customers(spark, folder), "Monetary")
    return tidy(kept.select("customer_unique_id", "Monetary"))


def _histogram(x: str, bins: int) -> str:
    return sql_rfm(
        f"""SELECT b AS bin, coalesce(n, 0) AS n, {half_even(f"lo + b * ((hi - lo) / {bins})", 6)} AS low,
        {half_even(f"lo + (b + 1) * ((hi - lo) / {bins})", 6)} AS high
        FROM (SELECT min({x}) AS lo, max({x}) AS hi FROM rfm), range({bins}) AS r(b) LEFT JOIN (
        SELECT least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS b,
        count(*) AS n FROM (SELECT {x} AS v, min({x}) OVER () AS lo, max({x}) OVER () AS hi
        FROM rfm) GROUP BY 1) USING (b)"""
    )


@query(_histogram("CAST(Recency AS DOUBLE)", 35))
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    bars = distributions.histogram(stored_customers(spark, folder), "Recency", 35)
    return tidy(bars, 6)


@query(_histogram("ln(1 + CAST(Monetary AS DOUBLE))", 50))
def histogram_log(spark: SparkSession, folder: str) -> DataFrame:
    value = F.log1p(F.col("Monetary").cast("double"))
    bars = distributions.histogram(stored_customers(spark, folder), value, 50)
    return tidy(bars, 6)


@query(
    sql_rfm(
        " UNION ALL ".join(
            f"""SELECT '{x}' AS x, {half_even("regr_slope(y, v)", 8)} AS slope,
            {half_even("regr_intercept(y, v)", 8)} AS intercept, {half_even("regr_r2(y, v)", 8)} AS r2
            FROM (SELECT CAST({x} AS DOUBLE) AS v, ln(1 + CAST(Monetary AS DOUBLE)) AS y FROM rfm)"""
            for x in ("Recency", "Frequency")
        )
    )
)
def regression_line(spark: SparkSession, folder: str) -> DataFrame:
    people = stored_customers(spark, folder)
    y = F.log1p(F.col("Monetary").cast("double"))
    lines = [distributions.regression_line(people, x, y) for x in ("Recency", "Frequency")]
    return tidy(lines[0].unionByName(lines[1]), 8)


@query(
    sql_rfm(
        " UNION ALL ".join(
            f"SELECT '{a}' AS metric, "
            + ", ".join(
                "1.0::DOUBLE AS " + b if a == b else
                half_even(f"corr(CAST({min(a, b)} AS DOUBLE), CAST({max(a, b)} AS DOUBLE))", 8) + f" AS {b}"
                for b in ("Recency", "Frequency", "Monetary")
            )
            + " FROM rfm"
            for a in ("Recency", "Frequency", "Monetary")
        )
    )
)
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["Recency", "Frequency", "Monetary"]
    return tidy(distributions.correlation_matrix(customers(spark, folder), columns), 8)


@query(
    sql_rfm(
        "SELECT customer_unique_id FROM rfm ORDER BY md5('42:' || customer_unique_id), "
        "customer_unique_id LIMIT 500"
    )
)
def uniform_sample(spark: SparkSession, folder: str) -> DataFrame:
    people = stored_customers(spark, folder)
    return ordering.sample_rows(people, "customer_unique_id", 500).select("customer_unique_id")


# ---------------------------------------------------------------- tests

_METRICS = ["Recency", "Frequency", "Monetary", "Avg_Order_Value", "Avg_Review"]


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return settle(customers(spark, folder).withColumn("Cluster", rule_cluster()))


def _per_metric(body: str) -> str:
    return " UNION ALL ".join(body.replace("{c}", c) for c in _METRICS)


_F_TAIL = """(SELECT round(sum(exp(lgamma(dw / 2.0 + db / 2.0) - lgamma(dw / 2.0) - lgamma(db / 2.0)
    + (dw / 2.0 - 1) * ln(t) + (db / 2.0 - 1) * ln(1 - t))) * (dw / (dw + db * f)) / 20000, 4)
    FROM (SELECT (i + 0.5) / 20000 * (dw / (dw + db * f)) AS t FROM range(20000) AS r(i)))"""


@query(
    labelled(
        ", stat AS (" + _per_metric(
            """SELECT '{c}' AS metric, (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS db, n - k AS dw
            FROM (SELECT count(DISTINCT Cluster) AS k, count(*) AS n, sum((v - gm) * (v - gm)) AS ssw,
            sum((gm - am) * (gm - am)) AS ssb FROM (SELECT Cluster, CAST({c} AS DOUBLE) AS v,
            avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY Cluster) AS gm,
            avg(CAST({c} AS DOUBLE)) OVER () AS am FROM cust WHERE {c} IS NOT NULL))"""
        )
        + f""") SELECT metric, {half_even("f", 4)} AS f_stat, db AS df_between, dw AS df_within,
        CASE WHEN f > 100 THEN 0.0 ELSE {_F_TAIL} END AS p_value FROM stat"""
    )
)
def anova(spark: SparkSession, folder: str) -> DataFrame:
    found = hypothesis.anova(_grouped(spark, folder), "Cluster", _METRICS)
    return tidy(found, 4)


_CHI2_TAIL = """CASE WHEN x > 1400 THEN 0.0 ELSE (SELECT greatest(0, round(1 - sum(exp(-x / 2
    + (k / 2.0::DOUBLE + i) * ln(x / 2) - lgamma(k / 2.0::DOUBLE + i + 1))), 6)) FROM range(3000) AS r(i)) END"""


def _kruskal_sql(metrics: list[str], table: str, group: str) -> str:
    """H with the correction for ties and its tail, for columns of a table."""
    stats = " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, (12.0 / (n * (n + 1.0)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS x,
        k - 1 AS k FROM (SELECT sum(rs * rs / g) AS s, sum(g)::DOUBLE AS n, count(*) AS k, any_value(t) AS t
          FROM (SELECT {group}, sum(rk) AS rs, count(*)::DOUBLE AS g, any_value(t) AS t FROM (
            SELECT {group}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)
            / 2.0::DOUBLE AS rk, (SELECT sum(x * x * x - x) FROM (SELECT count(*)::DOUBLE AS x
            FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})) AS t
            FROM {table} WHERE {c} IS NOT NULL) GROUP BY {group}))"""
        for c in metrics
    )
    return labelled(
        f""", stat AS ({stats}) SELECT metric, {half_even("x", 4)} AS h_stat, k AS df,
        {_CHI2_TAIL} AS p_value FROM stat"""
    )


def _p_to_six(found: DataFrame, digits: int) -> DataFrame:
    return tidy(found.withColumn("p_value", F.round("p_value", 6)).withColumn(
        found.columns[1 if "metric" in found.columns else 0],
        F.rint(F.col(found.columns[1 if "metric" in found.columns else 0]) * 10**digits) / 10**digits,
    ))


@query(_kruskal_sql(_METRICS, "cust", "Cluster"))
def kruskal(spark: SparkSession, folder: str) -> DataFrame:
    return _p_to_six(hypothesis.kruskal(_grouped(spark, folder), "Cluster", _METRICS), 4)


_TUKEY = ["Monetary", "Frequency", "Recency"]


def _tukey_sql() -> str:
    """Mean differences, and the tail of the studentized range by the same quadrature."""
    def nodes(n: int) -> str:
        x, w = np.polynomial.legendre.leggauss(n)
        pairs = ", ".join(f"({float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for a, b in zip(x, w, strict=True))
        return f"(VALUES {pairs})"

    def normal(z: str) -> str:
        def poly(coefficients: tuple) -> str:
            text = repr(float(coefficients[0])) + "::DOUBLE"
            for c in coefficients[1:]:
                text = f"({text} * abs({z}) + {float(c)!r}::DOUBLE)"
            return text

        far = f"(abs({z}) + 0.65)"
        for i in (4, 3, 2, 1):
            far = f"(abs({z}) + {i}.0::DOUBLE / {far})"
        density = f"exp(-{z} * {z} / 2)"
        tail = (f"CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < {probability.NORMAL_FAR}::DOUBLE THEN "
                f"{density} * {poly(probability.NORMAL_TOP)} / {poly(probability.NORMAL_BOTTOM)} "
                f"ELSE {density} / ({far} * sqrt(2 * pi())) END")
        return f"(CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"

    groups = " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, Cluster, count(*)::DOUBLE AS n, avg(CAST({c} AS DOUBLE)) AS mean,
        var_pop(CAST({c} AS DOUBLE)) * count(*) AS ss FROM cust WHERE {c} IS NOT NULL GROUP BY Cluster"""
        for c in _TUKEY
    )
    return labelled(
        f""", g AS ({groups}),
        w AS (SELECT metric, count(*)::DOUBLE AS k, sum(n) - count(*) AS v, sum(ss) / (sum(n) - count(*)) AS mse
          FROM g GROUP BY metric),
        pairs AS (SELECT metric, a.Cluster AS g1, b.Cluster AS g2, b.mean - a.mean AS meandiff, k, v,
          abs(b.mean - a.mean) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)) AS q
          FROM g a JOIN g b USING (metric) JOIN w USING (metric) WHERE a.Cluster < b.Cluster),
        outer_ AS (SELECT metric, g1, g2, k, q, v, 9 / sqrt(2 * v) AS half, x, wt FROM pairs,
          {nodes(48)} AS t(x, wt)),
        mid AS (SELECT metric, g1, g2, k, q, 1 + half * x AS s, half * wt * exp(v / 2 * ln(v) - lgamma(v / 2)
          - (v / 2 - 1) * ln(2) + (v - 1) * ln(1 + half * x) - v * (1 + half * x) * (1 + half * x) / 2) AS d
          FROM outer_),
        inner_ AS (SELECT metric, g1, g2, k, d, wt, 8.5::DOUBLE * x AS z, 8.5::DOUBLE * x - q * s AS y
          FROM mid, {nodes(96)} AS t(x, wt)),
        p AS (SELECT metric, g1, g2, 1 - sum(d * 8.5::DOUBLE * k * wt * exp(-z * z / 2) / sqrt(2 * pi())
          * pow(least(1, greatest(0, {normal("z")} - {normal("y")})), k - 1)) AS p FROM inner_ GROUP BY ALL)
        SELECT metric, CAST(g1 AS VARCHAR) AS group1, CAST(g2 AS VARCHAR) AS group2,
          {half_even("meandiff", 6)} AS meandiff, abs(round(least(1, greatest(0, p)), 6)) AS p_adj,
          p < 0.05 AS reject FROM pairs JOIN p USING (metric, g1, g2)"""
    )


@query(_tukey_sql())
def tukey(spark: SparkSession, folder: str) -> DataFrame:
    found = hypothesis.tukey(_grouped(spark, folder), "Cluster", _TUKEY).drop("lower", "upper")
    return tidy(found.withColumn("p_adj", F.abs(F.round("p_adj", 6))), 6)


@query()
def tukey_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return hypothesis.tukey(_grouped(spark, folder), "Cluster", _TUKEY)


@query(
    labelled(
        """, o AS (SELECT Cluster_Name, payment_type, count(*)::DOUBLE AS o FROM ord
        WHERE payment_type IS NOT NULL GROUP BY ALL), r AS (SELECT Cluster_Name, sum(o) AS r FROM o
        GROUP BY 1), c AS (SELECT payment_type, sum(o) AS c FROM o GROUP BY 1)
        SELECT round_even(x * 1e6, 0) / 1e6 AS chi2, k AS df, """ + _CHI2_TAIL + """ AS p_value FROM (
        SELECT sum((coalesce(o.o, 0) - r.r * c.c / n) * (coalesce(o.o, 0) - r.r * c.c / n)
        / (r.r * c.c / n)) AS x, (count(DISTINCT r.Cluster_Name) - 1)
        * (count(DISTINCT c.payment_type) - 1) AS k
        FROM r CROSS JOIN c CROSS JOIN (SELECT sum(o) AS n FROM o)
        LEFT JOIN o ON o.Cluster_Name = r.Cluster_Name AND o.payment_type = c.payment_type)"""
    )
)
def chi_square(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder, payments=True)
    return _p_to_six(hypothesis.chi_square(orders, "Cluster_Name", "payment_type"), 6)


@query(
    labelled(
        """SELECT Cluster_Name, count(*) AS n, min(review_score) AS min,
        quantile_cont(review_score, 0.25) AS q1, quantile_cont(review_score, 0.5) AS median,
        quantile_cont(review_score, 0.75) AS q3, max(review_score) AS max
        FROM ord WHERE review_score IS NOT NULL GROUP BY 1"""
    )
)
def review_five_numbers(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder)
    return distributions.five_numbers(orders, "review_score", "Cluster_Name")


@query(_kruskal_sql(["review_score"], "ord", "Cluster_Name"))
def kruskal_reviews(spark: SparkSession, folder: str) -> DataFrame:
    _, orders = marts(spark, folder)
    return _p_to_six(hypothesis.kruskal(orders, "Cluster_Name", ["review_score"]), 4)
