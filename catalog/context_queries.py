"""Key figures under filters that travel along relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.customer_queries import _BASE_MEASURES, _DERIVED, _ORDER_MEASURES
from catalog.model import marts, tidy
from catalog.prelude import labelled
from catalog.registry import query
from clientela.operators import context as context_
from clientela.operators.context import CALENDAR, CUSTOMERS, SEGMENTS, Context
from clientela.sources.dimensions import AT_RISK, CHAMPIONS, calendar_of, dim_segments

YEAR, CLUSTER = 1997, AT_RISK


def _star(spark: SparkSession, folder: str) -> Context:
    people, orders = marts(spark, folder)
    calendar = calendar_of(orders, "order_purchase_timestamp")
    return context_.star_context(people, orders, calendar, dim_segments(spark))


def _of_year(context: Context) -> Context:
    return context.where(CALENDAR, "Ano", F.col("Ano") == YEAR)


def _of_cluster(context: Context, name: str = CLUSTER) -> Context:
    return context.where(SEGMENTS, "Cluster_Name", F.col("Cluster_Name") == name)


def _rounded(found: DataFrame) -> DataFrame:
    ticket = F.rint(F.col("ticket_medio_cliente") * 1e6) / 1e6
    return tidy(found.withColumn("ticket_medio_cliente", ticket))


def _sql(customers: str = "true", orders: str = "true") -> str:
    return labelled(
        f"SELECT *, {_DERIVED} FROM (SELECT {_BASE_MEASURES} FROM cust WHERE {customers}), "
        f"(SELECT {_ORDER_MEASURES} FROM ord WHERE {orders})"
    )


_IN_YEAR, _IN_CLUSTER = f"year(order_purchase_timestamp) = {YEAR}", f"Cluster_Name = '{CLUSTER}'"


@query(_sql(orders=_IN_YEAR))
def measures_of_year(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(context_.measures(_of_year(_star(spark, folder))))


@query(_sql(_IN_CLUSTER, _IN_CLUSTER))
def measures_of_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(context_.measures(_of_cluster(_star(spark, folder))))


@query(_sql(_IN_CLUSTER, f"{_IN_CLUSTER} AND {_IN_YEAR}"))
def measures_of_year_and_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(context_.measures(_of_cluster(_of_year(_star(spark, folder)))))


@query(
    labelled(
        f"""SELECT *, {_DERIVED} FROM (SELECT year(order_purchase_timestamp) AS Ano, {_ORDER_MEASURES}
        FROM ord WHERE {_IN_CLUSTER} GROUP BY 1), (SELECT {_BASE_MEASURES} FROM cust WHERE {_IN_CLUSTER})"""
    )
)
def measures_by_year_of_cluster(spark: SparkSession, folder: str) -> DataFrame:
    found = context_.measures(_of_cluster(_star(spark, folder)), (CALENDAR, "Ano"))
    return _rounded(found)


@query(
    labelled(
        f"""SELECT *, {_DERIVED} FROM (SELECT CAST(CASE Cluster_Name WHEN 'Novos / Ocasionais' THEN 3
        WHEN 'Em Risco / Hibernando' THEN 2 ELSE 1 END AS BIGINT) AS Prioridade, {_BASE_MEASURES} FROM cust
        GROUP BY 1) LEFT JOIN (SELECT CAST(CASE Cluster_Name WHEN 'Novos / Ocasionais' THEN 3
        WHEN 'Em Risco / Hibernando' THEN 2 ELSE 1 END AS BIGINT) AS Prioridade, {_ORDER_MEASURES} FROM ord
        WHERE {_IN_YEAR} GROUP BY 1) USING (Prioridade)"""
    )
)
def measures_by_priority_of_year(spark: SparkSession, folder: str) -> DataFrame:
    found = context_.measures(_of_year(_star(spark, folder)), (SEGMENTS, "Prioridade"))
    return _rounded(found)


@query(
    labelled(
        f"""SELECT k AS n_top, receita_top, receita_total, receita_top / receita_total
        AS pct_concentracao FROM (SELECT any_value(k) AS k, CAST(sum(Monetary) FILTER (rk <= k) AS
        DOUBLE) AS receita_top FROM (SELECT Monetary, rank() OVER (ORDER BY Monetary DESC) AS rk,
        (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM cust WHERE {_IN_CLUSTER}) AS k FROM cust)),
        (SELECT CAST(sum(Monetary) AS DOUBLE) AS receita_total FROM cust WHERE {_IN_CLUSTER})"""
    )
)
def top_share_of_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(context_.concentration(_of_cluster(_star(spark, folder))))


@query(
    labelled(
        f"""SELECT count(*) FILTER (Cluster_Name = '{CHAMPIONS}') / count(*) FILTER (Recency <= 365)::DOUBLE
        AS pct_campeoes, count(*) FILTER (Cluster_Name = '{AT_RISK}') /
        count(*) FILTER (Recency <= 365)::DOUBLE AS pct_em_risco FROM cust"""
    )
)
def segment_shares_without_outer_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A calculation that takes the outer bound on recency away for its numerator."""
    context = _star(spark, folder).where(CUSTOMERS, "Recency", F.col("Recency") <= 365)
    whole = context.rows(CUSTOMERS).agg(F.count(F.lit(1)).alias("n"))
    parts = context_.shares_of_segments(
        context.without(CUSTOMERS, "Recency"), {"pct_campeoes": CHAMPIONS, "pct_em_risco": AT_RISK}
    )
    everyone = context.without(CUSTOMERS).rows(CUSTOMERS).agg(F.count(F.lit(1)).alias("all"))
    one = F.lit(1).alias("one")
    row = parts.select("*", one).join(whole.select("*", one), "one").join(everyone.select("*", one), "one")
    return row.select(*[(F.rint(F.col(c) * F.col("all")) / F.col("n")).alias(c)
                        for c in ("pct_campeoes", "pct_em_risco")])


@query(
    labelled(
        """SELECT clientes, receita, clientes_em_risco, receita_em_risco,
        clientes_em_risco / clientes::DOUBLE AS pct_em_risco,
        receita_em_risco / receita AS pct_receita_em_risco FROM (
        SELECT count(*) FILTER (Recency <= 400) AS clientes,
        CAST(sum(Monetary) FILTER (Recency <= 400) AS DOUBLE) AS receita,
        count(*) FILTER (Recency > 365) AS clientes_em_risco,
        CAST(sum(Monetary) FILTER (Recency > 365) AS DOUBLE) AS receita_em_risco FROM cust)"""
    )
)
def risk_instead_of_outer_bound(spark: SparkSession, folder: str) -> DataFrame:
    context = _star(spark, folder).where(CUSTOMERS, "Recency", F.col("Recency") <= 400)
    return tidy(context_.revenue_at_risk(context))
