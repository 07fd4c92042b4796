"""Filters along relationships."""

import pytest
from pyspark.sql import functions as F

from clientela.operators import context as c
from clientela.operators import kpis
from clientela.sources.dimensions import AT_RISK, CHAMPIONS, calendar_of, dim_segments
from tests.test_kpis import orders, people  # noqa: F401


@pytest.fixture(scope="module")
def star(spark, people, orders):  # noqa: F811
    states = spark.createDataFrame([("SP", 0.2), ("RJ", 0.9), ("XX", 0.9)], "UF string, risco double")
    calendar = calendar_of(orders, "order_purchase_timestamp")
    return c.star_context(people, orders, calendar, dim_segments(spark), states)


def one(df):
    return df.first().asDict()


def test_without_filters_as_before(star, people, orders):  # noqa: F811
    assert one(c.measures(star)) == one(kpis.measures(people, orders).select(c.measures(star).columns))


def test_a_year_or_month_reaches_orders_only(star):
    row = one(c.measures(star.where(c.CALENDAR, "Mes", F.col("Mes") == 7)))
    assert row["total_clientes"] == 4 and row["receita_total"] == 1000.0
    assert row["total_pedidos"] == 2 and row["receita_pedidos"] == 250.0
    assert row["ticket_medio"] == 500.0


def test_a_segment_reaches_customers_and_their_orders(star):
    by_dimension = star.where(c.SEGMENTS, "Cluster_Name", F.col("Cluster_Name") == AT_RISK)
    row = one(c.measures(by_dimension))
    assert row["total_clientes"] == 2 and row["total_pedidos"] == 2 and row["receita_pedidos"] == 200.0
    both = by_dimension.where(c.CALENDAR, "Mes", F.col("Mes") == 7)
    assert one(c.measures(both))["total_pedidos"] == 1


def test_a_state_does_not_reach_customers(star):
    row = one(c.measures(star.where(c.STATES, "risco", F.col("risco") > 0.5)))
    assert row["total_clientes"] == 4 and row["total_pedidos"] == 1
    # Orders without a state of the table are left out only if a filter reaches them.
    assert one(c.measures(star))["total_pedidos"] == 5


def test_filters_on_orders_stay_there(star):
    row = one(c.measures(star.where(c.ORDERS, "customer_state", F.col("customer_state") == "SP")))
    assert row["total_clientes"] == 4 and row["total_pedidos"] == 3


def test_figures_by_a_dimension(star):
    rows = {r["Mes"]: r for r in c.measures(star, (c.CALENDAR, "Mes")).collect()}
    assert set(rows) == {5, 6, 7, 8}
    assert {m: r["total_pedidos"] for m, r in rows.items()} == {5: 1, 6: 1, 7: 2, 8: 1}
    assert {r["total_clientes"] for r in rows.values()} == {4}
    rows = {r["Prioridade"]: r for r in c.measures(star, (c.SEGMENTS, "Prioridade")).collect()}
    assert {p: (r["total_clientes"], r["total_pedidos"]) for p, r in rows.items()} == {1: (2, 3), 2: (2, 2)}


def test_own_filters_replace_outer_ones(star):
    outer = star.where(c.CUSTOMERS, "Recency", F.col("Recency") < 100)
    row = one(c.revenue_at_risk(outer))
    assert (row["clientes"], row["clientes_em_risco"], row["receita_em_risco"]) == (2, 1, 50.0)
    shares = c.shares_of_segments(
        star.where(c.CUSTOMERS, "Cluster_Name", F.col("Cluster_Name") == AT_RISK),
        {"a": AT_RISK, "b": CHAMPIONS},
    )
    assert one(shares) == {"a": 1.0, "b": 1.0}
    kept = star.where(c.SEGMENTS, "Cluster_Name", F.col("Cluster_Name") == AT_RISK)
    assert one(c.shares_of_segments(kept, {"a": AT_RISK, "b": CHAMPIONS})) == {"a": 1.0, "b": 0.0}


def test_the_strongest_customers_are_taken_from_all(star):
    row = one(c.concentration(star.where(c.SEGMENTS, "Cluster_Name", F.col("Cluster_Name") == AT_RISK), 0.5))
    assert row == {"n_top": 1, "receita_top": 500.0, "receita_total": 200.0, "pct_concentracao": 2.5}
    assert one(c.concentration(star, 0.25))["pct_concentracao"] == 0.5
    assert one(c.concentration(star.where(c.CUSTOMERS, "Recency", F.col("Recency") > 9999)))["n_top"] == 0


def test_months_of_a_context(star):
    row = one(c.months(star.where(c.CUSTOMERS, "Cluster_Name", F.col("Cluster_Name") == AT_RISK)))
    assert row["mes_referencia"] == "2018-06" and row["receita_mes"] is None


def test_unknown_columns_are_refused(star):
    with pytest.raises(ValueError):
        star.where(c.CALENDAR, "Monetary", F.lit(True))
    with pytest.raises(ValueError):
        star.attribute(c.CUSTOMERS, c.CALENDAR, "Ano")


def test_only_what_a_filter_reaches_is_joined(star):
    outer = star.where(c.CALENDAR, "Mes", F.col("Mes") == 7)
    plan = outer.rows(c.CUSTOMERS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert outer.without(c.CALENDAR).rows(c.ORDERS)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
