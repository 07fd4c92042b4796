import pytest

from clientela.operators import distributions as ds
from clientela.operators import kpis as k
from clientela.sources.dimensions import AT_RISK, CHAMPIONS
from tests.fixtures import day


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("a", CHAMPIONS, 10, 3, 300.0, 100.0, 150.0, 5.0),
            ("b", AT_RISK, 400, 1, 50.0, 50.0, 25.0, 2.0),
            ("c", AT_RISK, 200, 2, 150.0, 75.0, 75.0, None),
            ("d", CHAMPIONS, 5, 6, 500.0, 80.0, 250.0, 4.0),
        ],
        "customer_unique_id string, Cluster_Name string, Recency int, Frequency int, "
        "Monetary double, Avg_Order_Value double, CLV_12m double, Avg_Review double",
    )


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("o1", "a", "SP", "2018-06-10", 100.0, CHAMPIONS), ("o2", "a", "SP", "2018-07-10", 200.0, CHAMPIONS),
        ("o3", "b", "RJ", "2018-07-15", 50.0, AT_RISK), ("o4", "c", "SP", "2018-05-01", 150.0, AT_RISK),
        ("o5", "d", "MG", "2018-08-29", 500.0, CHAMPIONS),
    ]
    return spark.createDataFrame(
        [(o, c, s, day(t), v, n, 4.0) for o, c, s, t, v, n in rows],
        "order_id string, customer_unique_id string, customer_state string, "
        "order_purchase_timestamp timestamp_ntz, monetary_value double, Cluster_Name string, "
        "review_score double",
    )


def test_overall(people):
    row = k.overall_kpis(people).first()
    assert (row["total_clientes"], row["receita_total_brl"], row["ticket_medio_brl"]) == (4, 1000.0, 250.0)
    assert (row["pct_1_compra"], row["clientes_em_risco"]) == (0.25, 1)


def test_three_kinds_of_ticket(people, orders):
    row = k.measures(people, orders).first()
    assert row["ticket_medio"] == 200.0  # revenue per order
    assert row["ticket_medio_cliente"] == pytest.approx(76.25)  # mean of means
    assert k.overall_kpis(people).first()["ticket_medio_brl"] == 250.0  # value per customer


def test_measures_by_cluster(people, orders):
    rows = {r["Cluster_Name"]: r for r in k.measures(people, orders, ["Cluster_Name"]).collect()}
    assert rows[CHAMPIONS]["receita_total"] == 800.0
    assert rows[CHAMPIONS]["total_pedidos"] == 3
    assert rows[AT_RISK]["pct_receita_em_risco"] == 0.25


def test_state_filter(people, orders):
    row = k.filter_by_state(people, orders, "sp").first()
    assert row["encontrado"] and row["n_clientes"] == 2 and row["receita_total"] == 450.0
    row = k.filter_by_state(people, orders, "sp", AT_RISK).first()
    assert row["n_clientes"] == 1
    assert not k.filter_by_state(people, orders, "xx").first()["encontrado"]


def test_state_distribution(orders):
    rows = k.state_distribution(orders).collect()
    assert [r["UF"] for r in rows] == ["MG", "SP", "RJ"]
    assert sum(r["pct"] for r in rows) == pytest.approx(100, abs=0.02)
    assert {r["UF"]: r["n_clientes"] for r in k.state_distribution(orders, "clientes").collect()}["SP"] == 2


def test_month_over_month(orders):
    row = k.month_over_month(orders).first()
    assert row["mes_referencia"] == "2018-07"  # August is not over
    assert (row["receita_mes"], row["receita_mes_anterior"]) == (250.0, 100.0)
    assert row["receita_mom"] == 1.5 and row["pedidos_mom"] == 1.0
    months = k.last_months(orders).orderBy("mes").collect()
    assert len(months) == 12 and months[-1]["mes"] == "2018-07"
    assert months[0]["receita"] is None


def test_funnel(people):
    rows = k.funnel(people).orderBy("ord").collect()
    assert [r["cum"] for r in rows] == [4, 3, 2, 1]
    assert rows[0]["conv"] is None and rows[1]["conv"] == 0.75


def test_action_plan_and_clusters(people):
    assert k.action_plan(people).first()["receita_risco"] == 50.0
    rows = {r["Cluster_Name"]: r for r in k.by_cluster(people).collect()}
    assert rows[AT_RISK]["clientes_em_risco"] == 1 and rows[AT_RISK]["receita"] == 200.0
    top = k.top_customers(people, limit=2).collect()
    assert [r["customer_unique_id"] for r in top] == ["d", "a"]


def test_value_against_ticket(people, orders):
    rows = k.value_against_ticket(people, orders).collect()
    assert len(rows) == 4
    assert {r["metrica"] for r in rows} == {"Ticket atual", "CLV 12m"}


def test_state_risk_keeps_ties(spark):
    states = spark.createDataFrame(
        [(f"S{i:02d}", 10, 0.5 if i < 16 else 0.1) for i in range(20)],
        "UF string, Pedidos bigint, Pct_Alto_Risco double",
    )
    ranked = k.risk_ranking(states).collect()
    assert len(ranked) == 16
    assert ranked[0]["media"] == pytest.approx(0.42)


@pytest.mark.parametrize(
    "text, reason",
    [("DELETE FROM t", "SELECT"), ("select created_at from t", "read only"), ("with x as (drop) select 1", "read only")],
)
def test_guarded_sql_refuses(spark, text, reason):
    rows, why = k.guarded_sql(spark, text)
    assert rows is None and reason in why


def test_guarded_sql_runs_and_limits(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    with pytest.warns(UserWarning, match="first 100"):
        rows, why = k.guarded_sql(spark, "  SELECT * FROM numbers")
    assert why is None and rows.count() == 100
    rows, why = k.guarded_sql(spark, "SELECT * FROM no_such_table")
    assert rows is None and "no_such_table" in why


def test_bands_of_repeaters_leave_out_day_zero(spark):
    df = spark.createDataFrame([(0, 2), (10, 2), (31, 3), (400, 1)], "Recency int, Frequency int")
    every = {r["Faixa_Recency"]: r["Qtd_Clientes"] for r in ds.recency_bands(df).collect()}
    assert every == {"0-30": 2, "31-90": 1, "365+": 1}
    repeat = {r["Faixa_Recency"]: r["Qtd_Clientes"] for r in ds.recency_bands_of_repeaters(df).collect()}
    assert repeat == {"0-30": 1, "31-90": 1}


def test_overlapping_groups(people):
    rows = {r["Grupo"]: r["Qtd_Clientes"] for r in ds.threshold_summary(people).collect()}
    assert rows == {"1 compra": 1, "2+ compras": 3, "3+ compras": 2}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT 1 / (id - id) FROM range(3)",
    ],
)
def test_guarded_sql_neither_calls_out_nor_raises(spark, text):
    rows, why = k.guarded_sql(spark, text)
    assert rows is None and why
