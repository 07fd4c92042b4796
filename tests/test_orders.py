import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clientela.operators import orders as o
from clientela.operators import quality as q
from clientela.operators.rfm import cohort_retention, rfm
from tests.fixtures import day, order_tables

SNAPSHOT = "2018-09-04"


def by_id(df, key):
    return {r[key]: r for r in df.collect()}


def test_unique_key(spark):
    orders = spark.sql("SELECT 'o1' AS order_id UNION ALL SELECT 'o1'")
    with pytest.raises(q.QualityError):
        q.check_unique(orders, "order_id")


def test_missing_purchase_date(spark):
    tables = order_tables(spark)
    q.check_orders(tables.orders)
    empty = tables.orders.withColumn(
        "order_purchase_timestamp", F.lit(None).cast("timestamp_ntz")
    )
    with pytest.raises(q.QualityError):
        q.check_orders(empty)


def test_customer_checks(spark):
    tables = order_tables(spark)
    q.check_customers(tables.customers)
    with pytest.warns(UserWarning, match="3 customers"):
        q.check_customers(tables.customers.withColumn("customer_unique_id", F.lit(None)))
    with pytest.raises(q.QualityError):
        q.check_customers(tables.customers.unionByName(tables.customers))


def test_latest_review(spark):
    reviews = spark.createDataFrame(
        [("o1", 3, day("2018-01-01")), ("o1", 5, day("2018-01-10")), ("o2", 4, day("2018-02-01"))],
        "order_id string, review_score int, review_creation_date timestamp_ntz",
    )
    kept = by_id(q.latest_review(reviews), "order_id")
    assert {k: r["review_score"] for k, r in kept.items()} == {"o1": 5, "o2": 4}
    first = by_id(q.first_review(reviews), "order_id")
    assert first["o1"]["review_score"] == 3


def test_review_without_date_is_latest(spark):
    reviews = spark.createDataFrame(
        [("o1", 3, day("2020-01-01")), ("o1", 5, None)],
        "order_id string, review_score int, review_creation_date timestamp_ntz",
    )
    assert q.latest_review(reviews).first()["review_score"] == 5
    assert q.first_review(reviews).first()["review_score"] == 3


@pytest.mark.parametrize("latest, ok", [("2018-09-03", True), ("2018-09-04", True), ("2018-10-01", False)])
def test_snapshot(spark, latest, ok):
    orders = spark.createDataFrame([(day(latest),)], "order_purchase_timestamp timestamp_ntz")
    if ok:
        q.check_snapshot(orders, SNAPSHOT)
    else:
        with pytest.raises(q.QualityError):
            q.check_snapshot(orders, SNAPSHOT)


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "a int, b string")
    rows = by_id(q.quality_report(df, "t"), "coluna")
    assert (rows["a"]["nulos"], rows["b"]["nulos"], rows["a"]["linhas"]) == (1, 0, 3)
    assert rows["a"]["tipo"] == "int"


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Monetary"):
        q.check_columns(spark.sql("SELECT 1 AS Recency"), ["Recency", "Monetary"])


def test_orders_base_and_rfm(spark):
    base = o.orders_base(order_tables(spark))
    assert {r["order_id"] for r in base.collect()} == {"o1", "o2", "o3"}
    assert "product_category" not in base.columns
    people = by_id(rfm(base, SNAPSHOT), "customer_unique_id")
    assert set(people) == {"u1", "u2"}
    u1, u2 = people["u1"], people["u2"]
    assert (u1["Recency"], u1["Frequency"], float(u1["Monetary"])) == (95, 2, 270.0)
    assert (u1["Avg_Order_Value"], u1["Items"], u1["Avg_Review"]) == (135.0, 2, 5.0)
    assert (u2["Recency"], u2["Frequency"], float(u2["Monetary"])) == (173, 1, 210.0)
    again = by_id(rfm(base.union(base), SNAPSHOT, one_row_per_order=False), "customer_unique_id")
    assert again["u1"]["Frequency"] == 2


def test_rfm_refuses_an_early_snapshot(spark):
    people = rfm(o.orders_base(order_tables(spark)), "2017-01-01")
    with pytest.raises(PySparkException, match="snapshot"):
        people.collect()


def test_recency_counts_elapsed_days(spark):
    base = spark.sql(
        "SELECT 'u' AS customer_unique_id, 'o' AS order_id, 1.0D AS monetary_value, 1L AS n_items, "
        "CAST(NULL AS DOUBLE) AS review_score, "
        "TIMESTAMP_NTZ '2018-09-03 10:00:00' AS order_purchase_timestamp"
    )
    assert rfm(base, SNAPSHOT).first()["Recency"] == 0


def test_value_falls_back_to_items_and_sums_of_nothing_are_zero(spark):
    tables = order_tables(spark)
    unpaid = tables.with_(payments=tables.payments.where("order_id != 'o2'"))
    base = by_id(o.orders_base(unpaid), "order_id")
    assert float(base["o2"]["monetary_value"]) == 200.0
    assert base["o2"]["total_payment"] is None
    bare = tables.with_(
        payments=tables.payments.where("false"), order_items=tables.order_items.where("false")
    )
    people = by_id(rfm(o.orders_base(bare), SNAPSHOT), "customer_unique_id")
    assert float(people["u1"]["Monetary"]) == 0.0
    assert people["u1"]["Avg_Order_Value"] is None and people["u1"]["Items"] == 0


def test_categories(spark):
    tables = order_tables(spark)
    items = spark.createDataFrame(
        [("o1", 1, "p1", 10.0), ("o1", 2, "p2", 30.0), ("o1", 3, "p3", None), ("o2", 1, "p9", 5.0)],
        "order_id string, order_item_id int, product_id string, price double",
    )
    products = spark.createDataFrame(
        [("p1", "toys"), ("p2", "garden_tools"), ("p3", "books")],
        "product_id string, product_category_name string",
    )
    found = by_id(o.dominant_category(items, products), "order_id")
    assert found["o1"]["product_category"] == "Garden Tools"
    assert found["o2"]["product_category"] == "Nao Informado"
    base = by_id(o.orders_base(tables.with_(order_items=items, products=products)), "order_id")
    assert base["o3"]["product_category"] == "Não informado"
    translation = spark.createDataFrame(
        [("garden_tools", "garden")],
        "product_category_name string, product_category_name_english string",
    )
    names = by_id(o.translated_category(items, products, translation), "order_id")
    assert (names["o1"]["cat"], names["o2"]["cat"]) == ("garden", "desconhecida")


def test_dominant_payment_by_row_and_by_sum(spark):
    payments = spark.createDataFrame(
        [("o1", 1, "card", 50.0), ("o1", 2, "slip", 30.0), ("o1", 3, "slip", 40.0)],
        "order_id string, payment_sequential int, payment_type string, payment_value double",
    )
    assert o.dominant_payment_row(payments).first()["payment_type"] == "card"
    assert o.dominant_payment_sum(payments).first()["payment_type"] == "slip"


def test_cohort(spark):
    rows = [("a", "2018-01-05"), ("a", "2018-01-20"), ("a", "2018-03-01"), ("b", "2018-01-31"),
            ("b", "2019-01-01"), ("c", "2018-02-01")]
    orders = spark.createDataFrame(
        [(c, day(d)) for c, d in rows],
        "customer_unique_id string, order_purchase_timestamp timestamp_ntz",
    )
    grid = {(r["Safra"], r["MesIndice"]): r for r in cohort_retention(orders).collect()}
    assert set(grid) == {("2018-01", 0), ("2018-01", 2), ("2018-01", 12), ("2018-02", 0)}
    assert grid["2018-01", 0]["Clientes_Retidos"] == 2
    assert grid["2018-01", 2]["Pct_Retencao"] == 0.5
