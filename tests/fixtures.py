"""Small literal tables."""

from datetime import datetime

from clientela.sources.tables import Tables


def day(text):
    return datetime.fromisoformat(text) if text else None


def order_tables(spark) -> Tables:
    orders = spark.createDataFrame(
        [
            ("o1", "c1", "delivered", day("2018-01-01")),
            ("o2", "c2", "delivered", day("2018-03-15")),
            ("o3", "c1", "delivered", day("2018-06-01")),
            ("o4", "c3", "canceled", day("2018-07-01")),
        ],
        "order_id string, customer_id string, order_status string, "
        "order_purchase_timestamp timestamp_ntz",
    )
    customers = spark.createDataFrame(
        [("c1", "u1", "SP"), ("c2", "u2", "RJ"), ("c3", "u3", "MG")],
        "customer_id string, customer_unique_id string, customer_state string",
    )
    items = spark.createDataFrame(
        [("o1", 1, "p1", "s1", 100.0), ("o2", 1, "p2", "s1", 200.0), ("o3", 1, "p3", "s2", 150.0)],
        "order_id string, order_item_id int, product_id string, seller_id string, price double",
    )
    payments = spark.createDataFrame(
        [("o1", 1, "card", 110.0), ("o2", 1, "card", 210.0), ("o3", 1, "slip", 160.0)],
        "order_id string, payment_sequential int, payment_type string, payment_value double",
    )
    reviews = spark.createDataFrame(
        [("o1", 5, day("2018-01-10")), ("o2", 4, day("2018-03-20")), ("o3", 5, day("2018-06-10"))],
        "order_id string, review_score int, review_creation_date timestamp_ntz",
    )
    return Tables(orders, customers, items, payments, reviews)


def customers_frame(spark, rows):
    """Rows of (id, recency, frequency, value)."""
    return spark.createDataFrame(
        [(i, r, f, float(m), float(m) / f) for i, r, f, m in rows],
        "customer_unique_id string, Recency int, Frequency int, Monetary double, "
        "Avg_Order_Value double",
    )


def many_customers(spark, n=60, seed=42):
    import numpy as np

    rng = np.random.default_rng(seed)
    return customers_frame(
        spark,
        [
            (f"u{i:04d}", int(i * 7 % (n * 3)), int(rng.integers(1, 6)),
             round(float(rng.uniform(10, 900)), 2))
            for i in range(n)
        ],
    )
