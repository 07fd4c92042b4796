import os
import tempfile
import warnings

import pytest
from pyspark.sql import functions as F

from clientela.session import release, scratch_root, settle
from clientela.sinks.marts import (
    customer_export,
    order_export,
    write_locale_csv,
    write_parquet_mart,
)
from clientela.sources.dimensions import dim_calendar, dim_segments
from clientela.sources.marts import read_locale_csv, register_marts
from clientela.sources.tables import load_tables
from tests.fixtures import many_customers

RAW = {
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,extra\n"
    "o1,c1,delivered,2018-01-01 10:00:00,x\n",
    "customers": "customer_id,customer_unique_id,customer_state\nc1,u1,SP\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,price,freight_value\n"
    "o1,1,p1,s1,100.50,10.0\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,card,2,110.5\n",
    "reviews": "review_id,order_id,review_score,comment,review_creation_date\n"
    'r1,o1,5,"two\nlines, ""quoted""",2018-01-10 00:00:00\n',
    "products": "product_id,product_category_name\np1,garden_tools\n",
}


def write_raw(folder, leave_out=()):
    for name, text in RAW.items():
        if name not in leave_out:
            (folder / f"{name}.csv").write_text(text, encoding="utf-8")


def test_load_tables(spark, tmp_path):
    write_raw(tmp_path)
    with pytest.warns(UserWarning, match="category_translation"):
        tables = load_tables(spark, str(tmp_path))
    assert tables.category_translation is None
    assert tables.products.count() == 1
    assert dict(tables.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert "extra" in tables.orders.columns
    review = tables.reviews.first()
    assert review["review_score"] == 5 and "two\nlines" in review["comment"]
    assert float(tables.order_items.first()["price"]) == 100.5


def test_missing_required_table(spark, tmp_path):
    write_raw(tmp_path, leave_out=("payments",))
    with pytest.raises(FileNotFoundError):
        load_tables(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        load_tables(spark, str(tmp_path / "nowhere"))


def test_values_that_do_not_parse_become_null(spark, tmp_path):
    write_raw(tmp_path)
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp\no1,c1,delivered,soon\n"
    )
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tables = load_tables(spark, str(tmp_path))
    assert tables.orders.first()["order_purchase_timestamp"] is None


def test_locale_csv_format_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "out" / "mart")
    df = spark.createDataFrame([(1.5, "x;ç", None), (0.00001, "y", 3)], "a double, b string, c int")
    write_locale_csv(df, path, single_file=True)
    (part,) = [f for f in os.listdir(path) if f.endswith(".csv")]
    raw = open(os.path.join(path, part), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfa;b;c")
    assert b"1,5" in raw
    back = read_locale_csv(spark, path, {"a": "double", "c": "int"})
    assert back.columns == ["a", "b", "c"]
    assert {(r["a"], r["b"], r["c"]) for r in back.collect()} == {(1.5, "x;ç", None), (1e-5, "y", 3)}


def test_customer_export(spark):
    people = many_customers(spark, 5).withColumns(
        {"R_score": F.lit("5"), "RFM_segment": F.lit("Lost"), "Cluster": F.lit(2),
         "Cluster_Name": F.lit(None).cast("string"), "Monetary": F.lit(100.123)}
    )
    mart = customer_export(people, "2020-02-03")
    types = dict(mart.dtypes)
    assert types["Recency"] == "int" and types["Frequency"] == "smallint"
    assert types["Monetary"] == "float" and types["R_score"] == "tinyint"
    row = mart.first()
    assert row["Monetary"] == pytest.approx(100.12, abs=1e-4)
    assert row["Cluster_Name"] == "nan"
    assert (row["dt_exportacao"], row["versao_modelo"]) == ("2020-02-03", "v1.0")


def test_order_export_with_few_columns(spark):
    orders = spark.sql(
        "SELECT 'o1' AS order_id, 'u1' AS customer_unique_id, 10.126D AS total_payment, "
        "TIMESTAMP_NTZ '2018-01-02 23:59:00' AS order_purchase_timestamp"
    )
    row = order_export(orders).first()
    assert row["order_purchase_timestamp"] == "2018-01-02"
    assert row["total_payment"] == pytest.approx(10.13, abs=1e-5)


def test_calendar(spark):
    january = dim_calendar(spark, "2018-01-01", "2018-01-31")
    rows = {r["Data"]: r for r in january.collect()}
    assert len(rows) == 31
    assert dict(january.dtypes)["FimDeSemana"] == "boolean"
    saturday = rows["2018-01-06"]
    assert saturday["FimDeSemana"] and saturday["NumDiaSemana"] == 6
    assert (saturday["DiaSemana"], saturday["NomeMes"]) == ("Saturday", "January")
    assert all(r["Ano"] == 2018 and r["AnoMes"] == "2018-01" for r in rows.values())


def test_segments_dimension(spark):
    rows = dim_segments(spark).collect()
    assert len({r["Cluster_Name"] for r in rows}) == 4
    assert all(r["Cor_Hex"].startswith("#") for r in rows)


def test_parquet_marts(spark, tmp_path):
    write_parquet_mart(many_customers(spark, 4), str(tmp_path), "fato_rfm_clientes")
    with pytest.warns(UserWarning, match="fato_pedidos"):
        names = register_marts(spark, str(tmp_path), ["fato_rfm_clientes", "fato_pedidos"])
    assert names == ["fato_rfm_clientes"]
    assert spark.table("fato_rfm_clientes").count() == 4


def test_tables_are_freed_when_the_work_is_done(spark):
    import os
    from multiprocessing.pool import ThreadPool

    from clientela.session import freed, settle_alone

    def path(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    kept = settle(spark.range(3))
    with freed(spark):
        inner = path(settle(spark.range(5)))
        alone = settle_alone(spark, lambda: settle(spark.range(7)).where("id > 2"))
        assert alone.count() == 4 and os.path.isdir(inner)
        within = path(alone)
    assert not os.path.exists(inner) and not os.path.exists(within) and kept.count() == 3

    def work(n):  # blocks of one thread leave the tables of the others alone
        with freed(spark):
            table = settle(spark.range(n))
            return sum(settle(table.where(f"id < {k}")).count() for k in range(3))

    with ThreadPool(4) as pool:
        assert pool.map(work, [5] * 8) == [3] * 8


def test_release_deletes_settled_tables(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clientela-test-"))
    settle(spark.range(3))
    root = scratch_root(spark).split(":", 1)[-1]
    assert os.listdir(root)
    release(spark)
    assert not os.path.exists(root)
    assert settle(spark.range(4)).count() == 4
