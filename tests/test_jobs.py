"""The batch plans on small tables, and the registered queries against SQL."""

import os
import warnings

import pytest

import __spark_entry__ as entry
from clientela.plans.marts import Settings, build_marts, write_marts
from clientela.plans.models import score_review_risk, train_review_model
from clientela.learning.models import review_candidates
from clientela.sources.marts import read_locale_csv, register_marts
from clientela.sources.star_schema import SNAPSHOT, STATUS, model_tables
from tests.compare import connect, differences

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, connection, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = entry.queries()[name](spark, FOLDER)
    assert differences(found, connection, SQL[name]) == []


def test_entry(spark):
    flagship = entry.entry(spark)
    assert "Monetary" in flagship.columns and flagship.count() > 0
    assert set(SQL) <= set(entry.queries())


def test_build_and_write_marts(spark, tmp_path):
    tables = model_tables(spark, FOLDER)
    settings = Settings(SNAPSHOT, "2001-09-02", STATUS, restarts=1, calendar=("2001-01-01", "2001-12-31"))
    marts = build_marts(tables, settings, str(tmp_path / "model"))
    write_marts(marts, str(tmp_path))
    names = register_marts(spark, str(tmp_path / "parquet"))
    assert len(names) == 4
    people = spark.table("fato_rfm_clientes")
    assert people.select("Cluster_Name").distinct().count() == 4
    assert spark.table("dim_calendario").count() == 365
    assert spark.table("fato_pedidos").where("Cluster_Name = 'nan'").isEmpty()
    back = read_locale_csv(spark, str(tmp_path / "csv" / "fato_rfm_clientes"), {"Monetary": "double"})
    assert back.columns == people.columns and back.count() == people.count()


def test_train_and_score(spark, tmp_path):
    tables = model_tables(spark, FOLDER, with_delivery=True)
    family = [c for c in review_candidates() if c.name in ("baseline", "logistic")]
    report = train_review_model(tables, str(tmp_path), STATUS, family)
    assert report["best_model"] == "logistic"
    states = score_review_risk(tables, str(tmp_path), STATUS)
    assert states.agg({"Pedidos": "sum"}).first()[0] == report["n_samples"]
