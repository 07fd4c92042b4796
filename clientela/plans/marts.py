"""The batch job: raw tables in, all marts and the cluster model out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from clientela.operators.clusters import (
    clustering_metadata,
    fit_clusters,
    predict_clusters,
    save_model,
)
from clientela.operators.concentration import lorenz_points
from clientela.operators.orders import enrich_orders, orders_base
from clientela.operators.quality import check_customers, check_orders, check_snapshot, latest_review
from clientela.operators.rfm import cohort_retention, rfm
from clientela.operators.segments import (
    assign_cluster_names,
    lifetime_value,
    rfm_scores,
    strategic_segments,
)
from clientela.session import settle
from clientela.sinks.marts import (
    customer_export,
    order_export,
    write_locale_csv,
    write_parquet_mart,
)
from clientela.sources.dimensions import dim_calendar, dim_segments
from clientela.sources.tables import Tables


@dataclass(frozen=True)
class Settings:
    """What the job depends on. The snapshot is fixed, never the latest date of the data."""

    snapshot: str
    export_date: str
    status: str = "delivered"
    score_bins: int = 5
    clusters: int = 4
    seed: int = 42
    restarts: int = 10
    horizon_months: int = 12
    calendar: tuple[str, str] = ("2016-01-01", "2018-12-31")


def build_marts(tables: Tables, settings: Settings, model_folder: str) -> dict[str, DataFrame]:
    """Check the tables, build all marts and store the cluster model.

    The order base and the customer table are computed once and settled, as several marts
    read them.
    """
    check_orders(tables.orders)
    check_customers(tables.customers)
    delivered = tables.orders.where(tables.orders["order_status"] == settings.status)
    check_snapshot(delivered, settings.snapshot)
    # Only what the base needs goes through the deduplication, not the comments.
    needed = {"order_id", "review_id", "review_score", "review_creation_date"}
    reviews = tables.reviews.select([c for c in tables.reviews.columns if c in needed])
    tables = tables.with_(reviews=latest_review(reviews))

    orders = settle(orders_base(tables, settings.status))
    people = settle(rfm(orders, settings.snapshot))
    people = settle(strategic_segments(rfm_scores(people, settings.score_bins)))

    model = fit_clusters(people, settings.clusters, settings.seed, settings.restarts)
    metadata = clustering_metadata(
        people, model, settings.snapshot, settings.export_date, settings.seed, settings.restarts
    )
    save_model(model, metadata, model_folder)
    people = assign_cluster_names(settle(predict_clusters(people, model)))
    people = settle(lifetime_value(people, settings.horizon_months))

    spark = orders.sparkSession
    return {
        "fato_rfm_clientes": customer_export(people, settings.export_date),
        "fato_pedidos": order_export(enrich_orders(orders, people, tables.payments)),
        "fato_cohort": cohort_retention(orders),
        "dim_lorenz": lorenz_points(people, "Monetary"),
        "dim_segmentos": dim_segments(spark),
        "dim_calendario": dim_calendar(spark, *settings.calendar),
    }


SMALL_MARTS = ("fato_cohort", "dim_lorenz", "dim_segmentos", "dim_calendario")


def write_marts(marts: dict[str, DataFrame], folder: str) -> None:
    """Store every mart as Parquet for queries and as locale CSV for spreadsheets."""
    folder = folder.rstrip("/")
    for name, mart in marts.items():
        write_parquet_mart(mart, f"{folder}/parquet", name)
        stored = mart.sparkSession.read.parquet(f"{folder}/parquet/{name}")
        write_locale_csv(stored, f"{folder}/csv/{name}", single_file=name in SMALL_MARTS)
