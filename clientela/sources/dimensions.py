"""Dimension tables that are generated rather than read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the four segments.
CHAMPIONS = "Campeões"
BIG_SPENDERS = "Big Spenders (Não-Recorrentes)"
NEW_OCCASIONAL = "Novos / Ocasionais"
AT_RISK = "Em Risco / Hibernando"

# Name, description, colour, CRM action, priority, colour name.
SEGMENTS = [
    (
        CHAMPIONS,
        "Alta frequência E alto valor — base de elite, recorrência real",
        "#5E6AD2",
        "Programa VIP, ofertas exclusivas, embaixadores da marca",
        1,
        "Iris",
    ),
    (
        BIG_SPENDERS,
        "Alto valor de compra mas sem recorrência — clientes premium 'one-shot'",
        "#BF6FF8",
        "Conversão para recorrência: ofertas categoria-aderentes, upsell pós-venda",
        1,
        "Mauve",
    ),
    (
        NEW_OCCASIONAL,
        "Compra única recente, valor baixo — maior parte da base",
        "#F2C94C",
        "Incentivo à segunda compra: cupom 'volte logo', cross-sell, onboarding",
        3,
        "Gold",
    ),
    (
        AT_RISK,
        "Recência alta, sem comprar há muito — alto risco de churn",
        "#E5484D",
        "Win-back urgente: e-mail de reativação, desconto agressivo, pesquisa de churn",
        2,
        "Radish",
    ),
]


def dim_segments(spark: SparkSession) -> DataFrame:
    """One row per business segment."""
    return spark.createDataFrame(
        SEGMENTS,
        "Cluster_Name string, Descricao string, Cor_Hex string, Acao_CRM string, "
        "Prioridade int, Cor_Power_BI string",
    )


def calendar_columns(days: DataFrame, day: str) -> DataFrame:
    """Calendar attributes of a date column, one output row per input row."""
    d = F.col(day)
    return days.select(
        F.date_format(d, "yyyy-MM-dd").alias("Data"),
        F.year(d).cast("smallint").alias("Ano"),
        F.month(d).cast("tinyint").alias("Mes"),
        F.day(d).cast("tinyint").alias("Dia"),
        F.quarter(d).cast("tinyint").alias("Trimestre"),
        F.date_format(d, "yyyy-MM").alias("AnoMes"),
        F.date_format(d, "MMMM").alias("NomeMes"),
        F.date_format(d, "EEEE").alias("DiaSemana"),
        (F.weekday(d) + 1).cast("tinyint").alias("NumDiaSemana"),
        (F.weekday(d) >= 5).alias("FimDeSemana"),
    )


def dim_calendar(
    spark: SparkSession, start: str = "2016-01-01", end: str = "2018-12-31"
) -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    span = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return calendar_columns(span, "day")


def calendar_of(df: DataFrame, ts: str) -> DataFrame:
    """Calendar from the first to the last day that occurs in ``df``."""
    span = df.agg(F.min(ts).cast("date").alias("first"), F.max(ts).cast("date").alias("last"))
    days = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("day")
    )
    return calendar_columns(days, "day")
