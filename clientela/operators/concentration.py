"""Concentration of revenue: Gini, Lorenz curves and top shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.scalars import half_even, money
from clientela.operators.ordering import ranked_values, with_rank


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient as one row; 0 without rows or without value."""
    ranked = ranked_values(df, money(value))
    n, x = F.col("n"), F.col("value")
    before = F.col("upto") - n
    # Ranks before+1 … upto carry the same value; their sum has a closed form.
    rank_sum = (n * before + (n * (n + 1) / 2)).cast("decimal(28,0)")
    sums = ranked.agg(
        F.max("upto_total").cast("double").alias("n"),
        F.sum((rank_sum * x).cast("decimal(38,2)")).cast("double").alias("weighted"),
        F.sum((x * n).cast("decimal(38,2)")).cast("double").alias("total"),
    )
    value_ = 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return sums.select(
        F.when(F.coalesce(F.col("total"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(value_).alias("gini")
    )


def lorenz_curve(df: DataFrame, value: str, id_column: str) -> DataFrame:
    """Ascending curve in percent, one point per row."""
    present = df.where(F.col(value).isNotNull()).select(id_column, value)
    ranked = with_rank(present, [F.col(value), F.col(id_column)], "ordem", cum=money(value))
    return ranked.select(
        "ordem",
        (F.col("ordem") / F.col("ordem_total") * 100).alias("cumulative_customers_pct"),
        (
            F.try_divide(F.col("cum").cast("double"), F.col("cum_total").cast("double")) * 100
        ).alias("cumulative_monetary_pct"),
    )


def pareto_table(df: DataFrame, value: str, id_column: str) -> DataFrame:
    """Descending table: running value, share of value and share of rows, per row."""
    present = df.where(F.col(value).isNotNull()).select(id_column, value)
    ranked = with_rank(present, [F.col(value).desc(), F.col(id_column)], "ordem", cum=money(value))
    return ranked.select(
        id_column,
        value,
        "ordem",
        F.col("cum").alias("Receita_Acumulada"),
        F.try_divide(F.col("cum").cast("double"), F.col("cum_total").cast("double")).alias(
            "Pct_Receita_Acumulada"
        ),
        (F.col("ordem") / F.col("ordem_total")).alias("Pct_Clientes_Acumulada"),
    )


def lorenz_points(df: DataFrame, value: str, n_points: int = 200) -> DataFrame:
    """Descending concentration curve: the origin and up to ``n_points`` evenly spaced ranks.

    Works on distinct values, so that equal values need no order among themselves.
    """
    spark = df.sparkSession
    shape = "ordem int, pct_clientes double, pct_receita double"
    ranked = ranked_values(df, money(value), descending=True, cum=money(value))
    size = ranked.agg(
        F.max("upto_total").alias("n"), F.max("cum_upto_total").cast("double").alias("total")
    ).first()
    if not size["n"] or not size["total"]:
        return spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], shape)
    n, total = size["n"], size["total"]
    # From the first rank to the last in equal steps, cut down to whole ranks.
    steps = max(n_points - 1, 1)
    ranks = sorted({1 + i * (n - 1) // steps for i in range(n_points)})
    wanted = F.filter(
        F.array(*[F.lit(k).cast("bigint") for k in ranks]),
        lambda k: (k > F.col("upto") - F.col("n")) & (k <= F.col("upto")),
    )
    points = ranked.select("*", F.explode(wanted).alias("k")).select(
        half_even(F.col("k") / F.lit(n), 5).alias("pct_clientes"),
        half_even(
            (
                F.col("cum_upto") - F.col("value") * (F.col("upto") - F.col("k"))
            ).cast("double") / F.lit(total),
            5,
        ).alias("pct_receita"),
        "k",
    )
    origin = spark.createDataFrame([(0.0, 0.0, 0)], "pct_clientes double, pct_receita double, k bigint")
    # At most n_points + 1 rows from here on: one window over them is cheap.
    once = origin.unionByName(points).groupBy("pct_clientes").agg(
        F.min_by("pct_receita", "k").alias("pct_receita"), F.min("k").alias("k")
    )
    order = Window.orderBy("k")
    return once.select(
        (F.row_number().over(order) - 1).cast("int").alias("ordem"), "pct_clientes", "pct_receita"
    ).orderBy("ordem")


def nearest_point(curve: DataFrame, share: float = 0.2) -> DataFrame:
    """The point of a curve closest to a share of customers."""
    return curve.orderBy(F.abs(F.col("pct_clientes") - F.lit(share)), "ordem").limit(1)


def _top_sum(ranked: DataFrame, k: Column) -> DataFrame:
    """Value held by the first ``k`` rows in descending order, from distinct values."""
    before = F.col("upto") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - before))
    return ranked.agg(
        F.sum((F.col("value") * taken).cast("decimal(38,2)")).alias("receita_top"),
        F.sum((F.col("value") * F.col("n")).cast("decimal(38,2)")).alias("receita_total"),
        F.max("upto_total").alias("n_clientes"),
        F.sum(taken).alias("n_top"),
    )


def top_share(df: DataFrame, value: str, share: float = 0.2) -> DataFrame:
    """Share of the value held by the first floor(n·share) rows."""
    ranked = ranked_values(df, money(value), descending=True)
    k = F.floor(F.col("upto_total") * F.lit(share)).cast("bigint")
    return _top_sum(ranked, k).select(
        F.lit(share).alias("top_pct_clientes"),
        F.col("n_top").alias("n_clientes_no_top"),
        F.col("receita_top").cast("double").alias("receita_no_top"),
        F.col("receita_total").cast("double").alias("receita_total"),
        half_even(
            F.try_divide(F.col("receita_top").cast("double"), F.col("receita_total").cast("double")),
            4,
        ).alias("pct_receita_concentrada"),
    )


def top_share_with_ties(df: DataFrame, value: str, share: float = 0.2) -> DataFrame:
    """Like :func:`top_share`, but every row tied with the last one taken counts as well."""
    ranked = ranked_values(df, money(value), descending=True)
    k = F.floor(F.col("upto_total") * F.lit(share)).cast("bigint")
    taken = (F.col("upto") - F.col("n")) < k
    worth = (F.col("value") * F.col("n")).cast("decimal(38,2)")
    return ranked.agg(
        F.sum(F.when(taken, worth)).cast("double").alias("receita_top"),
        F.sum(worth).cast("double").alias("receita_total"),
    ).withColumn("pct_concentracao", F.try_divide("receita_top", "receita_total"))
