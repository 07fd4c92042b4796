"""Distribution tables: counts per value or band, quantiles, histograms, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.scalars import banded
from clientela.operators.ordering import quantiles, ranked_values, sample_rows
from clientela.operators.segments import quantile_bins

# Recency bands and names of the value quintiles.
RECENCY_BANDS = ["0-30", "31-90", "91-180", "181-365", "365+"]
RECENCY_BAND_ENDS = [30, 90, 180, 365]
VALUE_BANDS = ["Muito Baixo", "Baixo", "Médio", "Alto", "Muito Alto"]


def _with_share(counts: DataFrame, n: str) -> DataFrame:
    return counts.withColumn("Pct_Clientes", F.col(n) / F.sum(n).over(Window.partitionBy()))


def value_distribution(df: DataFrame, value: str) -> DataFrame:
    """Rows per value, in value order, with share and running share."""
    return ranked_values(df, value).select(
        F.col("value").alias(value),
        F.col("n").alias("Qtd_Clientes"),
        (F.col("n") / F.col("upto_total")).alias("Pct_Clientes"),
        (F.col("upto") / F.col("upto_total")).alias("Pct_Acumulado"),
    )


def threshold_summary(df: DataFrame, value: str = "Frequency") -> DataFrame:
    """Customers with one, two or more, three or more purchases (overlapping groups)."""
    v = F.col(value)
    groups = [("1 compra", v == 1), ("2+ compras", v >= 2), ("3+ compras", v >= 3)]
    counts = df.agg(
        F.count(F.lit(1)).alias("all"),
        *[F.count_if(c).alias(f"g{i}") for i, (_, c) in enumerate(groups)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("Grupo"), F.col(f"g{i}").alias("Qtd_Clientes"))
            for i, (n, _) in enumerate(groups)
        ]
    )
    return counts.select("all", F.explode(rows).alias("r")).select(
        "r.*", F.try_divide(F.col("r.Qtd_Clientes"), F.col("all")).alias("Pct_Clientes")
    )


def recency_bands(df: DataFrame, value: str = "Recency") -> DataFrame:
    """Customers per recency band."""
    band = banded(value, RECENCY_BAND_ENDS, RECENCY_BANDS)
    counts = (
        df.where(F.col(value) >= 0)
        .groupBy(band.alias("Faixa_Recency"))
        .agg(F.count(F.lit(1)).alias("Qtd_Clientes"))
    )
    return _with_share(counts, "Qtd_Clientes")


def recency_bands_of_repeaters(df: DataFrame) -> DataFrame:
    """Recency bands of customers with several orders. Day 0 lies below the first band."""
    return recency_bands(df.where((F.col("Frequency") > 1) & (F.col("Recency") > 0)))


def value_quintiles(df: DataFrame, value: str = "Monetary") -> DataFrame:
    """Customers per value quintile."""
    binned = quantile_bins(df, value, len(VALUE_BANDS), VALUE_BANDS, "Faixa_Monetary")
    counts = (
        binned.where(F.col("Faixa_Monetary").isNotNull())
        .groupBy("Faixa_Monetary")
        .agg(F.count(F.lit(1)).alias("Qtd_Clientes"))
    )
    return _with_share(counts, "Qtd_Clientes")


def crosstab(df: DataFrame, rows: str, columns: str, names: Sequence | None = None) -> DataFrame:
    """Counts per pair of values, one column per value of ``columns``, 0 where none."""
    present = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    pivot = present.groupBy(rows).pivot(columns, list(names) if names else None)
    return pivot.agg(F.count(F.lit(1))).na.fill(0)


def share_pivot(mix: DataFrame, rows: str, columns: str, share: str) -> DataFrame:
    """Shares as one column per value of ``columns``, 0 where none."""
    return mix.groupBy(rows).pivot(columns).agg(F.sum(share)).na.fill(0.0)


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per metric and value, so that several columns share one pass."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "metric", "value"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, median, sample deviation, extremes, p25, p75, p95, adjusted skewness."""
    long = long_form(df, columns)
    n = F.col("count")
    moments = long.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("g1"),
    )
    adjusted = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1.0)) / (n - 2))
    places = quantiles(
        long, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}, by=["metric"]
    )
    return (
        moments.withColumn("skew", adjusted)
        .join(places, "metric", "left")
        .select(
            "metric", "count", "mean", "median", "std", "min", "p25", "p75", "p95", "max", "skew"
        )
    )


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    return quantiles(
        df.where(F.col(by).isNotNull()),
        value,
        {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0},
        by=[by],
        n=F.sum("n"),
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, upper fence, and the larger of the fence and p95."""
    places = quantiles(
        long_form(df, columns), "value", {"q1": 0.25, "q3": 0.75, "p95": 0.95}, by=["metric"]
    )
    fence = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return places.select(
        "metric",
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        fence.alias("upper_fence"),
        F.greatest(fence, F.col("p95")).alias("plot_limit"),
    )


def without_outliers(df: DataFrame, value: str, cap: float = 0.99) -> DataFrame:
    """Rows whose value does not exceed the ``cap`` quantile."""
    limit = quantiles(df, value, {"cap": cap}).first()["cap"]
    return df.where(F.col(value).cast("double") <= F.lit(limit))


def histogram(df: DataFrame, value: Column | str, bins: int) -> DataFrame:
    """Counts in ``bins`` intervals of equal width; the last one includes its upper end."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = df.select(v.alias("v")).where("v IS NOT NULL")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int")
    counts = values.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def regression_line(
    df: DataFrame, x: str, y: Column, id_column: str | None = None, sample: int | None = None
) -> DataFrame:
    """Least-squares line of ``y`` on ``x``, over all rows or a repeatable sample."""
    if sample is not None:
        df = sample_rows(df, id_column, sample)
    xv = F.col(x).cast("double")
    return df.agg(
        F.regr_slope(y, xv).alias("slope"),
        F.regr_intercept(y, xv).alias("intercept"),
        F.regr_r2(y, xv).alias("r2"),
    ).select(F.lit(x).alias("x"), "*")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, one row per column, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]
    )

    def cell(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0)
        return F.col(f"`{a}|{b}`") if (a, b) in pairs else F.col(f"`{b}|{a}`")

    rows = [
        F.struct(F.lit(a).alias("metric"), *[cell(a, b).alias(b) for b in columns])
        for a in columns
    ]
    return r.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def full_profile(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Size, mean and median recency, frequency and value, mean order value and review."""
    known = df.where(F.col(cluster).isNotNull())
    means = {"AOV_mean": "Avg_Order_Value", "Review_mean": "Avg_Review"}
    columns = ["Recency", "Frequency", "Monetary"]
    profile = known.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("Qtd_Clientes"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in columns],
        *[F.avg(c).alias(n) for n, c in means.items() if c in df.columns],
    )
    long = long_form(known, columns, [cluster])
    medians = quantiles(long, "value", {"median": 0.5}, by=[cluster, "metric"])
    wide = medians.groupBy(cluster).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"{c}_median") for c in columns]
    )
    return profile.join(wide, cluster)


def min_max(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns of a profile (one row per cluster) to 0…1."""
    everything = Window.partitionBy()
    scaled = {}
    for c in columns:
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        scaled[c] = (F.col(c) - low) / (high - low + 1e-9)
    return profile.withColumns(scaled)


def rank_score(profile: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Ranks of a profile (one row per cluster) and their sum; equal means share a mean rank.

    Low recency is good, high frequency and value are good.
    """
    ranks = {}
    for name, column, order in (
        ("R_rank", "R_mean", F.col("R_mean").asc()),
        ("F_rank", "F_mean", F.col("F_mean").desc()),
        ("M_rank", "M_mean", F.col("M_mean").desc()),
    ):
        tied = F.count(F.lit(1)).over(Window.partitionBy(column))
        ranks[name] = F.rank().over(Window.orderBy(order)) + (tied - 1) / 2
    return profile.withColumns(ranks).select(
        cluster, *ranks, (F.col("R_rank") + F.col("F_rank") + F.col("M_rank")).alias("Score")
    )
