"""Tests of differences between groups.

Each test reduces the table to a few sums per group, for any number of groups; statistics and
tail probabilities are columns of the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.tails import (
    chi2_tail,
    f_tail,
    studentized_range_quantile,
    studentized_range_tail,
)
from clientela.operators.distributions import long_form
from clientela.operators.ordering import ranked_values
from clientela.shipping import ship


def group_moments(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Size, mean and sum of squared deviations per metric and group."""
    return (
        long_form(df.where(F.col(group).isNotNull()), columns, [group])
        .where(F.col("value").isNotNull())
        .groupBy("metric", group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            (F.var_pop("value") * F.count(F.lit(1))).alias("ss"),
        )
    )


def variance_parts(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Variation between and within groups, per metric: one row per metric."""
    moments = group_moments(df, group, columns)
    per_metric = Window.partitionBy("metric")  # a few rows: one per group
    n_all = F.sum("n").over(per_metric)
    grand = F.sum(F.col("n") * F.col("mean")).over(per_metric) / n_all
    return (
        moments.withColumns({"n_all": n_all, "grand": grand})
        .groupBy("metric")
        .agg(
            F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"),
            F.sum("ss").alias("ss_within"),
            (F.count(F.lit(1)) - 1).alias("df_between"),
            (F.max("n_all") - F.count(F.lit(1))).alias("df_within"),
        )
    )


def anova_statistic(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """One-way analysis of variance: F and its degrees of freedom per metric."""
    parts = variance_parts(df, group, columns)
    f = F.try_divide(
        F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")
    )
    return parts.select("metric", f.alias("f_stat"), "df_between", "df_within")


def anova(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Analysis of variance with p-values."""
    p = f_tail(F.col("f_stat"), F.col("df_between"), F.col("df_within"))
    return anova_statistic(df, group, columns).withColumn("p_value", p)


def kruskal_statistic(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Kruskal–Wallis H, corrected for ties, and its degrees of freedom per metric.

    Ranks belong to distinct values; the rows of a group are counted per value, so a group's
    rank sum is over its values.
    """
    long = long_form(df.where(F.col(group).isNotNull()), columns, [group])
    ranked = ranked_values(long, "value", by=["metric"])
    doubled = (2 * F.col("upto") - F.col("n") + 1).cast("decimal(20,0)")
    ranks = ranked.select("metric", "value", doubled.alias("twice_rank"))
    counts = (
        long.where(F.col("value").isNotNull())
        .groupBy("metric", "value", group)
        .agg(F.count(F.lit(1)).alias("k"))
    )
    sums = (
        counts.join(ranks, ["metric", "value"])
        .groupBy("metric", group)
        .agg(
            F.sum((F.col("twice_rank") * F.col("k").cast("decimal(18,0)")).cast("decimal(38,0)"))
            .cast("double").alias("r"),
            F.sum("k").cast("double").alias("k"),
        )
        .groupBy("metric")
        .agg(F.sum((F.col("r") / 2) * (F.col("r") / 2) / F.col("k")).alias("spread"),
             F.count(F.lit(1)).alias("groups"))
    )
    n = F.col("n").cast("double")
    whole = ranked.groupBy("metric").agg(
        F.max("upto_total").cast("double").alias("size"), F.sum(n * n * n - n).alias("ties")
    )
    size = F.col("size")
    h = 12.0 / (size * (size + 1)) * F.col("spread") - 3 * (size + 1)
    correction = 1 - F.try_divide(F.col("ties"), size * size * size - size)
    return whole.join(sums, "metric").select(
        "metric", F.try_divide(h, correction).alias("h_stat"), (F.col("groups") - 1).alias("df")
    )


def kruskal(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Kruskal–Wallis test with p-values."""
    p = chi2_tail(F.col("h_stat"), F.col("df"))
    return kruskal_statistic(df, group, columns).withColumn("p_value", p)


def tukey(
    df: DataFrame, group: str, columns: Sequence[str], alpha: float = 0.05
) -> DataFrame:
    """Tukey's pairwise comparison of group means: one row per metric and pair."""
    ship(df.sparkSession)
    moments = group_moments(df, group, columns)
    whole = moments.groupBy("metric").agg(
        F.count(F.lit(1)).alias("groups"),
        (F.sum("n") - F.count(F.lit(1))).alias("free"),
        F.sum("ss").alias("within"),
    )
    critical = studentized_range_quantile(alpha)(F.col("groups"), F.col("free"))
    per_metric = whole.select(
        "metric", "groups", "free",
        F.try_divide("within", "free").alias("mse"),
        critical.alias("critical"),
    )
    first, second = (
        moments.select(
            "metric", F.col(group).alias(f"group{i}"), F.col("n").alias(f"n{i}"),
            F.col("mean").alias(f"mean{i}"),
        )
        for i in (1, 2)
    )
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    pairs = (
        first.join(second, "metric")
        .where(F.col("group1") < F.col("group2"))
        .join(F.broadcast(per_metric), "metric")  # one row per metric
        .withColumn("meandiff", F.col("mean2") - F.col("mean1"))
        .withColumn("error", F.when(error > 0, error))
    )
    tail = studentized_range_tail()(F.abs("meandiff") / F.col("error"), F.col("groups"), F.col("free"))
    half = F.col("critical") * F.coalesce("error", F.lit(0.0))
    return pairs.withColumn("p_adj", F.nanvl(tail, F.lit(None).cast("double"))).select(
        "metric",
        F.col("group1").cast("string").alias("group1"),
        F.col("group2").cast("string").alias("group2"),
        "meandiff",
        "p_adj",
        (F.col("meandiff") - half).alias("lower"),
        (F.col("meandiff") + half).alias("upper"),
        (F.abs("meandiff") > half).alias("reject"),
    )


def chi_square_statistic(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square of independence from the pair counts: statistic and degrees of freedom.

    Only pairs that occur are needed: the sum of (O−E)²/E over all cells equals N·(Σ O²/(R·C) − 1).
    A 2×2 table gets the continuity correction.
    """
    present = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    counts = present.groupBy(rows, columns).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    margins = counts.select(
        rows,
        columns,
        "_o",
        F.sum("_o").over(Window.partitionBy(rows)).alias("_r"),
        F.sum("_o").over(Window.partitionBy(columns)).alias("_c"),
    )
    total = F.sum("_o")
    # Σ over rows of 1/R: each row's 1/R is spread over its cells in proportion O/R.
    inverse_rows = F.sum(F.col("_o") / F.col("_r") / F.col("_r"))
    inverse_columns = F.sum(F.col("_o") / F.col("_c") / F.col("_c"))
    summary = margins.agg(
        total.alias("n"),
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("q"),
        F.count_distinct(rows).alias("n_rows"),
        F.count_distinct(columns).alias("n_columns"),
        inverse_rows.alias("ir"),
        inverse_columns.alias("ic"),
        F.max_by(F.struct("_o", "_r", "_c"), "_o").alias("cell"),
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_columns") - 1)
    off = F.abs(F.col("cell._o") - F.col("cell._r") * F.col("cell._c") / F.col("n"))
    corrected = (off - F.least(F.lit(0.5), off)) ** 2 * F.col("n") * F.col("ir") * F.col("ic")
    plain = F.col("n") * (F.col("q") - 1)
    return summary.select(
        F.when(dof == 1, corrected).otherwise(plain).alias("chi2"), dof.alias("df")
    )


def chi_square(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square test of independence with p-value."""
    p = chi2_tail(F.col("chi2"), F.col("df"))
    found = chi_square_statistic(df, rows, columns)
    return found.withColumn("p_value", F.when(F.col("df") == 0, F.lit(1.0)).otherwise(p))
