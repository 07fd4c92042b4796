"""Scores, rule-based segments, lifetime value and business names of clusters."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.functions.scalars import banded, half_even, money
from clientela.operators.ordering import after, keys_at_ranks, quantiles, running_totals
from clientela.operators.quality import check_columns
from clientela.sources.dimensions import AT_RISK, BIG_SPENDERS, CHAMPIONS, NEW_OCCASIONAL

# Cut-offs of the revenue and recency segments, and the history in months.
REVENUE_CUTS = [0.05, 0.15, 0.35]
REVENUE_LABELS = ["Elite (Top 5%)", "High Value (Next 10%)", "Mid Value (Next 20%)", "Base"]
RECENCY_CUTS = [30, 90, 180]
RECENCY_LABELS = ["Ativo", "Recente", "Morno", "Em Risco"]
HISTORY_MONTHS = 24


def quantile_edges(df: DataFrame, value: str, q: int, duplicates: str = "raise") -> list[float]:
    """The q − 1 inner edges of ``q`` equally filled bins, preceded and followed by min and max.

    Equal edges leave fewer bins than labels: an error, unless ``duplicates="merge"``.
    """
    row = quantiles(df, value, {f"e{i}": i / q for i in range(q + 1)}).first()
    edges = [row[f"e{i}"] for i in range(q + 1)]
    distinct = sorted(set(edges))
    if len(distinct) < len(edges):
        if duplicates != "merge":
            raise ValueError(f"bin edges of {value} are not unique: {edges}")
        return distinct
    return edges


def quantile_label(value: str, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed bins between ``edges``, the lowest value included; null stays null."""
    inner = list(edges[1:-1])
    labels = list(labels or range(1, len(edges)))
    v = F.col(value).cast("double")
    label = banded(v, inner, labels[: len(inner) + 1]) if inner else F.lit(labels[0])
    return F.when(v.isNotNull(), label)


def quantile_bins(
    df: DataFrame,
    value: str,
    q: int,
    labels: Sequence | None = None,
    name: str = "bin",
    duplicates: str = "raise",
) -> DataFrame:
    """Bins with right-closed quantile edges, the lowest value included."""
    edges = quantile_edges(df, value, q, duplicates)
    return df.withColumn(name, quantile_label(value, edges, labels))


def rank_label(df: DataFrame, value: str, id_column: str, q: int) -> Column:
    """``q`` bins of equal size by rank, 1…q; equal values are ordered by id.

    Bin b ends at rank floor(b·(n−1)/q)+1. Only those q−1 boundary keys are looked up; rows
    are then labelled where they are, without a shuffle.
    """
    order = {"value": F.col(value), "id": F.col(id_column)}
    types = {
        "value": df.schema[value].dataType.simpleString(),
        "id": df.schema[id_column].dataType.simpleString(),
    }
    ranks = {str(b): F.floor(F.lit(b) * (F.col("size") - 1) / q) + 1 for b in range(1, q)}
    present = df.where(F.col(value).isNotNull())
    label = F.lit(1)
    for cut in keys_at_ranks(present, order, ranks):
        label = label + after(order, cut, types).cast("int")
    return F.when(F.col(value).isNotNull(), label)


def rank_bins(df: DataFrame, value: str, id_column: str, q: int, name: str = "bin") -> DataFrame:
    return df.withColumn(name, rank_label(df, value, id_column, q))


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Classic segment from the three scores; the first rule that holds decides."""
    # Segment names and their score limits, in order.
    rules = [
        ("Champions", (r >= 4) & (f >= 4) & (m >= 4)),
        ("Loyal Customers", (r >= 4) & (f >= 3) & (m >= 3)),
        ("Big Spenders (New/Occasional)", (r >= 4) & (m >= 4) & (f <= 3)),
        ("New Customers", (r == 5) & (f <= 2)),
        ("Potential Loyalists", (r >= 3) & (f <= 2) & (m <= 2)),
        ("At Risk", (r <= 2) & ((f >= 4) | (m >= 4))),
        ("Lost", (r == 1) & (f == 1) & (m == 1)),
    ]
    name, holds = rules[0]
    chain = F.when(holds, name)
    for name, holds in rules[1:]:
        chain = chain.when(holds, name)
    return chain.otherwise("Others")


def rfm_scores(rfm: DataFrame, q: int = 5, id_column: str = "customer_unique_id") -> DataFrame:
    """R, F and M scores 1…q, their bucket and sum, and the classic segment.

    ``rfm`` is read once per score; pass a stored or settled table. The boundaries of the
    three scores do not depend on each other and are looked up side by side.
    """
    check_columns(rfm, ["Recency", "Frequency", "Monetary"])
    in_thread = inheritable_thread_target(rfm.sparkSession)
    with ThreadPool(3) as pool:
        edges = pool.apply_async(in_thread(quantile_edges), (rfm, "Recency", q))
        by_orders = pool.apply_async(in_thread(rank_label), (rfm, "Frequency", id_column, q))
        by_value = pool.apply_async(in_thread(rank_label), (rfm, "Monetary", id_column, q))
        scores = {
            "R_score": quantile_label("Recency", edges.get(), list(range(q, 0, -1))),
            "F_score": by_orders.get(),
            "M_score": by_value.get(),
        }
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    return rfm.withColumns(scores).withColumns(
        {
            "RFM_bucket": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
            "RFM_score": r + f + m,
            "RFM_segment": rfm_segment(r, f, m),
        }
    )


def revenue_segment(share: Column | str) -> Column:
    return banded(share, REVENUE_CUTS, REVENUE_LABELS)


def recency_segment(days: Column | str) -> Column:
    return banded(days, RECENCY_CUTS, RECENCY_LABELS)


def cumulative_share(
    df: DataFrame,
    value: str,
    id_column: str,
    name: str = "cum_revenue_pct",
) -> DataFrame:
    """Running share of the total from the largest value down, the row itself included.

    Equal values are ordered by id.
    """
    ordered = running_totals(
        df, [F.col(value).desc(), F.col(id_column).asc()], {"_run": money(value)}
    )
    share = F.try_divide(F.col("_run").cast("double"), F.col("_run_total").cast("double"))
    return ordered.withColumn(name, share).drop("_run", "_run_total")


def strategic_segments(rfm: DataFrame, id_column: str = "customer_unique_id") -> DataFrame:
    """Revenue segment by cumulative revenue, recency segment by days, and both combined."""
    shared = cumulative_share(rfm, "Monetary", id_column)
    return shared.withColumns(
        {
            "Revenue_segment": revenue_segment("cum_revenue_pct"),
            "Recency_segment": recency_segment("Recency"),
        }
    ).withColumn(
        "Strategic_segment", F.concat("Revenue_segment", F.lit(" - "), "Recency_segment")
    )


def lifetime_value(rfm: DataFrame, horizon_months: int = 12) -> DataFrame:
    """Projected value: mean order value × orders per month × horizon."""
    monthly = F.col("Frequency") / F.lit(HISTORY_MONTHS)
    return rfm.withColumn("Freq_Mensal", monthly).withColumn(
        "CLV_12m",
        half_even(F.col("Avg_Order_Value") * F.col("Freq_Mensal") * F.lit(horizon_months), 2),
    )


def cluster_profile(rfm: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Mean recency, frequency and value per cluster, its size, and mean order value if known."""
    columns = {"R_mean": "Recency", "F_mean": "Frequency", "M_mean": "Monetary"}
    means = [F.avg(F.col(c).cast("double")).alias(n) for n, c in columns.items()]
    if "Avg_Order_Value" in rfm.columns:
        means.append(F.avg("Avg_Order_Value").alias("AOV_mean"))
    return (
        rfm.where(F.col(cluster).isNotNull())
        .groupBy(cluster)
        .agg(*means, F.count("Recency").alias("n_clientes"))
    )


def cluster_names(rfm: DataFrame, cluster: str = "Cluster") -> dict[int, str]:
    """Business name per cluster id, from the profile alone.

    Highest mean recency is at risk; of the rest, highest frequency × value are champions;
    of the rest, highest value are big spenders; all others are new or occasional.
    """
    # One row per cluster comes to the driver; the lowest id wins a tie.
    rest = sorted(cluster_profile(rfm, cluster).collect(), key=lambda p: p[cluster])
    if len(rest) != 4:
        warnings.warn(f"names are meant for 4 clusters, found {len(rest)}", stacklevel=2)
    names: dict[int, str] = {}
    for name, strength in (
        (AT_RISK, lambda p: p["R_mean"]),
        (CHAMPIONS, lambda p: p["F_mean"] * p["M_mean"]),
        (BIG_SPENDERS, lambda p: p["M_mean"]),
    ):
        if rest:
            top = max(rest, key=strength)
            names[int(top[cluster])] = name
            rest.remove(top)
    names.update({int(p[cluster]): NEW_OCCASIONAL for p in rest})
    return names


def assign_cluster_names(
    rfm: DataFrame, names: Mapping[int, str] | None = None, cluster: str = "Cluster"
) -> DataFrame:
    """Add ``Cluster_Name``. The query fails on a cluster id without a name."""
    names = cluster_names(rfm, cluster) if names is None else names
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(lookup, F.col(cluster).cast("int"))
    unnamed = F.raise_error(
        F.concat(F.lit("no name for cluster "), F.coalesce(F.col(cluster).cast("string"), F.lit("null")))
    )
    return rfm.withColumn("Cluster_Name", F.coalesce(found, unnamed))
