"""Ranks and running totals over a whole table, without sorting it in one task.

A window without a partition runs in a single task. Here the rows are range-partitioned on
the ordering key instead, so that parts follow each other in order. Totals per part (a
handful of rows, one per shuffle partition) give each part its starting point, and an
ordinary window inside each part does the rest.

The layout of the parts is data, so it is settled before it is read a second time. Keys must
be unique for an even layout: break ties with an id, or count equal values first
(``value_totals``), as 97 % of customers can share one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.session import settle

PART = "_part"
PART_BITS = 33  # of monotonically_increasing_id, below those of the partition


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lay_out(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column], by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The rows in range partitions, settled; and one row per part with where it starts.

    Amounts are in ``_x_<name>``; starts have the sum before (``_b_``) and within (``_s_``)
    the part and the whole sum (``<name>_total``).
    """
    amounts = {f"_x_{n}": c for n, c in totals.items()}
    laid_out = settle(
        df.withColumns(amounts)
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn(PART, F.spark_partition_id())
    )
    per_part = laid_out.groupBy(*by, PART).agg(
        *[F.coalesce(F.sum(f"_x_{n}"), F.lit(0)).alias(f"_s_{n}") for n in totals]
    )
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = per_part.select(
        *by,
        PART,
        *[F.col(f"_s_{n}") for n in totals],
        *[
            F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}")
            for n in totals
        ],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in totals],
    )
    if not by:
        starts = F.broadcast(starts)  # one row per shuffle partition
    return laid_out, starts


def _within_parts(
    laid_out: DataFrame,
    starts: DataFrame,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    by: Sequence[str],
) -> DataFrame:
    so_far = (
        Window.partitionBy(*by, PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {
        n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_x_{n}").over(so_far), F.lit(0)) for n in totals
    }
    helpers = [f"{p}{n}" for n in totals for p in ("_x_", "_b_", "_s_")]
    return laid_out.join(starts, [*by, PART]).withColumns(running).drop(PART, *helpers)


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add, for each name in ``totals``, the running sum in ``order`` up to and including the row.

    The whole sum is added as ``<name>_total``. With ``by`` the sums start anew in every
    group; a group may span many parts.
    """
    laid_out, starts = _lay_out(df, order, totals, by)
    return _within_parts(laid_out, starts, order, totals, by)


def _numbered(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Ranks over the whole table from one shuffle: rows are sorted within their part before they are
    settled, so that their place there is their rank in the part."""
    laid_out = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(PART, F.monotonically_increasing_id())
    )
    place = F.col(PART).bitwiseAND((1 << PART_BITS) - 1)
    sizes = laid_out.groupBy(F.shiftright(PART, PART_BITS).alias("_part_no")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.orderBy("_part_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(  # one row per shuffle partition
        "_part_no",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias(f"{rank}_total"),
    )
    return (
        laid_out.withColumn("_part_no", F.shiftright(PART, PART_BITS))
        .join(F.broadcast(starts), "_part_no")
        .withColumn(rank, F.col("_before") + place + 1)
        .select(*df.columns, rank, f"{rank}_total")
    )


def with_rank(
    df: DataFrame,
    order: Sequence[Column],
    rank: str = "rank",
    by: Sequence[str] = (),
    **totals: Column,
) -> DataFrame:
    """Number the rows 1…n in ``order``, with ``<rank>_total`` = n and further running sums."""
    if not by and not totals:
        return _numbered(df, order, rank)
    return running_totals(df, order, {rank: F.lit(1).cast("bigint"), **totals}, by)


def value_totals(
    df: DataFrame, value: Column | str, by: Sequence[str] = (), **totals: Column
) -> DataFrame:
    """Rows per distinct value (null left out): columns ``value``, ``n`` and ``totals``."""
    sums = [F.sum(c).alias(n) for n, c in totals.items()]
    return (
        df.withColumn("value", _column(value))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
    )


def ranked_values(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str] = (),
    descending: bool = False,
    **totals: Column,
) -> DataFrame:
    """Distinct values in order with ``n``, the rank ``upto`` of their last row, ``upto_total``
    and, for each name in ``totals``, its sum and running sum ``<name>_upto``."""
    counted = value_totals(df, value, by, **totals)
    order = F.col("value").desc() if descending else F.col("value").asc()
    running = {"upto": F.col("n"), **{f"{n}_upto": F.col(n) for n in totals}}
    return running_totals(counted, [order], running, by)


def quantiles(
    df: DataFrame,
    value: Column | str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    **aggregates: Column,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name.

    Gives one row, or one per group. ``aggregates`` are computed in the same pass over the
    distinct values; they may use the columns ``value`` (double), ``n``, ``upto``.
    """
    ranked = ranked_values(df, value, by).withColumn("value", F.col("value").cast("double"))

    def position(p: float, size: Column) -> Column:
        return (size - 1).cast("double") * F.lit(float(p))

    # The two neighbours of every position, numbered; few rows hold one of them.
    size = F.col("upto_total")
    wanted = F.array(
        *[
            F.struct(F.lit(2 * i + high).alias("no"), side(position(p, size)).alias("at"))
            for i, p in enumerate(probabilities.values())
            for high, side in enumerate((F.floor, F.ceil))
        ]
    )
    here = F.filter(
        wanted,
        lambda w: (w["at"] >= F.col("upto") - F.col("n")) & (w["at"] < F.col("upto")),
    )
    hits = F.transform(here, lambda w: F.struct(w["no"].alias("no"), F.col("value").alias("v")))
    found = ranked.withColumn("_hits", hits).groupBy(*by).agg(
        F.map_from_entries(
            F.flatten(F.collect_list(F.when(F.size("_hits") > 0, F.col("_hits"))))
        ).alias("_found"),
        F.max("upto_total").alias("_size"),
        *[c.alias(n) for n, c in aggregates.items()],
    )
    columns = []
    for i, (name, p) in enumerate(probabilities.items()):
        low = F.try_element_at("_found", F.lit(2 * i))
        high = F.try_element_at("_found", F.lit(2 * i + 1))
        place = position(p, F.col("_size"))
        columns.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*by, *columns, *aggregates)


def keys_at_ranks(
    df: DataFrame,
    order: Mapping[str, Column],
    ranks_of: Mapping[str, Column],
    by: Sequence[str] = (),
) -> list[dict[str, Any]]:
    """The ordering keys found at chosen ranks, as plain values on the driver.

    ``order`` names the key columns (ascending); ``ranks_of`` maps a label to a rank, an
    expression over the group size ``size``. Only the narrow key columns are shuffled, and
    only one row per label (and group) comes back.
    """
    narrow = df.select(*by, *[c.alias(n) for n, c in order.items()])
    keys, count = [F.col(n) for n in order], {"_rank": F.lit(1).cast("bigint")}
    laid_out, starts = _lay_out(narrow, keys, count, by)
    wanted = F.array(
        *[F.struct(F.lit(n).alias("label"), r.cast("bigint").alias("at")) for n, r in ranks_of.items()]
    )
    before, here = F.col("_b__rank"), F.col("_s__rank")
    # Only the few parts that hold one of the ranks are sorted and numbered.
    holding = (
        starts.withColumnRenamed("_rank_total", "size")
        .withColumn(
            "_hits", F.filter(wanted, lambda w: (w["at"] > before) & (w["at"] <= before + here))
        )
        .where(F.size("_hits") > 0)
    )
    hits = (
        _within_parts(laid_out, holding, keys, count, by)
        .withColumn("hit", F.explode(F.filter("_hits", lambda w: w["at"] == F.col("_rank"))))
        .select(*by, "hit.label", *order, "_rank", "size")
    )
    return [r.asDict() for r in hits.collect()]


def after(order: Mapping[str, Column], key: Mapping[str, Any], types: Mapping[str, str]) -> Column:
    """Whether a row's composite key comes after ``key``, compared column by column."""
    names = list(order)
    row = F.struct(*[order[n].cast(types[n]).alias(n) for n in names])
    cut = F.struct(*[F.lit(key[n]).cast(types[n]).alias(n) for n in names])
    return row > cut


def hash_order(id_column: str, seed: int) -> Column:
    """A repeatable shuffle: the order of this text has nothing to do with the data."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows that does not depend on the layout of ``df``.

    Rows whose hash is clearly too large are dropped first, so that the final top-n only
    sees a little more than ``n`` rows in all.
    """
    size = df.count()
    key = hash_order(id_column, seed)
    if size > 0 and n < size:
        share = min(1.0, (n + 10 * n**0.5 + 100) / size)
        bound = min(int(share * 2**60), 2**60 - 1)
        near = df.where(key < F.lit(f"{bound:015x}"))
        if near.count() >= n:
            df = near
    return df.orderBy(key, F.col(id_column)).limit(n)
