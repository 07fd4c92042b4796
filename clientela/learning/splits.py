"""Repeatable splits that keep the share of each class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.operators.ordering import after, hash_order, keys_at_ranks


def stratified_parts(
    df: DataFrame,
    id_column: str,
    label: str,
    shares: Sequence[float],
    name: str,
    seed: int = 42,
) -> DataFrame:
    """Number the rows of each class 0, 1, … by cumulative ``shares`` in hash order.

    Only the boundary keys are looked up, one per class and part; rows are labelled in place.
    """
    order = {"hash": hash_order(id_column, seed), "id": F.col(id_column)}
    types = {"hash": "string", "id": df.schema[id_column].dataType.simpleString()}
    bounds = {str(i): F.floor(F.col("size") * share + 0.5) for i, share in enumerate(shares)}
    cuts = keys_at_ranks(df, order, bounds, by=[label])
    found = {(c[label], int(c["label"])): c for c in cuts}
    classes = sorted({c[label] for c in cuts})
    part: Column | None = None
    for value in classes:
        place = F.lit(0)
        for i in range(len(shares)):
            # A boundary at rank 0 has no key: every row of the class lies after it.
            cut = found.get((value, i))
            place = place + (F.lit(1) if cut is None else after(order, cut, types).cast("int"))
        here = F.col(label) == F.lit(value)
        part = F.when(here, place) if part is None else part.when(here, place)
    return df.withColumn(name, F.lit(None).cast("int") if part is None else part)


def stratified_split(
    df: DataFrame, id_column: str, label: str, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    parts = stratified_parts(df, id_column, label, [test_share], "_part_no", seed)
    train, test = F.col("_part_no") == 1, F.col("_part_no") == 0
    return parts.where(train).drop("_part_no"), parts.where(test).drop("_part_no")


def stratified_folds(
    df: DataFrame, id_column: str, label: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: 0 … folds−1, of equal size within each class."""
    shares = [i / folds for i in range(1, folds)]
    return stratified_parts(df, id_column, label, shares, "fold", seed)
