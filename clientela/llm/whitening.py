"""Whitening of embeddings with distributed block matrices.

Vectors are quantised to whole numbers, so that sums and centring are exact (a common origin of
the numbers would cancel out in all results, so there is none). The distinct ones,
centred, become rows of block matrices; the transpose times the matrix gives the scatter, whose
eigenvectors are found on the driver (as many numbers as the width squared, whatever the rows).
Products of block matrices with the whitening matrix project the rows.

A product deals its blocks over about the root of the partitions it was given, and holds what a
partition gets. So the rows are cut into panels of bounded size, each a block matrix of its own;
their scatters are added up, and several panels are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientela.session import scratch_folder, settle

STEPS = 64  # a unit is cut into so many steps
LARGEST = 1 << 52  # a product of entry and STEPS beyond this counts as this
PANEL_BYTES = 256 << 20  # of doubles in the block matrix of a panel
PANEL_BLOCKS = 64  # blocks of rows in a panel
PANELS_AT_ONCE = 4
WIDEST_BLOCK = 1024
LEAST_SHARE = 1e-11  # of the trace: below, an eigenvalue is rounding error of the scatter
ROW_BITS = 33  # of monotonically_increasing_id, below those of the partition
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Moments:
    """Of the fit list: the number of vectors and the sum of every dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: Column) -> Column:
        """``n*x - S`` for every dimension, exact."""
        sums = F.array(*[F.lit(str(s)).cast(EXACT) for s in self.sums])
        n = F.lit(self.n).cast("decimal(19,0)")
        return F.zip_with(x, sums, lambda a, s: (n * a.cast("decimal(18,0)")).cast(EXACT) - s)


@dataclass(frozen=True)
class Whitening:
    """Eigenvalue shares and the matrix that turns centred rows into whitened ones."""

    explained: np.ndarray
    matrix: np.ndarray


def quantised(vectors: Column) -> Column:
    """``floor(64*c)`` of every entry c; null if the vector is null or has an entry that is null
    or not finite."""
    entries = vectors.cast("array<double>")
    bound = F.lit(float(LARGEST))
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(
        entries, lambda c: F.floor(F.greatest(-bound, F.least(bound, c * STEPS))).cast("bigint")
    )
    return F.when(usable, whole)


def moments(fit: DataFrame, width: int) -> Moments:
    """Of the vectors ``x``, one row for each dimension on the driver."""
    n = fit.count()
    sums = [0] * width
    entries = fit.select(F.posexplode("x").alias("at", "v"))
    total = F.sum(F.col("v").cast("decimal(18,0)")).cast(EXACT).alias("total")
    for r in entries.groupBy("at").agg(total).collect():
        sums[r["at"]] = int(r["total"])
    return Moments(n, sums)


class Panels:
    """Centred rows, numbered and cut into panels, in a table in the shared folder.

    Row numbers come from the place in the settled input, so they stay the same however often
    a part is computed again.
    """

    def __init__(self, settled: DataFrame, at: str, size: int, centre: Moments):
        self.spark, self.width = settled.sparkSession, len(centre.sums)
        self.size = size
        self.rows_each = max(PANEL_BLOCKS, PANEL_BYTES // (8 * self.width))
        self.count = -(-size // self.rows_each)
        self.block_rows = max(1, -(-min(size, self.rows_each) // PANEL_BLOCKS))
        self.block_columns = min(self.width, WIDEST_BLOCK)
        part = F.shiftright(at, ROW_BITS)
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = settled.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        starts = sizes.select(  # a row for each task that wrote
            "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
        )
        numbered = settled.withColumn("__part", part).join(F.broadcast(starts), "__part")
        number = F.col("__start") + F.col(at).bitwiseAND((1 << ROW_BITS) - 1)
        centred = F.transform(centre.deviations(F.col("x")), lambda d: d.cast("double") / centre.n)
        self.path = scratch_folder(self.spark, "panels")
        numbered.select(
            *[c for c in settled.columns if c not in (at, "x")],
            F.col("x"),
            centred.alias("centred"),
            F.floor(number / self.rows_each).alias("panel"),
            (number % self.rows_each).alias("row"),
        ).write.partitionBy("panel").parquet(self.path)
        self.table = self.spark.read.parquet(self.path)

    def matrix(self, panel: int) -> BlockMatrix:
        rows = self.table.where(F.col("panel") == panel)
        vectors = MLUtils.convertVectorColumnsFromML(
            rows.select("row", array_to_vector("centred").alias("vector")), "vector"
        )
        size = min(self.rows_each, self.size - panel * self.rows_each)
        return IndexedRowMatrix(vectors, size, self.width).toBlockMatrix(
            self.block_rows, self.block_columns
        )

    def matrices(self) -> Iterator[BlockMatrix]:
        return map(self.matrix, range(self.count))


def _self_product(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, its row blocks added up in several tasks."""
    turned = matrix.transpose()._java_matrix_wrapper
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, PANEL_BLOCKS)
    found = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock)
    return found.toLocalMatrix().toArray()


def _added(parts: list[BlockMatrix]) -> np.ndarray:
    with ThreadPoolExecutor(PANELS_AT_ONCE) as pool:
        return reduce(np.add, pool.map(_self_product, parts))


def whitening_of(covariance: np.ndarray, components: int) -> Whitening:
    """The leading eigenvectors, each over the root of its eigenvalue.

    Eigenvalues that cannot be told from 0 have no whitened component.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    kept = values > LEAST_SHARE * trace
    values, vectors = values[kept], vectors[:, kept]
    return Whitening(values / trace if trace else values, vectors / np.sqrt(values))


def _as_blocks(spark: SparkSession, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    rows = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(matrix)],
        "row bigint, entries array<double>",
    )
    vectors = MLUtils.convertVectorColumnsFromML(
        rows.select("row", array_to_vector("entries").alias("vector")), "vector"
    )
    return IndexedRowMatrix(vectors, *matrix.shape).toBlockMatrix(rows_per_block, matrix.shape[1])


def _rows_of(matrix: BlockMatrix, panel: int) -> DataFrame:
    java_rows = matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    rows = callMLlibFunc("getIndexedRows", java_rows)
    return rows.select(
        F.lit(panel).alias("panel"),
        F.col("index").alias("row"),
        vector_to_array("vector").alias("whitened"),
    )


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16
) -> DataFrame:
    """Whitened components of every usable vector, a row for each vector and component.

    ``id_col``, ``component`` from 1 by falling eigenvalue, ``n`` (size of the fit list),
    ``deviation`` (squared distance of ``n*x`` from the sums), ``whitened``, ``explained``,
    ``identity_error``. The fit list has every distinct quantised vector once; all covariances
    are over it, with its size as divisor. Its rows are centred exactly, so the whitened ones
    are as well, to rounding.

    Vectors that are null or have a null, infinite or NaN entry have no rows; null and repeated
    ids are kept as they are, and other columns left out. Where widths differ, shorter vectors
    (also empty ones) go on with zeros. There are fewer components where fewer eigenvalues differ
    from 0, and none, so no rows, if all vectors are equal or there are none. ``deviation`` is
    null where it does not fit into a long.
    """
    spark = df.sparkSession
    whole = df.select(F.col(id_col).alias("__id"), quantised(F.col(vector_col)).alias("x"))
    kind = df.schema[id_col].dataType.simpleString()
    usable = settle(
        whole.where(F.col("x").isNotNull()).withColumn("__at", F.monotonically_increasing_id())
    )
    facts = usable.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")
    ).first()
    result = (
        f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    if not facts["most"]:
        return spark.createDataFrame([], result)
    width = facts["most"]
    if facts["least"] < width:
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
        usable = settle(usable.withColumn("x", F.concat("x", zeros)))
    distinct = usable.select("x").distinct()
    fit = settle(distinct.withColumn("__at", F.monotonically_increasing_id()))
    centre = moments(fit, width)
    fitted = Panels(fit, "__at", centre.n, centre)
    parts = list(fitted.matrices())
    found = whitening_of(_added(parts) / centre.n, components)
    size = len(found.explained)
    if not size:
        return spark.createDataFrame([], result)
    by = _as_blocks(spark, found.matrix, fitted.block_columns)
    covariance = _added([p.multiply(by) for p in parts]) / centre.n
    error = float(np.abs(covariance - np.eye(size)).max())

    every = Panels(usable, "__at", facts["n"], centre)
    by = _as_blocks(spark, found.matrix, every.block_columns)
    projected = reduce(
        DataFrame.unionByName,
        (_rows_of(m.multiply(by), p) for p, m in enumerate(every.matrices())),
    )
    squares = F.aggregate(
        centre.deviations(F.col("x")),
        F.lit(0).cast(EXACT),
        lambda total, d: F.try_add(total, F.try_multiply(d, d).cast(EXACT)).cast(EXACT),
    )
    known = every.table.select("panel", "row", "__id", squares.try_cast("bigint").alias("deviation"))
    shares = F.array(*[F.lit(float(v)) for v in found.explained])
    return (
        known.join(projected, ["panel", "row"])
        .select(
            F.col("__id").alias(id_col),
            "deviation",
            F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "c"),
        )
        .select(
            id_col,
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(centre.n).cast("bigint").alias("n"),
            "deviation",
            F.col("c.whitened").alias("whitened"),
            F.col("c.explained").alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
