"""K-means from several starts at once: every pass over the rows serves all of them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.shipping import ship

Centres = list[list[float]]
ITERATIONS, TOLERANCE = 300, 1e-4  # fixed values; the second in shares of the mean variance


@dataclass(frozen=True)
class Fit:
    centres: Centres
    cost: float
    iterations: int


def as_columns(points: DataFrame, p: str, width: int) -> DataFrame:
    """The entries of an array column as ``x0``, ``x1`` and so on, beside the other columns."""
    entries = {f"x{i}": F.col(p)[i] for i in range(width)}
    return points.withColumns(entries).drop(p)


def _square(centre: Sequence[float]) -> str:
    return " + ".join(f"(x{i} - ({c!r}D)) * (x{i} - ({c!r}D))" for i, c in enumerate(centre))


def nearest_centre(centres: Centres) -> Column:
    """``cost`` (squared distance) and ``cluster`` of the nearest centre; the first among equals."""
    each = [f"struct({_square(centre)} AS cost, {j} AS cluster)" for j, centre in enumerate(centres)]
    return F.expr(f"array_min(array({', '.join(each)}))")


def least_cost(centres: Centres) -> Column:
    """The squared distance of the nearest centre."""
    each = [_square(centre) for centre in centres]
    return F.expr(each[0] if len(each) == 1 else f"least({', '.join(each)})")


class _Sums:
    """Rows, cost and sums by cluster, for several sets of centres, of the points added so far."""

    def __init__(self, sets: Mapping[int, Centres]):
        self.centres = {s: np.asarray(c, dtype=float) for s, c in sets.items()}
        width = 1 + len(next(iter(self.centres.values()))[0])  # the cost, and every coordinate
        self.rows = {s: np.zeros(len(c), dtype=np.int64) for s, c in self.centres.items()}
        self.known = {s: np.zeros((len(c), width), dtype=np.int64) for s, c in self.centres.items()}
        self.sums = {s: np.zeros((len(c), width)) for s, c in self.centres.items()}

    def add(self, x: np.ndarray) -> None:
        for s, centres in self.centres.items():
            square = np.zeros((len(x), len(centres)))
            for i in range(x.shape[1]):
                gap = np.subtract.outer(x[:, i], centres[:, i])
                square += gap * gap
            at = square.argmin(axis=1)
            values = np.column_stack([square[np.arange(len(x)), at], x])
            blank = np.isnan(values)
            values[blank] = 0.0
            self.rows[s] += np.bincount(at, minlength=len(centres))
            for i in range(values.shape[1]):
                self.sums[s][:, i] += np.bincount(at, weights=values[:, i], minlength=len(centres))
                self.known[s][:, i] += np.bincount(at, weights=~blank[:, i], minlength=len(centres)).astype(np.int64)

    def frame(self, names: Sequence[str]) -> pd.DataFrame:
        found = []
        for s, rows in self.rows.items():
            for j in np.flatnonzero(rows):
                sums = [float(v) if n else None for v, n in zip(self.sums[s][j], self.known[s][j], strict=True)]
                found.append((s, int(j), int(rows[j]), *sums))
        return pd.DataFrame(found, columns=["start", "cluster", "n", "cost", *names])


def _partial_passes(points: DataFrame, sets: Mapping[int, Centres]) -> DataFrame:
    """The rows of ``passes`` for each task by itself."""
    ship(points.sparkSession)
    names = [f"x{i}" for i in range(len(next(iter(sets.values()))[0]))]
    given = dict(sets)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(given)
        for frame in frames:
            sums.add(frame.to_numpy(dtype=float))
        yield sums.frame(names)

    doubles = ", ".join(f"{x} double" for x in ("cost", *names))
    return points.select(*names).mapInPandas(add, f"start int, cluster int, n bigint, {doubles}")


def passes(points: DataFrame, sets: Mapping[int, Centres]) -> DataFrame:
    """Rows, cost and sums of every cluster of every start: ``start, cluster, n, cost, x0, …``.

    ``points`` has the columns ``x0`` and so on.
    """
    sums = ["cost", *[f"x{i}" for i in range(len(next(iter(sets.values()))[0]))]]
    return _partial_passes(points, sets).groupBy("start", "cluster").agg(
        F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums]
    )


def _pass(points: DataFrame, sets: Mapping[int, Centres]) -> dict[tuple[int, int], list[float]]:
    """The rows, cost and sums of ``passes`` by start and cluster, on the driver."""
    found: dict[tuple[int, int], list[list[float]]] = {}
    for r in _partial_passes(points, sets).collect():  # for each task a row per start and cluster
        found.setdefault((r[0], r[1]), []).append([0.0 if v is None else v for v in r[2:]])
    return {k: [math.fsum(v) for v in zip(*rows, strict=True)] for k, rows in sorted(found.items())}


def first_centres(points: DataFrame, width: int, k: int, starts: int, seed: int) -> dict[int, Centres]:
    """Centres far apart: each next one is drawn with a chance in proportion to the squared distance
    from those before. One aggregate draws it for all starts: of exponential waiting times with
    these rates, the shortest wins. The chances come from hashes of the points.
    """
    names = [f"x{i}" for i in range(width)]
    sets: dict[int, Centres] = {s: [] for s in range(starts)}
    for step in range(k):
        draws = []
        for s in range(starts):
            hashed = F.xxhash64(*names, F.lit(seed), F.lit(s), F.lit(step))
            chance = (F.pmod(hashed, F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
            rate = least_cost(sets[s]) if sets[s] else F.lit(1.0)
            wait = F.when(rate > 0, -F.log(chance) / rate)
            draws.append(F.min(F.when(wait.isNotNull(), F.struct(wait.alias("wait"), *names))).alias(f"s{s}"))
        row = points.agg(*draws).first()
        for s in range(starts):
            drawn = row[f"s{s}"]
            if drawn is not None:  # else there are fewer distinct points than centres
                sets[s].append([float(drawn[x]) for x in names])
    return sets


def fit_kmeans(points: DataFrame, width: int, k: int, starts: int, seed: int = 42) -> list[Fit]:
    """A fit for each start, the one with the lowest cost first.

    ``points`` has the columns ``x0`` and so on, and is read once for each centre drawn and each
    iteration; pass a stored table. A start leaves the passes when its centres move less than the
    tolerance. A cluster without rows keeps its centre.
    """
    names = [f"x{i}" for i in range(width)]
    spread = points.agg(*[F.var_pop(x).alias(x) for x in names]).first()
    least = TOLERANCE * sum(spread[x] or 0.0 for x in names) / width
    sets = first_centres(points, width, k, starts, seed)
    if not sets[0]:
        raise ValueError("k-means needs rows")
    active, iterations = dict(sets), dict.fromkeys(sets, 0)
    for _ in range(ITERATIONS):
        if not active:
            break
        moved = dict.fromkeys(active, 0.0)
        for (start, cluster), (n, _, *sums) in _pass(points, active).items():
            old, new = sets[start][cluster], [x / n for x in sums]
            moved[start] += sum((a - b) ** 2 for a, b in zip(old, new, strict=True))
            sets[start] = [new if j == cluster else c for j, c in enumerate(sets[start])]
        for s in active:
            iterations[s] += 1
        active = {s: sets[s] for s in active if moved[s] > least}
    costs = dict.fromkeys(sets, 0.0)
    for (start, _), (_, cost, *_) in _pass(points, sets).items():
        costs[start] += cost
    fits = [(cost, start) for start, cost in costs.items()]
    return [Fit(sets[s], float(cost), iterations[s]) for cost, s in sorted(fits)]


class CentreModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``Cluster``, the number of the nearest centre, from the vector ``features``."""

    content = Param(Params._dummy(), "content", "centres and cost as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, content: str = ""):
        super().__init__()
        self._setDefault(content="")
        if content:
            self._set(content=content)

    @classmethod
    def of(cls, fit: Fit) -> CentreModel:
        return cls(content=json.dumps({"centres": fit.centres, "cost": fit.cost}))

    def _found(self) -> dict:
        return json.loads(self.getOrDefault(self.content))

    def clusterCenters(self) -> Sequence[Sequence[float]]:
        return self._found()["centres"]

    def getK(self) -> int:
        return len(self.clusterCenters())

    def trainingCost(self) -> float:
        return self._found()["cost"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centres = self.clusterCenters()
        kept = dataset.columns
        wide = as_columns(dataset.withColumn("_p", vector_to_array("features")), "_p", len(centres[0]))
        return wide.select(*kept, nearest_centre(centres)["cluster"].alias("Cluster"))
