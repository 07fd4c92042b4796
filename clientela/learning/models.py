"""Preprocessing and candidate classifiers as Spark ML pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.learning.boosting import Boosted, BoostedModel, HistogramBoosting
from clientela.learning.boosting import Settings as BoostingSettings
from clientela.learning.forest import BalancedForest, ForestModel
from clientela.learning.forest import Settings as ForestSettings
from clientela.learning.forest import scores as forest_scores
from clientela.learning.oversampling import oversample
from clientela.learning.trees import Tree
from clientela.operators.distributions import long_form
from clientela.operators.ordering import hash_order, running_totals
from clientela.shipping import ship

SEED = 42
MIN_SHARE = 0.01  # fixed value: rarer category levels are merged
RARE = "__rare__"


@dataclass(frozen=True)
class Features:
    """What a model is trained on: the columns, and the id that makes splits repeatable."""

    id_column: str
    numeric: Sequence[str]
    categories: Sequence[str]


@dataclass(frozen=True)
class Candidate:
    """A classifier to be tried. ``prepare`` adapts the training rows (weights, new rows)."""

    name: str
    estimator: Callable[[DataFrame], Estimator | Transformer]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class _Moments:
    """Size, mean and sum of squared deviations of some values."""

    n: float = 0.0
    mean: float = 0.0
    m2: float = 0.0

    def with_(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return _Moments(
            n, self.mean + gap * other.n / n, self.m2 + other.m2 + gap * gap * self.n * other.n / n
        )


def _medians(long: DataFrame, fold: str, keys: Sequence) -> dict[tuple, float | None]:
    """Exact medians by metric and key: over all rows, or over those of all folds but one.

    Values are counted once, by fold; a running count per key, all in one pass, finds the middle.
    """
    in_fold = {k: F.count_if(F.col(fold) == k) for k in keys if k is not None}
    counts = long.groupBy("metric", "value").agg(
        F.count(F.lit(1)).alias("all"), *[c.alias(f"in{k}") for k, c in in_fold.items()]
    )
    sizes = {
        f"upto{i}": F.col("all") if k is None else F.col("all") - F.col(f"in{k}")
        for i, k in enumerate(keys)
    }
    ranked = running_totals(counts, [F.col("value")], sizes, ["metric"])
    middles = []
    for i in range(len(keys)):
        place = (F.col(f"upto{i}_total") - 1) / 2
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            middles.append(F.min(F.when(F.col(f"upto{i}") > at, F.col("value"))).alias(f"{side}{i}"))
    found = {}
    for r in ranked.groupBy("metric").agg(*middles).collect():  # a row for each column
        for i, k in enumerate(keys):
            low, high = r[f"low{i}"], r[f"high{i}"]
            found[r["metric"], k] = None if low is None else (low + high) / 2
    return found


def _levels(df: DataFrame, categories: Sequence[str], fold: str, keys: Sequence) -> dict[tuple, list[str]]:
    """Levels with at least 1 % of the rows, by column and key: at most 100 each."""
    if not categories:
        return {}
    sizes = {r[fold]: r["n"] for r in df.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {k: sum(n for f, n in sizes.items() if k is None or f != k) for k in keys}
    long = df.select(fold, *categories).unpivot([fold], list(categories), "name", "level")
    counts = long.where(F.col("level").isNotNull()).groupBy("name", "level").agg(
        F.count(F.lit(1)).alias("all"),
        *[F.count_if(F.col(fold) == k).alias(f"in{k}") for k in keys if k is not None],
    )
    left = {k: F.col("all") if k is None else F.col("all") - F.col(f"in{k}") for k in keys}
    frequent = {k: (n >= MIN_SHARE * rows[k]) & (n > 0) for k, n in left.items()}
    found: dict[tuple, list[str]] = {(c, k): [] for c in categories for k in keys}
    kept = counts.select("name", "level", *[c.alias(f"keep{i}") for i, c in enumerate(frequent.values())])
    for r in kept.where(reduce(Column.__or__, [F.col(f"keep{i}") for i in range(len(keys))])).collect():
        for i, k in enumerate(keys):
            if r[f"keep{i}"]:
                found[r["name"], k].append(r["level"])
    return {k: sorted(v) for k, v in found.items()}


def _prepared(features: Features, numbers: dict[str, tuple], levels: dict[str, list[str]]) -> PipelineModel:
    """Median-filled, scaled numbers and one-hot categories in one vector ``features``."""
    columns, names = [], []
    for c in features.numeric:
        median, mean, deviation = numbers[c]
        columns.append(f"(COALESCE(CAST(`{c}` AS DOUBLE), {median!r}D) - ({mean!r}D)) / {deviation!r}D AS `{c}_scaled`")
        names.append(f"{c}_scaled")
    for c in features.categories:
        listed = ", ".join(_quoted(v) for v in levels[c]) or _quoted(RARE)
        columns.append(f"CASE WHEN `{c}` IN ({listed}) THEN `{c}` ELSE '{RARE}' END AS `{c}_kept`")
        for i, v in enumerate(levels[c]):
            columns.append(f"CAST(`{c}` <=> {_quoted(v)} AS DOUBLE) AS `{c}_{i}`")
            names.append(f"{c}_{i}")
        columns.append(f"CAST(NOT COALESCE(`{c}` IN ({listed}), FALSE) AS DOUBLE) AS `{c}_rare`")
        names.append(f"{c}_rare")
    return PipelineModel(
        stages=[
            SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"),
            VectorAssembler(inputCols=names, outputCol="features"),
        ]
    )


def fit_preparations(df: DataFrame, features: Features, fold: str) -> dict[int | None, PipelineModel]:
    """For each fold the preprocessing of all other rows, and under ``None`` that of all rows.

    Values, moments and levels are counted once, by fold; what a fold holds is left out of the
    sums. Medians are exact, deviations those of the whole (not of a sample).
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    keys = [None, *folds] if len(folds) > 1 else [None]
    long = long_form(df, features.numeric, [fold])
    known = long.where(F.col("value").isNotNull())
    medians = _medians(known, fold, keys)
    parts: dict[tuple, _Moments] = {}
    blanks: dict[tuple, int] = {}
    sums = long.groupBy("metric", fold).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"),
        F.count_if(F.col("value").isNull()).alias("blank"),
    )
    for r in sums.collect():  # a row for each column and fold
        parts[r["metric"], r[fold]] = _Moments(r["n"], r["mean"] or 0.0, (r["v"] or 0.0) * r["n"])
        blanks[r["metric"], r[fold]] = r["blank"]
    levels = _levels(df, features.categories, fold, keys)
    found = {}
    for k in keys:
        numbers = {}
        for c in features.numeric:
            others = [f for f in folds if f != k]
            median = medians.get((c, k))
            median = 0.0 if median is None else float(median)
            filled = _Moments(float(sum(blanks.get((c, f), 0) for f in others)), median, 0.0)
            whole = reduce(_Moments.with_, (parts.get((c, f), _Moments()) for f in others), filled)
            deviation = math.sqrt(whole.m2 / whole.n) if whole.n else 0.0
            # A column that doesn't vary, rounding apart, is not scaled.
            varies = deviation > 1e-12 * max(1.0, abs(whole.mean))
            numbers[c] = (median, float(whole.mean), deviation if varies else 1.0)
        found[k] = _prepared(features, numbers, {c: levels[c, k] for c in features.categories})
    return found


def fit_preprocessing(train: DataFrame, features: Features) -> PipelineModel:
    """The preprocessing of all rows."""
    return fit_preparations(train.withColumn("_fold", F.lit(0)), features, "_fold")[None]


def _class_sizes(train: DataFrame) -> dict[int, int]:
    return {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}


def balanced(train: DataFrame) -> DataFrame:
    """Add ``weight``, under which both classes weigh the same."""
    sizes = _class_sizes(train)
    n = sum(sizes.values())
    weight: Column = F.lit(1.0)
    for label, size in sizes.items():
        weight = F.when(F.col("y") == label, F.lit(n / (len(sizes) * size))).otherwise(weight)
    return train.withColumn("weight", weight)


def _majority(train: DataFrame) -> Transformer:
    sizes = _class_sizes(train)
    score = 1.0 if sizes.get(1, 0) > sizes.get(0, 0) else 0.0
    return SQLTransformer(statement=f"SELECT *, CAST({score} AS DOUBLE) AS score FROM __THIS__")


def _logistic(weighted: bool, c: float = 0.5) -> Callable[[DataFrame], Estimator]:
    def build(train: DataFrame) -> Estimator:
        # The penalty is stated per row here, over all rows in the usual C.
        model = LogisticRegression(
            labelCol="y",
            maxIter=2000,
            regParam=1.0 / (c * max(1, train.count())),
            elasticNetParam=0.0,
            standardization=False,
        )
        return model.setWeightCol("weight") if weighted else model

    return build


def candidates(
    id_column: str,
    forest: dict,
    boosting: dict,
    with_oversampling: bool = False,
) -> list[Candidate]:
    """The model family, in order of preference among equals.

    ``forest`` and ``boosting``: the fields of their ``Settings``; 15 % of the rows decide when
    boosting stops.
    """

    def held_back(train: DataFrame) -> DataFrame:
        # Another seed than the splits use: the training rows are cut along that hash.
        order = hash_order(id_column, SEED + 1)
        early = F.lit(f"{int(0.15 * 2**60):015x}")
        return balanced(train).withColumn("validation", order < early)

    family = [
        Candidate("baseline", _majority),
        Candidate("logistic", _logistic(weighted=True), balanced),
        Candidate(
            "forest",
            lambda _: BalancedForest(id_column, ForestSettings(seed=SEED, **forest)),
        ),
        Candidate(
            "boosting",
            lambda _: HistogramBoosting(BoostingSettings(**boosting)),
            held_back,
        ),
    ]
    if with_oversampling:
        family.append(
            Candidate(
                "oversampled logistic",
                _logistic(weighted=False),
                lambda train: oversample(train, id_column, seed=SEED),
            )
        )
    return family


# Settings of the two models' candidates.
REVIEW_FOREST = {"trees": 400, "depth": 14, "least_rows": 20}
REVIEW_BOOSTING = {"iterations": 500, "depth": 5, "step": 0.07, "penalty": 1.0}
REPEAT_FOREST = {"trees": 300, "depth": 12, "least_rows": 30}
REPEAT_BOOSTING = {"iterations": 400, "depth": 4, "step": 0.06, "penalty": 1.0}


def review_candidates(forest: dict | None = None, boosting: dict | None = None) -> list[Candidate]:
    return candidates("order_id", forest or REVIEW_FOREST, boosting or REVIEW_BOOSTING)


def repeat_candidates(forest: dict | None = None, boosting: dict | None = None) -> list[Candidate]:
    return candidates(
        "customer_unique_id",
        forest or REPEAT_FOREST,
        boosting or REPEAT_BOOSTING,
        with_oversampling=True,
    )


def fit_prepared(candidate: Candidate, prepared: DataFrame) -> PipelineModel:
    """Fit a candidate on rows that already carry ``features``."""
    rows = candidate.prepare(prepared)
    stage = candidate.estimator(rows)
    fitted = stage.fit(rows) if isinstance(stage, Estimator) else stage
    return PipelineModel(stages=[fitted])


def fit(candidate: Candidate, train: DataFrame, features: Features) -> PipelineModel:
    """Preprocessing and classifier as one model that can be stored."""
    preparation = fit_preprocessing(train, features)
    prepared = preparation.transform(train).select(features.id_column, "y", "features").cache()
    try:
        model = fit_prepared(candidate, prepared)
    finally:
        prepared.unpersist()
    return PipelineModel(stages=[*preparation.stages, *model.stages])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class, to the columns of ``df``."""
    out = model.transform(df)
    if "score" not in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "score")


COPIES_AT_ONCE = 1 << 14


@dataclass(frozen=True)
class Coding:
    """Prepared rows as a number for each feature: the scaled value, or the place of the category's level."""

    numeric: int
    levels: tuple[int, ...]  # columns of each category

    @classmethod
    def of(cls, model: PipelineModel, features: Features) -> Coding | None:
        """Of a model as ``fit`` makes it, whose scores can be had in tasks; none for other models."""
        stages = model.stages
        if len(stages) != 3 or not isinstance(stages[1], VectorAssembler) or _array_scores(stages[2]) is None:
            return None
        names, at, sizes = list(stages[1].getInputCols()), len(features.numeric), []
        if names[:at] != [f"{c}_scaled" for c in features.numeric]:
            return None
        for c in features.categories:
            if f"{c}_rare" not in names[at:]:
                return None
            sizes.append(names.index(f"{c}_rare", at) + 1 - at)
            at += sizes[-1]
        return cls(len(features.numeric), tuple(sizes)) if at == len(names) else None

    def columns(self, vector: str) -> list[Column]:
        """The numbers from a column with the prepared vector as an array; -1 where no level holds."""
        found, at = [F.get(vector, F.lit(i)) for i in range(self.numeric)], self.numeric
        for size in self.levels:
            found.append((F.array_position(F.slice(vector, at + 1, size), F.lit(1.0)) - 1).cast("double"))
            at += size
        return found

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """The prepared columns, one below the other, of rows of numbers."""
        found, at = np.zeros((self.numeric + sum(self.levels), len(codes))), self.numeric
        found[: self.numeric] = codes[:, : self.numeric].T
        for i, size in enumerate(self.levels):
            level = codes[:, self.numeric + i].astype(np.int64)
            rows = np.flatnonzero(level >= 0)
            found[at + level[rows], rows] = 1.0
            at += size
        return found


def _of_boosting(model: Boosted, columns: np.ndarray) -> np.ndarray:
    return model.scores(columns.T)


def _of_forest(edges: list[list[float]], trees: list[Tree], columns: np.ndarray) -> np.ndarray:
    return forest_scores(edges, trees, columns.T)


def _of_logistic(weights: np.ndarray, intercept: float, columns: np.ndarray) -> np.ndarray:
    margin = np.zeros(columns.shape[1])
    for weight, column in zip(weights, columns, strict=True):  # alike for equal rows
        margin += weight * column
    return 1 / (1 + np.exp(-(margin + intercept)))


def _array_scores(stage) -> Callable[[np.ndarray], np.ndarray] | None:
    """Scores of prepared columns, one below the other; none for models of other kinds."""
    if isinstance(stage, BoostedModel):
        return partial(_of_boosting, stage.boosted())
    if isinstance(stage, ForestModel):
        return partial(_of_forest, *stage.parts())
    if isinstance(stage, LogisticRegressionModel) and stage.numClasses == 2:
        return partial(_of_logistic, stage.coefficients.toArray(), stage.intercept)
    return None


class CopyScorer(Transformer):
    """Adds ``score``: for each number that a row takes in the place of one of its own (``places``: feature
    times ``repeats`` and repeat, ``numbers``) the score of the row with that number in ``codes``."""

    def __init__(self, model: PipelineModel, coding: Coding, repeats: int):
        super().__init__()
        self.stage, self.coding, self.repeats = model.stages[-1], coding, repeats

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        shared = dataset.sparkSession.sparkContext.broadcast(_array_scores(self.stage))
        coding, repeats = self.coding, self.repeats

        @F.pandas_udf("array<double>")
        def score(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for codes, places, numbers in frames:
                if not len(codes):
                    yield pd.Series([], dtype=object)
                    continue
                own, sizes = np.stack(codes.to_numpy()), np.asarray([len(p) for p in places])
                at, number = np.concatenate(places.to_numpy()) // repeats, np.concatenate(numbers.to_numpy())
                row, found = np.repeat(np.arange(len(own)), sizes), np.empty(len(at))
                for i in range(0, len(at), COPIES_AT_ONCE):
                    part = slice(i, i + COPIES_AT_ONCE)
                    changed = own[row[part]]
                    changed[np.arange(len(changed)), at[part]] = number[part]
                    found[part] = shared.value(coding.matrix(changed))
                yield pd.Series(np.split(found, np.cumsum(sizes)[:-1]), dtype=object)

        return dataset.withColumn("score", score("codes", "places", "numbers"))
