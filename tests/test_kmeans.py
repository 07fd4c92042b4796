"""K-means from several starts against plain NumPy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clientela.operators import clusters, kmeans


def table(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 3, 2)) for c in (0, 3, 7)])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, p array<double>"), x


def assigned(x, centres):
    d = ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_a_pass_serves_all_starts(spark):
    df, x = table(spark)
    sets = {0: [[0.0, 0.0], [5.0, 5.0]], 3: [[1.0, 1.0], [3.0, 3.0], [9.0, 9.0]]}
    rows = kmeans.passes(kmeans.as_columns(df, "p", 2), sets).collect()
    assert len(rows) == 5
    for r in rows:
        label, cost = assigned(x, sets[r["start"]])
        mine = label == r["cluster"]
        assert r["n"] == mine.sum() and r["cost"] == pytest.approx(cost[mine].sum())
        assert [r["x0"], r["x1"]] == pytest.approx(list(x[mine].sum(axis=0)))


def test_fits_cannot_be_bettered_by_moving_centres(spark):
    df, x = table(spark)
    points = kmeans.as_columns(df, "p", 2)
    fits = kmeans.fit_kmeans(points, 2, 3, 4)
    assert len(fits) == 4 and [f.cost for f in fits] == sorted(f.cost for f in fits)
    for fit in fits:
        label, cost = assigned(x, fit.centres)
        assert fit.cost == pytest.approx(cost.sum())
        means = [x[label == j].mean(axis=0) for j in range(3)]
        assert np.abs(np.array(means) - fit.centres).max() < 0.05
    assert fits[0].cost == pytest.approx(2 * 0.16 * 300, rel=0.2)
    again = kmeans.fit_kmeans(points.repartition(5), 2, 3, 4)
    assert [f.cost for f in again] == pytest.approx([f.cost for f in fits])


def test_first_centres_are_distinct_points(spark):
    df, x = table(spark)
    sets = kmeans.first_centres(kmeans.as_columns(df, "p", 2), 2, 3, 5, 42)
    known = {tuple(p) for p in x}
    for centres in sets.values():
        assert len({tuple(c) for c in centres}) == 3 and all(tuple(c) in known for c in centres)
    assert len({tuple(map(tuple, c)) for c in sets.values()}) > 1


def test_fewer_points_than_centres_and_no_rows(spark):
    two = spark.createDataFrame([(1.0,), (1.0,), (4.0,)], "x0 double")
    (fit,) = kmeans.fit_kmeans(two, 1, 3, 1)
    assert sorted(fit.centres) == [[1.0], [4.0]] and fit.cost == 0
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(two.limit(0), 1, 2, 1)


def test_model_takes_the_first_of_equal_centres(spark):
    fit = kmeans.Fit([[0.0], [0.0], [10.0]], 1.0, 1)
    df = spark.createDataFrame([([1.0],), ([9.0],)], "p array<double>").withColumn(
        "features", array_to_vector("p")
    )
    model = kmeans.CentreModel.of(fit)
    assert [r["Cluster"] for r in model.transform(df).orderBy(F.col("p")).collect()] == [0, 2]
    assert (model.getK(), model.trainingCost()) == (3, 1.0)


@pytest.mark.parametrize("block", [7, 1024])
def test_silhouettes_by_brute_force(spark, block):
    df, x = table(spark, 90)
    label = np.arange(90) % 4
    label[label == 3] = 1
    label[5] = 8  # alone
    labelled = df.join(spark.createDataFrame([(i, int(k)) for i, k in enumerate(label)], "id long, k int"), "id")
    got = {r["id"]: r["silhouette"] for r in clusters.silhouettes(labelled, "id", "p", "k", block).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(90):
        same = (label == label[i]) & (np.arange(90) != i)
        a = d[i, same].mean() if same.any() else None
        b = min(d[i, label == k].mean() for k in set(label) if k != label[i])
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))


def test_copies_for_the_silhouette_grow_with_the_rows():
    for size in (0, 1, 5_000, 900_000, 8_000_000):
        blocks = clusters._blocks(size, clusters.BLOCK)
        assert 1 <= blocks <= clusters.MOST_BLOCKS
        assert size <= blocks * clusters.LARGEST_BLOCK
    assert clusters._blocks(40, 7) == 6


def test_partial_passes_add_up_and_keep_blanks(spark):
    rows = [(0.0, 1.0), (4.0, None), (5.0, 1.0), (6.0, 3.0)]
    points = spark.createDataFrame(rows, "x0 double, x1 double").repartition(3)
    sets = {0: [[0.0, 0.0], [5.0, 1.0]]}
    found = {r["cluster"]: r for r in kmeans.passes(points, sets).collect()}
    # A point with a blank coordinate has no distance and stays with the first centre.
    assert (found[0]["n"], found[0]["cost"], found[0]["x0"], found[0]["x1"]) == (2, 1.0, 4.0, 1.0)
    assert (found[1]["n"], found[1]["cost"], found[1]["x0"], found[1]["x1"]) == (2, 5.0, 11.0, 4.0)
    assert kmeans._pass(points, sets) == {(0, 0): [2, 1.0, 4.0, 1.0], (0, 1): [2, 5.0, 11.0, 4.0]}
