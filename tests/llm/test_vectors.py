"""Whitening against NumPy, in one panel and in several, and its results at the edges."""

import numpy as np
import pytest

from clientela.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, __at long, panel int"


def expected(vectors, components):
    """Components, deviations and explained shares by the plain formulas."""
    x = np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    share = values / np.trace(centred.T @ centred / n)
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - sums]
    return (n * x - sums) / n @ axes / np.sqrt(values), deviation, share, n


@pytest.mark.parametrize("panel_bytes", [whitening.PANEL_BYTES, 8 * 6 * 100])
def test_whitened_as_by_numpy(spark, monkeypatch, panel_bytes):
    monkeypatch.setattr(whitening, "PANEL_BYTES", panel_bytes)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    vectors = np.concatenate([vectors, np.tile(vectors[:1], (150, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in row], "x", 5, 6) for i, row in enumerate(vectors)]
    rows += [(900, None, None, None, None), (901, [1.0, None] * 3, "x", 1, 1)]
    rows += [(902, [float("nan")] * 6, "x", 1, 1), (903, [float("inf")] * 6, "x", 1, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=4).toPandas()
    z, deviation, share, n = expected(vectors, 4)
    assert len(found) == 450 * 4 and n == 300 and set(found["n"]) == {300}
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got * sign - z).max() < 1e-9
    first = found[found["component"] == 1].sort_values("vec_id")
    assert list(first["deviation"]) == deviation
    by_component = found.groupby("component")["explained"].first().to_numpy()
    assert np.abs(by_component / share - 1).max() < 1e-9
    assert found["identity_error"].max() < 1e-9 and found["identity_error"].nunique() == 1


def test_vectors_at_the_edges(spark):
    def whiten(rows):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()

    extra = ("x", 0, 0)
    assert whiten([]) == []
    assert whiten([(1, None, *extra), (2, [], *extra)]) == []
    assert whiten([(1, [1.0, 2.0], *extra)] * 3) == []  # all equal: nothing to scale by
    # One dimension alone varies; null and repeated ids keep their rows.
    rows = whiten([(None, [0.0, 1.0], *extra), (None, [2.0, 1.0], *extra), (3, [2.0], *extra)])
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1), (3, 2)]
    rows = whiten([(7, [0.0, 1.0], *extra), (7, [2.0, 1.0], *extra)])
    assert sorted(round(r["whitened"], 9) ** 2 for r in rows) == [1.0, 1.0]
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["explained"]) for r in rows} == {
        (7, 1, 2, 128**2, 1.0)
    }
    # Entries too large for whole numbers of 52 bits count as the bound; no exact deviation then.
    rows = whiten([(1, [1e30], *extra), (2, [-1e30], *extra), (3, [0.0], *extra)])
    assert [r["deviation"] for r in rows if r["vec_id"] == 1] == [None]
    assert len(rows) == 3
