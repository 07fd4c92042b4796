import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientela.functions import probability as p
from clientela.functions import tails as t
from clientela.operators import distributions as ds
from clientela.operators import hypothesis as h


def grouped(spark, groups):
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g string, x double")


def tails(spark, rows, tail):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(len(rows[0]))))
    found = df.select("*", tail(*[F.col(c) for c in df.columns]).alias("p")).collect()
    by = {tuple(r)[:-1]: r["p"] for r in found}
    return [by[tuple(map(float, r))] for r in rows]


def test_f_and_chi_square_tails_against_tables(spark):
    f = tails(spark, [(4.06618, 3, 8), (2.9957, 2, 1e9), (500, 3, 1000), (0, 3, 8), (161.4476, 1, 1), (1.0, 40, 40)], t.f_tail)
    assert f[0] == pytest.approx(0.05, abs=1e-5) and f[1] == pytest.approx(0.05, abs=1e-4)
    assert 0 < f[2] < 1e-100 and f[3] == 1.0
    assert f[4] == pytest.approx(0.05, abs=1e-6) and f[5] == pytest.approx(0.5, abs=1e-12)
    chi = tails(spark, [(3.841459, 1), (18.30704, 10), (0.5, 3), (0, 4), (1074.679, 1000), (9.21034037, 2), (900.0, 2)], t.chi2_tail)
    want = [0.05, 0.05, 0.9188914, 1.0, 0.05, 0.01]
    assert chi[:6] == pytest.approx(want, abs=2e-6)
    assert chi[6] == pytest.approx(math.exp(-450), rel=1e-9)


def test_tails_without_a_statistic_are_null(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0)], "x double, a double, b double")
    row = df.select(t.f_tail(F.col("x"), F.col("a"), F.col("b")), t.chi2_tail(F.col("x"), F.col("a"))).first()
    assert tuple(row) == (None, None)


def test_log_gamma(spark):
    values = [0.5, 1.0, 2.5, 10.0, 1e3, 1e7]
    got = [r["g"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(t.log_gamma(F.col("v")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-12)


def test_normal_distribution():
    z = np.linspace(-39, 39, 1001)
    assert p.normal_cdf(z) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-9, abs=1e-15)


def test_studentized_range_against_tables():
    assert p.studentized_range_critical(0.05, 3, 10.0) == pytest.approx(3.877, abs=2e-3)
    assert p.studentized_range_critical(0.05, 4, 20.0) == pytest.approx(3.958, abs=2e-3)
    assert p.studentized_range_critical(0.01, 5, 60.0) == pytest.approx(4.818, abs=3e-3)
    found = p.studentized_range_tails(np.array([0.0, -1.0, 3.877, np.nan]), 3, 10.0)
    assert list(found[:2]) == [1.0, 1.0] and found[2] == pytest.approx(0.05, abs=1e-4) and np.isnan(found[3])


def test_two_thousand_groups(spark):
    rng = np.random.default_rng(4)
    local = pd.DataFrame({"g": np.repeat(np.arange(2000), 4), "x": rng.integers(0, 50, 8000).astype(float)})
    df = spark.createDataFrame(local)
    row = h.kruskal(df, "g", ["x"]).first()
    local["r"] = local["x"].rank()
    sums = local.groupby("g")["r"].agg(["sum", "count"])
    n, ties = len(local), local["x"].value_counts()
    stat = 12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["count"]).sum() - 3 * (n + 1)
    stat /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert row["h_stat"] == pytest.approx(stat) and row["df"] == 1999 and 0 < row["p_value"] < 1
    few = df.where("g < 40")
    pairs = h.tukey(few, "g", ["x"]).collect()
    means = local[local["g"] < 40].groupby("g")["x"].mean()
    assert len(pairs) == 40 * 39 // 2
    for r in pairs:
        assert r["meandiff"] == pytest.approx(means[int(r["group2"])] - means[int(r["group1"])])
        assert r["reject"] == (r["p_adj"] < 0.05)


def test_nothing_is_collected_for_a_test():
    import inspect

    assert "collect()" not in inspect.getsource(h)


def test_anova_by_hand(spark):
    df = grouped(spark, {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]})
    row = h.anova(df, "g", ["x"]).first()
    assert (row["f_stat"], row["df_between"], row["df_within"]) == (pytest.approx(13.0), 2, 6)
    assert row["p_value"] == pytest.approx(0.00659, abs=1e-4)


def test_kruskal_with_ties(spark):
    groups = {"a": [1, 1, 2, 3], "b": [2, 3, 3, 5], "c": [4, 5, 6, 6]}
    row = h.kruskal(grouped(spark, groups), "g", ["x"]).first()
    local = pd.DataFrame([(g, x) for g, xs in groups.items() for x in xs], columns=["g", "x"])
    local["r"] = local["x"].rank()
    n = len(local)
    sums = local.groupby("g")["r"].agg(["sum", "count"])
    stat = 12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["count"]).sum() - 3 * (n + 1)
    ties = local["x"].value_counts()
    stat /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert row["h_stat"] == pytest.approx(stat) and row["df"] == 2


def test_tukey(spark):
    df = grouped(spark, {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]})
    rows = {(r["group1"], r["group2"]): r for r in h.tukey(df, "g", ["x"]).collect()}
    assert rows["a", "c"]["meandiff"] == 4.0 and rows["a", "c"]["reject"]
    assert not rows["a", "b"]["reject"]
    assert rows["a", "b"]["p_adj"] == pytest.approx(0.4827, abs=1e-3)  # 4 million random draws
    assert rows["a", "c"]["lower"] == pytest.approx(4 - 4.339 / 3**0.5, abs=5e-3)


def test_chi_square(spark):
    cells = {("r1", "a"): 10, ("r1", "b"): 20, ("r1", "c"): 30, ("r2", "a"): 6, ("r2", "b"): 9, ("r2", "c"): 17}
    rows = [k for k, n in cells.items() for _ in range(n)]
    got = h.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    assert (got["chi2"], got["df"]) == (pytest.approx(0.27157, abs=1e-4), 2)
    assert got["p_value"] == pytest.approx(0.87303, abs=1e-4)


def test_chi_square_two_by_two_is_corrected(spark):
    rows = [("x", "a")] * 12 + [("x", "b")] * 5 + [("y", "a")] * 4 + [("y", "b")] * 9
    got = h.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[12, 5], [4, 9]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert got["chi2"] == pytest.approx((((abs(o - e) - 0.5) ** 2) / e).sum())


def test_describe(spark):
    xs = [1, 2, 4, 8, 16, 3]
    row = ds.describe(grouped(spark, {"a": xs}), ["x"]).first()
    s = pd.Series(xs)
    assert row["skew"] == pytest.approx(s.skew()) == pytest.approx(1.600262, abs=1e-5)
    assert row["std"] == pytest.approx(s.std()) and row["median"] == 3.5
    assert row["p95"] == pytest.approx(s.quantile(0.95))


def test_histogram_counts_every_row(spark):
    xs = list(range(100)) + [99.0]
    bars = ds.histogram(grouped(spark, {"a": xs}), "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(xs, 10)
    assert [b["n"] for b in bars] == counts.tolist()
    assert bars[0]["low"] == 0 and bars[-1]["high"] == pytest.approx(99)


def test_crosstab_and_shares(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", None)], "r string, c string")
    rows = {r["r"]: (r["a"], r["b"]) for r in ds.crosstab(df, "r", "c").collect()}
    assert rows == {"x": (1, 1), "y": (1, 0)}


def test_correlation(spark):
    rng = np.random.default_rng(1)
    local = pd.DataFrame(rng.normal(size=(50, 3)), columns=["a", "b", "c"])
    got = ds.correlation_matrix(spark.createDataFrame(local), ["a", "b", "c"]).toPandas()
    want = local.corr()
    assert np.allclose(got.set_index("metric").loc[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_rank_score_shares_ranks_among_equals(spark):
    profile = spark.createDataFrame(
        [(0, 10.0, 1.0, 5.0), (1, 10.0, 2.0, 4.0), (2, 30.0, 3.0, 6.0)],
        "Cluster int, R_mean double, F_mean double, M_mean double",
    )
    rows = {r["Cluster"]: r for r in ds.rank_score(profile).collect()}
    assert rows[0]["R_rank"] == rows[1]["R_rank"] == 1.5
    assert rows[2]["Score"] == 3 + 1 + 1
