import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clientela.functions import scalars as fn
from clientela.operators import concentration as c
from clientela.operators import ordering as o
from clientela.operators import segments as s
from clientela.session import scratch_root, settle
from clientela.sources import dimensions as d
from tests.fixtures import customers_frame, many_customers

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, x double")


# ------------------------------------------------------------------ scalars


def test_rounding_follows_numpy(spark):
    xs = [0.125, 2.675, 1.005, -0.125, 135.125, 1e6 + 0.005]
    got = [r[0] for r in values(spark, xs).select(fn.half_even("x", 2)).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]
    assert got[0] == 0.12


def test_whole_days_round_down(spark):
    row = spark.sql(
        "SELECT TIMESTAMP_NTZ '2018-01-02 00:00:00' AS a, TIMESTAMP_NTZ '2018-01-01 14:00:00' AS b"
    ).select(fn.whole_days("a", "b").alias("minus"), fn.whole_days("b", "a").alias("plus")).first()
    assert (row["minus"], row["plus"]) == (-1, 0)


@pytest.mark.parametrize("latest, closed", [("2018-08-29", "2018-07"), ("2018-08-31", "2018-08"), ("2018-01-15", "2017-12")])
def test_last_closed_month(spark, latest, closed):
    df = spark.range(1).select(fn.month_key(fn.last_closed_month(F.lit(latest).cast("timestamp_ntz"))))
    assert df.first()[0] == closed


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.at_least("x", 0.0)).collect()] == [0.0, 2.0, None]


def test_labels(spark):
    df = spark.createDataFrame([("2018-01",), ("2017-12",)], "m string")
    rows = df.select(fn.month_label_pt("m"), fn.half_year("m")).collect()
    assert [tuple(r) for r in rows] == [("Jan/18", "2018-S1"), ("Dez/17", "2017-S2")]


# ------------------------------------------------------------------ ordering


def hot_frame(spark, n=3000):
    """97 % of the rows share one value."""
    rows = [(f"u{i * 7919 % n:05d}", 1 if i % 100 < 97 else i % 7 + 2) for i in range(n)]
    return spark.createDataFrame(rows, "id string, x int").repartition(6)


def test_ranks_and_running_totals_with_a_hot_value(spark):
    df = hot_frame(spark)
    got = o.with_rank(df, [F.col("x"), F.col("id")], "r", cum=F.col("x")).toPandas()
    want = df.toPandas().sort_values(["x", "id"]).reset_index(drop=True)
    got = got.sort_values("r").reset_index(drop=True)
    assert got["id"].tolist() == want["id"].tolist()
    assert got["r"].tolist() == list(range(1, len(want) + 1))
    assert got["cum"].tolist() == want["x"].cumsum().tolist()
    assert set(got["r_total"]) == {len(want)}


def test_a_hot_value_spreads_over_the_parts(spark):
    df = hot_frame(spark, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid_out, _ = o._lay_out(df, [F.col("x"), F.col("id")], {"r": F.lit(1)}, [])
        sizes = [r["count"] for r in laid_out.groupBy(o.PART).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) >= 3
    assert max(sizes) < 0.4 * 4000


def test_ranks_within_groups(spark):
    df = hot_frame(spark).withColumn("g", F.when(F.col("x") == 1, "hot").otherwise("cold"))
    got = o.with_rank(df, [F.col("x"), F.col("id")], "r", by=["g"]).toPandas()
    want = df.toPandas().sort_values(["g", "x", "id"])
    want["r"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id")
    assert (merged["r_x"] == merged["r_y"]).all()


@FEW
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, xs):
    ps = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    row = o.quantiles(values(spark, xs), "x", ps).first()
    for name, p in ps.items():
        assert row[name] == pytest.approx(float(np.quantile(xs, p)))


def test_quantiles_of_nothing(spark):
    row = o.quantiles(values(spark, [1.0]).where("false"), "x", {"m": 0.5}).first()
    assert row is None or row["m"] is None


def test_sample_does_not_depend_on_layout(spark):
    df = hot_frame(spark)
    one = {r["id"] for r in o.sample_rows(df, "id", 200).collect()}
    two = {r["id"] for r in o.sample_rows(df.repartition(3, "x"), "id", 200).collect()}
    assert one == two and len(one) == 200
    assert o.sample_rows(df, "id", 10_000).count() == df.count()


def test_settled_tables_lie_in_the_shared_folder(spark):
    settled = settle(hot_frame(spark, 50).withColumn("m", F.col("x").cast("decimal(18,2)")))
    assert settled.count() == 50 and dict(settled.dtypes)["m"] == "decimal(18,2)"
    root = scratch_root(spark).rsplit("/", 1)[-1]
    assert all(f"/{root}/" in f for f in settled.inputFiles())


# ------------------------------------------------------------------ bins and scores


@pytest.mark.parametrize("n", [5, 12, 13, 60])
def test_rank_bins_match_pandas(spark, n):
    df = hot_frame(spark, n)
    got = s.rank_bins(df, "x", "id", 5).toPandas().sort_values("id")["bin"].tolist()
    local = df.toPandas().sort_values("id")
    want = pd.qcut(local["x"].rank(method="first"), 5, labels=range(1, 6)).astype(int).tolist()
    assert got == want


def test_plain_ranks_need_one_shuffle(spark):
    df = hot_frame(spark)
    ranked = o.with_rank(df, [F.col("x").desc(), F.col("id")], "r")
    got = ranked.toPandas().sort_values("r").reset_index(drop=True)
    want = df.toPandas().sort_values(["x", "id"], ascending=[False, True]).reset_index(drop=True)
    assert got["id"].tolist() == want["id"].tolist()
    assert got["r"].tolist() == list(range(1, len(want) + 1)) and set(got["r_total"]) == {len(want)}
    assert ranked.columns == [*df.columns, "r", "r_total"]
    # What is read back is joined with one row for each part, and not dealt again.
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan.split("BroadcastExchange")[0]
    assert o.with_rank(df.limit(0), [F.col("x")], "r").collect() == []


def test_rank_bin_sizes(spark):
    df = spark.createDataFrame([(i, i) for i in range(12)], "id int, x int")
    sizes = s.rank_bins(df, "x", "id", 5).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in sizes] == [3, 2, 2, 2, 3]


def test_quantile_bins_match_pandas(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    df = values(spark, xs)
    got = [r["bin"] for r in s.quantile_bins(df, "x", 3).orderBy("id").collect()]
    assert got == pd.qcut(pd.Series(xs), 3, labels=[1, 2, 3]).astype(int).tolist()


def test_equal_edges_are_an_error(spark):
    df = values(spark, [1] * 8 + [2, 3])
    with pytest.raises(ValueError, match="not unique"):
        s.quantile_bins(df, "x", 5)
    merged = s.quantile_bins(df, "x", 5, duplicates="merge")
    assert merged.select("bin").distinct().count() == 2


def test_scores(spark):
    scored = s.rfm_scores(many_customers(spark)).toPandas()
    for name in ("R_score", "F_score", "M_score"):
        assert scored[name].between(1, 5).all()
    assert (scored["RFM_score"] == scored[["R_score", "F_score", "M_score"]].sum(axis=1)).all()
    assert scored["RFM_bucket"].str.len().eq(3).all()
    assert scored.sort_values("Recency")["R_score"].iloc[0] == 5
    with pytest.raises(ValueError, match="Frequency"):
        s.rfm_scores(many_customers(spark).drop("Frequency"))


@pytest.mark.parametrize(
    "r, f, m, name",
    [(4, 4, 4, "Champions"), (5, 3, 3, "Loyal Customers"), (4, 2, 5, "Big Spenders (New/Occasional)"),
     (5, 1, 1, "New Customers"), (3, 2, 1, "Potential Loyalists"), (1, 5, 1, "At Risk"),
     (1, 1, 1, "Lost"), (2, 3, 3, "Others"), (2, 1, 4, "At Risk")],
)
def test_segment_rules(spark, r, f, m, name):
    assert spark.range(1).select(s.rfm_segment(F.lit(r), F.lit(f), F.lit(m))).first()[0] == name


def test_strategic_segments(spark):
    people = customers_frame(
        spark, [("a", 10, 1, 60), ("b", 60, 1, 20), ("c", 120, 1, 15), ("d", 400, 1, 5)]
    )
    rows = {r["customer_unique_id"]: r for r in s.strategic_segments(people).collect()}
    assert rows["a"]["cum_revenue_pct"] == pytest.approx(0.6)
    assert rows["a"]["Revenue_segment"] == "Base"  # the share includes the customer itself
    assert rows["d"]["cum_revenue_pct"] == pytest.approx(1.0)
    assert [rows[k]["Recency_segment"] for k in "abcd"] == ["Ativo", "Recente", "Morno", "Em Risco"]
    assert rows["b"]["Strategic_segment"] == "Base - Recente"


def test_revenue_segment_order(spark):
    people = customers_frame(spark, [(f"u{i:03d}", 1, 1, 1000 - i) for i in range(200)])
    local = s.strategic_segments(people).toPandas().sort_values("cum_revenue_pct")
    want = ["Elite (Top 5%)", "High Value (Next 10%)", "Mid Value (Next 20%)", "Base"]
    assert local["Revenue_segment"].drop_duplicates().tolist() == want
    assert local["Monetary"].is_monotonic_decreasing


def test_lifetime_value(spark):
    people = customers_frame(spark, [("a", 1, 2, 200)])
    row = s.lifetime_value(people).first()
    assert row["CLV_12m"] == 100.0 and row["Freq_Mensal"] == pytest.approx(2 / 24)


def four_clusters(spark, ids=(0, 1, 2, 3)):
    risk, champion, spender, new = ids
    rows = []
    for cluster, (n, r, f, m) in zip(
        (risk, champion, spender, new),
        [(50, 400, 1, 120), (50, 40, 5, 600), (100, 100, 1, 900), (80, 60, 1, 60)],
    ):
        rows += [(f"u{cluster}-{i}", r + i % 7, f, float(m + i), cluster) for i in range(n)]
    return spark.createDataFrame(
        rows, "customer_unique_id string, Recency int, Frequency int, Monetary double, Cluster int"
    )


@pytest.mark.parametrize("ids", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_cluster_names_do_not_depend_on_ids(spark, ids):
    names = s.cluster_names(four_clusters(spark, ids))
    want = [d.AT_RISK, d.CHAMPIONS, d.BIG_SPENDERS, d.NEW_OCCASIONAL]
    assert [names[i] for i in ids] == want


def test_unnamed_cluster(spark):
    people = four_clusters(spark, (0, 1, 2, 99))
    with pytest.raises(PySparkException, match="no name for cluster 99"):
        s.assign_cluster_names(people, {0: "a", 1: "b", 2: "c"}).collect()


def test_other_numbers_of_clusters_warn(spark):
    three = four_clusters(spark).where("Cluster < 3")
    with pytest.warns(UserWarning, match="4 clusters"):
        assert len(set(s.cluster_names(three).values())) == 3


# ------------------------------------------------------------------ concentration


@pytest.mark.parametrize("xs, want", [([10] * 4, 0.0), ([0, 0, 0, 0, 100], 0.8), ([0, 0, 0], 0.0)])
def test_gini(spark, xs, want):
    assert c.gini(values(spark, xs), "x").first()[0] == pytest.approx(want)


def test_gini_of_nothing(spark):
    assert c.gini(values(spark, [1.0]).where("false"), "x").first()[0] == 0.0


def test_lorenz_curve(spark):
    points = c.lorenz_curve(values(spark, [40, 10, 30, 20]), "x", "id").orderBy("ordem").collect()
    assert [r["cumulative_monetary_pct"] for r in points] == pytest.approx([10, 30, 60, 100])
    assert points[-1]["cumulative_customers_pct"] == 100.0


def test_lorenz_points(spark):
    df = values(spark, [1000] + [10] * 99)
    rows = c.lorenz_points(df, "x", 50).collect()
    xs, ys = [r["pct_clientes"] for r in rows], [r["pct_receita"] for r in rows]
    assert (xs[0], ys[0], xs[-1], ys[-1]) == (0.0, 0.0, 1.0, 1.0)
    assert xs == sorted(xs) and ys == sorted(ys)
    assert all(y >= x - 1e-9 for x, y in zip(xs, ys))
    assert [r["ordem"] for r in rows] == list(range(len(rows)))
    assert [tuple(r) for r in c.lorenz_points(values(spark, [0, 0]), "x").collect()] == [
        (0, 0.0, 0.0), (1, 1.0, 1.0)]
    near = c.nearest_point(c.lorenz_points(df, "x", 50)).first()
    assert abs(near["pct_clientes"] - 0.2) <= 0.02


def test_top_shares(spark):
    df = values(spark, [50, 20, 20, 5, 5])
    cut = c.top_share(df, "x", 0.4).first()
    assert (cut["n_clientes_no_top"], cut["receita_no_top"]) == (2, 70.0)
    assert cut["pct_receita_concentrada"] == 0.7
    assert c.top_share_with_ties(df, "x", 0.4).first()["receita_top"] == 90.0


def test_dense_retention_has_empty_months(spark):
    from clientela.operators import rfm

    cohort = spark.createDataFrame(
        [("2018-01", 0, 10, 10), ("2018-01", 2, 3, 10), ("2018-03", 0, 5, 5), ("2018-02", 0, 4, 4)],
        "Safra string, MesIndice int, Clientes_Retidos bigint, Tamanho_Safra bigint",
    )
    dense = rfm.dense_retention(cohort)
    cells = {(r["Safra"], r["MesIndice"]): r["Clientes_Retidos"] for r in dense.collect()}
    assert cells == {
        ("2018-01", 0): 10, ("2018-01", 1): 0, ("2018-01", 2): 3,
        ("2018-02", 0): 4, ("2018-02", 1): 0, ("2018-03", 0): 5,
    }
    by = {r["MesIndice"]: r["Retencao"] for r in rfm.weighted_retention(dense, "MesIndice").collect()}
    assert by == {0: 1.0, 1: 0.0, 2: 0.3}
