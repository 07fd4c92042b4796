import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clientela.learning import features, metrics, models, oversampling, splits, training
from clientela.operators import clusters
from tests.fixtures import day, many_customers, order_tables


def labelled(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (1.5 * x1 - x2 + rng.normal(scale=0.5, size=n) > 0.8).astype(int)
    g = rng.choice(["a", "b", "c"], n)
    rows = [(i, float(x1[i]) if i % 20 else None, float(x2[i]), str(g[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, g string, y int")


FEATURES = models.Features("id", ["x1", "x2"], ["g"])
FAMILY = models.candidates(
    "id",
    {"trees": 5, "depth": 3, "least_rows": 3},
    {"iterations": 3, "depth": 2, "step": 0.1},
    with_oversampling=True,
)


# ------------------------------------------------------------------ clusters


def test_cluster_features(spark):
    row = clusters.cluster_features(many_customers(spark, 3)).first()
    assert row["Frequency_log"] == pytest.approx(np.log1p(row["Frequency"]))
    assert row["Monetary_log"] == pytest.approx(np.log1p(row["Monetary"]))


def test_fit_predict_save(spark, tmp_path):
    people = many_customers(spark, 80)
    model = clusters.fit_clusters(people, restarts=2)
    found = clusters.predict_clusters(people, model)
    assert "features" not in found.columns
    assert 2 <= found.select("Cluster").distinct().count() <= 4
    info = clusters.clustering_metadata(people, model, "2018-09-04", "2018-09-05", restarts=2)
    clusters.save_model(model, info, str(tmp_path))
    again, stored = clusters.load_model(spark, str(tmp_path))
    assert stored.first()["n_samples"] == 80
    same = clusters.predict_clusters(people, again)
    assert found.exceptAll(same).isEmpty()


def test_silhouette_by_brute_force(spark):
    people = many_customers(spark, 60)
    model = clusters.fit_clusters(people, k=3, restarts=1)
    rows = model.transform(people)
    got = clusters.silhouette(rows, "customer_unique_id")
    local = rows.select(vector_to_array("features").alias("p"), "Cluster").toPandas()
    x, label = np.array(local["p"].tolist()), local["Cluster"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, label == k].mean() for k in set(label) if k != label[i])
        scores.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(scores))


def test_elbow(spark):
    table = clusters.elbow(many_customers(spark, 50), ks=(2, 3), restarts=1).collect()
    assert [r["K"] for r in table] == [2, 3]
    assert table[0]["Inertia"] > table[1]["Inertia"] > 0
    assert all(-1 <= r["Silhouette"] <= 1 for r in table)


def test_pca(spark):
    projected, shares = clusters.pca_2d(many_customers(spark, 40))
    assert projected.columns == ["customer_unique_id", "PC1", "PC2"]
    assert 0.5 < sum(shares) <= 1.0 and shares[0] >= shares[1]


# ------------------------------------------------------------------ features


def test_review_features(spark):
    tables = order_tables(spark)
    orders = tables.orders.withColumns(
        {
            "order_delivered_customer_date": F.col("order_purchase_timestamp")
            + F.expr("INTERVAL 10 DAYS"),
            "order_estimated_delivery_date": F.col("order_purchase_timestamp")
            + F.expr("INTERVAL 9 DAYS 10 HOURS"),
        }
    )
    late = orders.withColumn(
        "order_delivered_customer_date",
        F.when(F.col("order_id") != "o3", F.col("order_delivered_customer_date")),
    )
    items = tables.order_items.withColumn("freight_value", F.lit(10.0))
    payments = tables.payments.withColumn("payment_installments", F.lit(3))
    products = spark.createDataFrame([("p1", "toys")], "product_id string, product_category_name string")
    names = spark.createDataFrame(
        [("toys", "toys")], "product_category_name string, product_category_name_english string"
    )
    full = tables.with_(
        orders=late, order_items=items, payments=payments, products=products,
        category_translation=names,
        reviews=tables.reviews.withColumn("review_score", F.lit(2)),
    )
    rows = {r["order_id"]: r for r in features.review_features(full).collect()}
    assert set(rows) == {"o1", "o2"}  # o3 has no delivery date
    o1 = rows["o1"]
    assert (o1["atraso_dias"], o1["atrasou"], o1["tempo_entrega_dias"]) == (0.0, 0.0, 10.0)
    assert (o1["freight_ratio"], o1["cat"], rows["o2"]["cat"]) == (0.1, "toys", "desconhecida")
    assert o1["y"] == 1


def test_first_order_by_column_and_by_row(spark):
    orders = spark.createDataFrame(
        [("u", "o1", day("2018-01-01"), None), ("u", "o2", day("2018-02-01"), 7.0)],
        "customer_unique_id string, order_id string, order_purchase_timestamp timestamp_ntz, "
        "review_score double",
    )
    column = features.first_order_per_customer(orders, "column").first()
    row = features.first_order_per_customer(orders, "row").first()
    assert (column["order_id"], column["review_score"], column["n_orders"]) == ("o1", 7.0, 2)
    assert (row["order_id"], row["review_score"]) == ("o1", None)


# ------------------------------------------------------------------ splits and metrics


def test_split_keeps_class_shares(spark):
    df = labelled(spark)
    train, test = splits.stratified_split(df, "id", "y")
    assert train.count() + test.count() == 240
    assert train.join(test, "id").isEmpty()
    size = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    held = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert all(abs(held[y] - 0.2 * size[y]) <= 0.5 for y in size)


def test_folds(spark):
    counts = splits.stratified_folds(labelled(spark), "id", "y").groupBy("fold", "y").count()
    local = counts.toPandas()
    assert sorted(local["fold"].unique()) == [0, 1, 2, 3, 4]
    assert (local.groupby("y")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


def scored_frame(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    score = np.round(np.clip(0.3 * y + rng.uniform(0, 0.7, n), 0, 1), 1)
    rows = [(i, int(y[i]), float(score[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y int, score double"), y, score


def brute_force_curve(y, score):
    thresholds = sorted(set(score), reverse=True)
    return [((score >= t) & (y == 1)).sum() for t in thresholds], [
        (score >= t).sum() for t in thresholds], thresholds


def test_ranking_metrics_by_brute_force(spark):
    df, y, score = scored_frame(spark)
    row = metrics.ranking_metrics(df).first()
    tp, flagged, _ = brute_force_curve(y, score)
    recall = np.array([0, *tp]) / y.sum()
    ap = (np.diff(recall) * np.array(tp) / np.array(flagged)).sum()
    assert row["average_precision"] == pytest.approx(ap)
    pos, neg = score[y == 1], score[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert row["roc_auc"] == pytest.approx(auc)


def test_best_threshold_by_brute_force(spark):
    df, y, score = scored_frame(spark)
    tp, flagged, thresholds = brute_force_curve(y, score)
    f1 = [2 * a / (b + y.sum()) for a, b in zip(tp, flagged)]
    row = metrics.best_threshold(df).first()
    assert row["f1"] == pytest.approx(max(f1))
    assert row["threshold"] == min(t for t, f in zip(thresholds, f1) if f == max(f1))


def test_classification_metrics(spark):
    df, y, score = scored_frame(spark)
    row = metrics.classification_metrics(df, 0.5).first()
    flagged = score >= 0.5
    assert row["tp"] == (flagged & (y == 1)).sum()
    assert row["accuracy"] == pytest.approx((flagged == (y == 1)).mean())
    none = metrics.classification_metrics(df, 2.0).first()
    assert (none["f1"], none["precision"], none["recall"]) == (0.0, 0.0, 0.0)


def test_metrics_per_group(spark):
    df, _, _ = scored_frame(spark)
    by = df.withColumn("m", (F.col("id") % 2).cast("string"))
    both = {r["m"]: r for r in metrics.ranking_metrics(by, ["m"]).collect()}
    one = metrics.ranking_metrics(by.where("m = '1'")).first()
    assert both["1"]["average_precision"] == pytest.approx(one["average_precision"])
    assert both["1"]["roc_auc"] == pytest.approx(one["roc_auc"])


def test_lift(spark):
    df, y, score = scored_frame(spark)
    row = metrics.lift(df, "id").where("k = 30").first()
    order = np.lexsort((np.arange(len(y)), -score))[:30]
    assert row["rate"] == pytest.approx(y[order].mean())
    assert row["captured"] == pytest.approx(y[order].sum() / y.sum())
    assert row["lift"] == pytest.approx(y[order].mean() / y.mean())


# ------------------------------------------------------------------ models


def test_rare_and_unknown_levels(spark):
    rows = [(i, 1.0, 2.0, "a" if i < 150 else "b" if i < 299 else "rare", i % 2) for i in range(300)]
    train = spark.createDataFrame(rows, "id int, x1 double, x2 double, g string, y int")
    preparation = models.fit_preprocessing(train, FEATURES)
    probe = spark.createDataFrame(
        [(1, 1.0, 2.0, "rare", 0), (2, 1.0, 2.0, "new", 0), (3, None, 2.0, "a", 0)],
        "id int, x1 double, x2 double, g string, y int",
    )
    vectors = preparation.transform(probe).orderBy("id").select(vector_to_array("features")).collect()
    assert vectors[0][0] == vectors[1][0]
    # Two numbers, the levels a, b, and one place for all others.
    assert len(vectors[2][0]) == 2 + 3 and not np.isnan(vectors[2][0]).any()


def test_balanced_weights(spark):
    weighted = models.balanced(labelled(spark))
    sums = [r[1] for r in weighted.groupBy("y").agg(F.sum("weight")).collect()]
    assert sums[0] == pytest.approx(sums[1]) == pytest.approx(120)


def test_oversampling_balances(spark):
    df = labelled(spark)
    prepared = models.fit_preprocessing(df, FEATURES).transform(df).select("id", "y", "features")
    more = oversampling.oversample(prepared, "id").cache()
    sizes = {r["y"]: r["count"] for r in more.groupBy("y").count().collect()}
    assert sizes[0] == sizes[1] == df.where("y = 0").count()


def test_new_rows_lie_between_neighbours(spark):
    df = labelled(spark)
    prepared = models.fit_preprocessing(df, FEATURES).transform(df).select("id", "y", "features")
    old = np.array([r["p"] for r in oversampling.minority_points(prepared, "id", 1).collect()])
    d = np.sqrt(((old[:, None] - old[None]) ** 2).sum(-1))
    nearest = np.argsort(d, axis=1)[:, 1:6]
    more = oversampling.oversample(prepared, "id").where("y = 1")
    points = [r["p"] for r in more.select(vector_to_array("features").alias("p")).collect()]
    made = [p for p in np.array(points) if np.abs(old - p).sum(axis=1).min() > 1e-12]
    for p in made:
        a = old[:, None, :].repeat(5, axis=1)
        b = old[nearest]
        length = np.sqrt(((b - a) ** 2).sum(-1))
        around = np.sqrt(((a - p) ** 2).sum(-1)) + np.sqrt(((b - p) ** 2).sum(-1))
        assert np.abs(around - length).min() < 1e-9


def test_selection_rule(spark):
    results = spark.createDataFrame(
        [("baseline", 0.99, 0.0), ("a", 0.50, 0.0), ("b", 0.52, 0.20)],
        "model string, f1_cv double, overfit_gap double",
    )
    assert training.select_best(results) == "a"


def test_whole_protocol(spark, tmp_path):
    df = labelled(spark)
    family = [c for c in FAMILY if c.name != "boosting"]
    model, threshold, report = training.train_model(df, family, FEATURES, "test", folds=2)
    assert report["best_model"] != "baseline" and 0 <= threshold <= 1
    assert set(report["cv_results"]) == {c.name for c in family}
    assert report["test"]["roc_auc"] > 0.8
    assert report["top_features"][0]["feature"] in ("x1", "x2")
    training.save_artifacts(spark, model, report, threshold, str(tmp_path))
    again, stored = training.load_artifacts(spark, str(tmp_path))
    assert stored["threshold"] == threshold
    states = training.score_batch(again, df.withColumn("customer_state", F.col("g")), threshold)
    assert sum(r["Pedidos"] for r in states.collect()) == 240


def test_boosting_fits(spark):
    df = labelled(spark)
    (candidate,) = [c for c in FAMILY if c.name == "boosting"]
    scores = models.scored(models.fit(candidate, df, FEATURES), df)
    assert metrics.ranking_metrics(scores).first()["roc_auc"] > 0.8


def test_baseline_scores_are_constant(spark):
    df = labelled(spark)
    scores = models.scored(models.fit(FAMILY[0], df, FEATURES), df)
    assert [r[0] for r in scores.select("score").distinct().collect()] == [0.0]


def test_preparations_of_folds_leave_the_fold_out(spark):
    rng = np.random.default_rng(2)
    rows = [
        (i, None if i % 11 == 0 else float(rng.integers(0, 30)), float(rng.normal()) * (1 + i % 3),
         ["a", "b", "c", None][int(rng.integers(0, 4))] if i % 50 else f"only{i}", i % 2, i % 3)
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, g string, y int, fold int")
    found = models.fit_preparations(df, FEATURES, "fold")
    assert set(found) == {None, 0, 1, 2}
    for held_out, preparation in found.items():
        others = df if held_out is None else df.where(F.col("fold") != held_out)
        alone = models.fit_preprocessing(others, FEATURES)
        a, b = (
            np.array([r[0] for r in p.transform(df).orderBy("id").select(vector_to_array("features")).collect()])
            for p in (preparation, alone)
        )
        assert a.shape == b.shape and np.abs(a - b).max() < 1e-9
        local = others.toPandas()
        filled = local["x1"].fillna(local["x1"].median())
        want = (df.toPandas().sort_values("id")["x1"].fillna(local["x1"].median()) - filled.mean()) / filled.std(ddof=0)
        assert np.abs(a[:, 0] - want.to_numpy()).max() < 1e-9


def test_threshold_and_metrics_come_from_the_same_models(spark):
    df = splits.stratified_folds(labelled(spark), "id", "y", folds=3).cache()
    family = [c for c in FAMILY if c.name in ("baseline", "logistic")]
    scores = training.fold_scores(df, family, FEATURES)
    assert scores.count() == 2 * 3 * 240
    held_out = scores.where("part = 'test' AND model = 'logistic'")
    assert held_out.select("id").distinct().count() == 240 == held_out.count()
    assert training.threshold_of(held_out) == training.tune_threshold(df, family[1], FEATURES)
    table = training.cross_validate(df, family, FEATURES).collect()
    assert [r["model"] for r in table] == ["baseline", "logistic"]
    assert table[1]["f1_cv"] > 0.6 and table[0]["f1_cv"] == 0


def test_donors_are_permutations(spark):
    ids = spark.range(50).select(F.col("id"))
    rows = training.permutation_donors(ids, "id", ["a", "b"], 3, 1).collect()
    by = {}
    for r in rows:
        by.setdefault((r["feature"], r["repeat"]), {})[r["id"]] = r["donor"]
    assert len(by) == 6
    assert all(sorted(m) == sorted(m.values()) == list(range(50)) for m in by.values())
    assert len({tuple(sorted(m.items())) for m in by.values()}) == 6


def test_items_are_sent_once_and_counted_apart(spark):
    rows = [("o1", 1, "p1", "s1", 10.0, 1.0), ("o1", 2, "p1", "s2", 30.0, None), ("o1", 2, "p1", "s2", 30.0, None),
            ("o2", None, None, None, None, None), (None, 1, "p1", "s1", 1.0, 1.0)]
    items = spark.createDataFrame(
        rows, "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double"
    )
    made = features.item_features(items, with_product=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1
    found = {r["order_id"]: r.asDict() for r in made.collect()}
    assert set(found) == {"o1", "o2"}
    one = found["o1"]
    assert (float(one["price_total"]), float(one["freight_total"]), one["n_items"]) == (70.0, 1.0, 3)
    assert (one["n_sellers"], one["n_products"], one["product_id"]) == (2, 1, "p1")
    assert (found["o2"]["n_items"], found["o2"]["n_sellers"], found["o2"]["n_products"]) == (0, 0, 0)


def test_importance_as_from_donors_joined_feature_by_feature(spark, monkeypatch):
    """Each feature was once joined and scored by itself, with all other columns sent along."""
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i % 3), "abc"[i % 3], int(i % 7 > 3)) for i in range(60)]
    rows += [(3, 9.0, 1.0, "z", 1), (3, 3.0, None, None, 0)]  # an id may repeat
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y int")
    wanted = models.Features("id", ["a", "b"], ["c"])
    model = models.fit(models.review_candidates()[1], df, wanted)
    calls, plain = [], training.scored
    monkeypatch.setattr(training, "scored", lambda *args: calls.append(1) or plain(*args))
    found = {r["feature"]: r["importance"] for r in training.permutation_importance(model, df, wanted, repeats=2).collect()}
    assert len(calls) == 2
    whole = metrics.ranking_metrics(plain(model, df)).first()["average_precision"]
    donors = training.permutation_donors(df.select("id"), "id", ["a", "b", "c"], 2, 42)
    for name in ("a", "b", "c"):
        taken = donors.where(F.col("feature") == name).select("id", "repeat", "donor")
        values = df.select(F.col("id").alias("donor"), name)
        changed = df.drop(name).join(taken, "id").join(values, "donor").drop("donor")
        each = metrics.ranking_metrics(plain(model, changed), ["repeat"]).collect()
        want = whole - sum(r["average_precision"] for r in each) / 2
        assert abs(found[name] - want) < 1e-9


def test_the_threshold_needs_no_score_of_training_rows(spark, monkeypatch):
    df = splits.stratified_folds(labelled(spark, 80), "id", "y", folds=3)
    family, counts, plain = models.review_candidates(), [], training.scored
    monkeypatch.setattr(training, "scored", lambda m, d: counts.append(d.count()) or plain(m, d))
    found = training.tune_threshold(df, family[0], FEATURES)
    assert sum(counts) == 80
    monkeypatch.setattr(training, "scored", plain)
    every = training.fold_scores(df, [family[0]], FEATURES)
    assert every.count() == 240 and found == training.threshold_of(every.where("part = 'test'"))


@pytest.mark.parametrize("place", [1, 2, 3])
def test_importance_by_codes_is_that_of_copies_scored_one_by_one(spark, monkeypatch, place):
    df = labelled(spark, 150).withColumn("g", F.when(F.col("id") % 11 > 0, F.col("g")))
    model = models.fit(FAMILY[place], df, FEATURES)
    assert models.Coding.of(model, FEATURES) is not None
    monkeypatch.setattr(training, "CURVE_PART", 40)
    found = training.permutation_importance(model, df, FEATURES, repeats=2).collect()
    monkeypatch.setattr(training.Coding, "of", lambda *_: None)
    want = training.permutation_importance(model, df, FEATURES, repeats=2).collect()
    assert {r["feature"] for r in found} == {r["feature"] for r in want} == {"x1", "x2", "g"}
    by = {r["feature"]: r["importance"] for r in want}
    assert all(r["importance"] == pytest.approx(by[r["feature"]], abs=1e-9) for r in found)


def test_copies_do_not_go_through_the_preparation(spark, monkeypatch):
    df = labelled(spark, 60)
    model = models.fit(FAMILY[1], df, FEATURES)
    sizes, plain = [], training.scored
    monkeypatch.setattr(training, "scored", lambda m, d: sizes.append(d.count()) or plain(m, d))
    training.permutation_importance(model, df, FEATURES, repeats=4).collect()
    assert sizes == [60, 60]  # not 720 copies


def test_precision_by_place_is_that_of_the_curves(spark):
    rows = [(i % 3 % 2, [0, 4] if i % 2 else [4], [float(i % 5), float(i % 7)] if i % 2 else [float(i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, places array<int>, score array<double>")
    flat = df.select("y", F.explode(F.arrays_zip("places", "score")).alias("c")).select("y", "c.places", "c.score")
    want = {r["places"]: r["average_precision"] for r in metrics.ranking_metrics(flat, ["places"]).collect()}
    for edges in ([], [1.0, 3.5], [0.0, 100.0]):
        found = {r["place"]: r["average_precision"] for r in metrics.precision_by_place(df, edges).collect()}
        assert set(found) == {0, 4} and all(found[p] == pytest.approx(want[p]) for p in want)
    none = metrics.precision_by_place(df.withColumn("y", F.lit(0))).collect()
    assert [r["average_precision"] for r in none] == [None, None]


def test_a_feature_without_influence_loses_nothing(spark):
    df = labelled(spark, 90).withColumn("g", F.lit("a"))
    model = models.fit(FAMILY[1], df, FEATURES)
    found = {r["feature"]: r["importance"] for r in training.permutation_importance(model, df, FEATURES, repeats=3).collect()}
    assert found["g"] == 0.0 and found["x1"] > 0.05


def test_more_rounds_of_boosting_need_no_more_jobs(spark):
    df = splits.stratified_folds(labelled(spark), "id", "y", folds=2)

    def jobs(rounds):
        settings = {"iterations": rounds, "depth": 3, "step": 0.01}
        family = models.candidates("id", {"trees": 2, "depth": 2, "least_rows": 5}, settings)
        counter = spark.sparkContext._jsc.sc().dagScheduler()
        before = counter.numTotalJobs()
        table = training.cross_validate(df, [family[0], family[3]], FEATURES).collect()
        assert [r["model"] for r in table] == ["baseline", "boosting"]
        return counter.numTotalJobs() - before

    assert jobs(40) < jobs(2) + 38  # one level of each tree of a fold alone would be 38 more
