"""Clusters, feature tables, splits, model quality, training and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.model import base, customers, rule_cluster, stored_customers, tables, tidy
from catalog.prelude import BASE, RFM, days, half_even
from catalog.registry import query
from clientela.learning import boosting, forest
from clientela.learning import features as features_
from clientela.learning import metrics, models, oversampling, splits, training
from clientela.operators import clusters, kmeans
from clientela.operators.neighbours import nearest
from clientela.operators.segments import assign_cluster_names as name_them
from clientela.plans import models as plans
from clientela.session import scratch_folder, settle
from clientela.sources.star_schema import SNAPSHOT, STATUS, model_tables

# ---------------------------------------------------------------- clusters


@query(
    f"""WITH {RFM} SELECT customer_unique_id, Recency,
    {half_even("ln(1 + Frequency)", 9)} AS Frequency_log,
    {half_even("ln(1 + CAST(Monetary AS DOUBLE))", 9)} AS Monetary_log FROM rfm"""
)
def cluster_features(spark: SparkSession, folder: str) -> DataFrame:
    found = clusters.cluster_features(customers(spark, folder))
    return tidy(found.select("customer_unique_id", *clusters.FEATURES), 9)


@query()
def fit_clusters(spark: SparkSession, folder: str) -> DataFrame:
    people = stored_customers(spark, folder)
    model = clusters.fit_clusters(people)
    return clusters.clustering_metadata(people, model, SNAPSHOT, trained_on=SNAPSHOT)


@query()
def predict_clusters(spark: SparkSession, folder: str) -> DataFrame:
    people = stored_customers(spark, folder)
    model = clusters.fit_clusters(people)
    named = name_them(settle(clusters.predict_clusters(people, model)))
    return named.select("customer_unique_id", "Cluster", "Cluster_Name")


@query()
def stored_model(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted model stored with its metadata, loaded again and applied."""
    people = stored_customers(spark, folder)
    model = clusters.fit_clusters(people)
    metadata = clusters.clustering_metadata(people, model, SNAPSHOT, SNAPSHOT)
    path = scratch_folder(spark, "model")
    clusters.save_model(model, metadata, path)
    again, _ = clusters.load_model(spark, path)
    found = clusters.predict_clusters(people, again)
    return found.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def elbow(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.elbow(stored_customers(spark, folder))


# Points in plain units, and centres from which one pass is made in SQL as well.
_PLAIN = ["Recency / 100.0::DOUBLE", "ln(1 + Frequency)", "ln(1 + CAST(Monetary AS DOUBLE))"]
_STARTS = {
    0: [[1.0, 2.0, 13.0], [5.0, 1.5, 12.0], [10.0, 1.0, 11.0], [15.0, 0.7, 12.5]],
    1: [[0.5, 3.0, 14.0], [0.5, 1.0, 12.0], [30.0, 1.0, 12.0], [31.0, 1.0, 12.0]],
    2: [[8.0, 2.0, 12.5], [8.0, 2.0, 12.5], [20.0, 0.7, 10.0], [4.0, 2.5, 13.5]],
}


def _plain_points(spark: SparkSession, folder: str) -> DataFrame:
    people = customers(spark, folder)
    return people.withColumn(
        "p",
        F.array(
            F.col("Recency") / 100.0,
            F.log(1 + F.col("Frequency").cast("double")),
            F.log(1 + F.col("Monetary").cast("double")),
        ),
    )


def _square_sql(centre: list[float]) -> str:
    return " + ".join(f"(x{i} - {c}::DOUBLE) * (x{i} - {c}::DOUBLE)" for i, c in enumerate(centre))


_POINTS_SQL = f"{RFM}, pts AS (SELECT customer_unique_id, Recency, Frequency, Monetary, " + ", ".join(
    f"{x} AS x{i}" for i, x in enumerate(_PLAIN)
) + " FROM rfm)"
_NEAREST_SQL = " UNION ALL ".join(
    f"SELECT customer_unique_id, {s} AS start, {j} AS cluster, {_square_sql(c)} AS cost, x0, x1, x2 FROM pts"
    for s, centres in _STARTS.items() for j, c in enumerate(centres)
)


@query(
    f"""WITH {_POINTS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY customer_unique_id, start
      ORDER BY cost, cluster) AS rn FROM ({_NEAREST_SQL}))
    SELECT CAST(start AS BIGINT) AS start, CAST(cluster AS BIGINT) AS cluster, count(*) AS n,
      {half_even("sum(cost)", 6)} AS cost, {half_even("sum(x0)", 6)} AS x0,
      {half_even("sum(x1)", 6)} AS x1, {half_even("sum(x2)", 6)} AS x2
    FROM best WHERE rn = 1 GROUP BY start, cluster"""
)
def kmeans_pass(spark: SparkSession, folder: str) -> DataFrame:
    """One pass of k-means for several sets of given centres at once."""
    points = kmeans.as_columns(_plain_points(spark, folder).select("p"), "p", len(_PLAIN))
    return tidy(kmeans.passes(points, _STARTS), 6)


_LABEL_SQL = "CASE WHEN Recency > 365 THEN 2 WHEN Frequency >= 5 THEN 0 WHEN Monetary >= 500000 THEN 3 ELSE 1 END"


@query(
    f"""WITH {_POINTS_SQL}, l AS (SELECT *, {_LABEL_SQL} AS label FROM pts),
    sums AS (SELECT a.customer_unique_id, a.label, b.label AS other, count(*) AS n, sum(sqrt(
        (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)))
        AS total FROM l a, l b GROUP BY ALL),
    ab AS (SELECT customer_unique_id, label, max(n) FILTER (label = other) AS size,
        max(total / greatest(n - 1, 1)) FILTER (label = other) AS a,
        min(total / n) FILTER (label <> other) AS b FROM sums GROUP BY ALL)
    SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {half_even(
        "avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)", 6)} AS silhouette
    FROM ab GROUP BY label"""
)
def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    """The silhouette of all customers in fixed groups, by group."""
    rows = _plain_points(spark, folder).withColumn("label", rule_cluster())
    found = clusters.silhouettes(rows, "customer_unique_id", "p", "label")
    means = found.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")
    )
    return tidy(means, 6)


# Three scaled features have their correlations as covariances; the eigenvalues of such a
# matrix have a closed form, and an eigenvector is the cross product of two rows.
_PCA_SQL = f"""WITH {RFM}, x AS (SELECT customer_unique_id, CAST(Recency AS DOUBLE) AS r,
      ln(1 + Frequency) AS f, ln(1 + CAST(Monetary AS DOUBLE)) AS m FROM rfm),
    z AS (SELECT customer_unique_id, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS r,
      (f - avg(f) OVER ()) / stddev_samp(f) OVER () AS f,
      (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS m FROM x),
    c AS (SELECT corr(r, f) AS a, corr(r, m) AS b, corr(f, m) AS c FROM x),
    p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c),
    ph AS (SELECT *, acos(a * b * c / (p * p * p)) / 3 AS phi FROM p),
    e AS (SELECT *, 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM ph),
    ev AS (SELECT a, b, c, 1 AS k, e1 AS e FROM e UNION ALL SELECT a, b, c, 2, 3 - e1 - e3 FROM e),
    v AS (SELECT k, e, a * c - b * (1 - e) AS v0, b * a - (1 - e) * c AS v1, (1 - e) * (1 - e) - a * a AS v2
      FROM ev),
    u AS (SELECT k, e, CASE WHEN v2 < 0 THEN -1 ELSE 1 END / sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS s,
      v0, v1, v2 FROM v)"""


@query(
    _PCA_SQL + f""" SELECT customer_unique_id, {half_even("max(pc) FILTER (k = 1)", 6)} AS PC1,
      {half_even("max(pc) FILTER (k = 2)", 6)} AS PC2, {half_even("max(e) FILTER (k = 1) / 3", 9)} AS share1,
      {half_even("max(e) FILTER (k = 2) / 3", 9)} AS share2
    FROM (SELECT customer_unique_id, k, e, s * (r * v0 + f * v1 + m * v2) AS pc FROM z, u) GROUP BY 1"""
)
def pca_2d(spark: SparkSession, folder: str) -> DataFrame:
    projected, shares = clusters.pca_2d(stored_customers(spark, folder))
    found = tidy(projected, 6)
    return found.withColumns({f"share{i + 1}": F.lit(round(s, 9)) for i, s in enumerate(shares)})


# ---------------------------------------------------------------- features

_REVIEW = f"""{BASE},
delivered AS (SELECT l_orderkey AS order_id, max(l_shipdate) AS got FROM lineitem GROUP BY 1),
timed AS (SELECT order_id, customer_id, got, order_purchase_timestamp AS bought,
    order_purchase_timestamp + INTERVAL 36 DAY AS promised
  FROM m_orders JOIN delivered USING (order_id) WHERE order_status = 'F'),
times AS (SELECT order_id, customer_id, {days("promised", "got")} AS atraso_dias,
    {days("bought", "got")} AS tempo_entrega_dias, {days("bought", "promised")} AS prazo_estimado_dias,
    CAST({days("promised", "got")} > 0 AS BIGINT) AS atrasou, month(bought) AS mes,
    isodow(bought) - 1 AS dow FROM timed),
items_f AS (SELECT order_id, sum(price) AS price_total, sum(freight_value) AS freight_total,
    count(order_item_id) AS n_items, count(DISTINCT seller_id) AS n_sellers,
    count(DISTINCT product_id) AS n_products FROM m_items GROUP BY 1),
pays_f AS (SELECT order_id, sum(payment_value) AS payment_value,
    max(payment_installments) AS installments, max(payment_sequential) AS n_payment_methods
  FROM m_payments GROUP BY 1),
label AS (SELECT order_id, review_score FROM (SELECT *, row_number() OVER (PARTITION BY order_id
    ORDER BY review_creation_date NULLS LAST, review_id) AS rn FROM m_all_reviews) WHERE rn = 1),
cats AS (SELECT order_id, coalesce(product_category_name_english, 'desconhecida') AS cat FROM dear
  LEFT JOIN m_products USING (product_id) LEFT JOIN m_translation USING (product_category_name)),
types AS (SELECT order_id, payment_type FROM (SELECT *, row_number() OVER (PARTITION BY order_id
    ORDER BY payment_value DESC, payment_sequential, payment_type) AS rn FROM m_payments)
  WHERE rn = 1),
review_f AS (SELECT order_id, atraso_dias, tempo_entrega_dias, prazo_estimado_dias, atrasou,
    CAST(price_total AS DOUBLE) AS price_total, CAST(freight_total AS DOUBLE) AS freight_total,
    CAST(freight_total AS DOUBLE) / nullif(CAST(price_total AS DOUBLE), 0) AS freight_ratio,
    CAST(price_total AS DOUBLE) / nullif(n_items, 0) AS valor_por_item, n_items, n_sellers,
    n_products, CAST(payment_value AS DOUBLE) AS payment_value, installments, n_payment_methods,
    mes, dow, coalesce(cat, 'nan') AS cat, coalesce(customer_state, 'nan') AS customer_state,
    coalesce(payment_type, 'nan') AS payment_type, CAST(review_score <= 2 AS BIGINT) AS y
  FROM times JOIN items_f USING (order_id) JOIN label USING (order_id)
  LEFT JOIN cats USING (order_id) LEFT JOIN pays_f USING (order_id)
  LEFT JOIN types USING (order_id) LEFT JOIN m_customers USING (customer_id)),
scored AS (SELECT order_id, y, ((order_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM review_f)
"""


def _review_sql(select: str) -> str:
    return f"WITH {_REVIEW} {select}"


def _doubles(names: list[str]) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _review_features(spark: SparkSession, folder: str) -> DataFrame:
    return features_.review_features(tables(spark, folder, with_delivery=True).with_(
        reviews=_all_reviews(spark, folder)), STATUS)


def _all_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return model_tables(spark, folder).reviews


_TIMES = "atraso_dias, tempo_entrega_dias, prazo_estimado_dias, atrasou, mes, dow"


@query(_review_sql(f"SELECT order_id, {_TIMES} FROM times"))
def delivery_time_features(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables(spark, folder, with_delivery=True).orders
    found = features_.delivery_time_features(orders, STATUS)
    return tidy(found.select("order_id", *_TIMES.split(", ")))


@query(
    _review_sql(
        "SELECT order_id, CAST(price_total AS DOUBLE) AS price_total, CAST(freight_total AS DOUBLE) "
        "AS freight_total, n_items, n_sellers, n_products FROM items_f"
    )
)
def review_item_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(features_.item_features(tables(spark, folder).order_items))


@query(
    _review_sql(
        "SELECT order_id, CAST(payment_value AS DOUBLE) AS payment_value, installments, "
        "CAST(n_payment_methods AS BIGINT) AS n_payment_methods, payment_type "
        "FROM pays_f LEFT JOIN types USING (order_id)"
    )
)
def payment_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(features_.payment_features(tables(spark, folder).payments))


@query(
    _review_sql(
        f"SELECT order_id, {_doubles(features_.REVIEW_NUMERIC)}, cat, customer_state, "
        "payment_type, y FROM review_f"
    )
)
def review_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_review_features(spark, folder))


_ORDER_MART = [
    "order_id", "order_purchase_timestamp", "total_payment", "total_items_value", "n_items",
    "n_payments", "review_score", "customer_state", "product_category",
]


def _repeat_sql(mode: str) -> str:
    if mode == "row":
        first = f"""first_o AS (SELECT * FROM (SELECT customer_unique_id, {', '.join(_ORDER_MART)},
          count(*) OVER (PARTITION BY customer_unique_id) AS n_orders, row_number() OVER (
          PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS rn
          FROM ob) WHERE rn = 1)"""
    else:
        picks = ", ".join(
            f"arg_min({c}, (order_purchase_timestamp, order_id)) FILTER ({c} IS NOT NULL) AS {c}"
            for c in _ORDER_MART
        )
        first = (
            f"first_o AS (SELECT customer_unique_id, {picks}, count(*) AS n_orders FROM ob "
            "GROUP BY customer_unique_id)"
        )
    return f"""WITH {BASE}, {first} SELECT customer_unique_id,
      CAST(total_payment AS DOUBLE) AS first_payment,
      CAST(total_items_value AS DOUBLE) AS first_items_value, CAST(n_items AS DOUBLE) AS n_items,
      CAST(n_payments AS DOUBLE) AS n_payments,
      coalesce(review_score, (SELECT quantile_cont(review_score, 0.5) FROM first_o)) AS review_score,
      CASE WHEN total_payment - total_items_value IS NOT NULL THEN
        greatest(CAST(total_payment - total_items_value AS DOUBLE), 0.0) END AS freight_proxy,
      CAST(total_items_value AS DOUBLE) / nullif(n_items, 0) AS avg_item_value,
      CAST(review_score IS NULL AS DOUBLE) AS review_missing,
      CAST(month(order_purchase_timestamp) AS DOUBLE) AS month,
      CAST(quarter(order_purchase_timestamp) AS DOUBLE) AS quarter,
      CAST(isodow(order_purchase_timestamp) - 1 AS DOUBLE) AS dow,
      CAST(year(order_purchase_timestamp) AS DOUBLE) AS year,
      coalesce(customer_state, 'nan') AS state, coalesce(product_category, 'nan') AS category,
      CAST(n_orders >= 2 AS BIGINT) AS y FROM first_o"""


def _order_mart(spark: SparkSession, folder: str) -> DataFrame:
    return settle(base(spark, folder, category=True).select("customer_unique_id", *_ORDER_MART))


@query(_repeat_sql("column"))
def repeat_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(features_.repeat_features(_order_mart(spark, folder)))


@query(_repeat_sql("row"))
def repeat_features_of_first_row(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(features_.repeat_features(_order_mart(spark, folder), mode="row"))


@query(
    f"""WITH {BASE} SELECT customer_unique_id, arg_min(order_id, (order_purchase_timestamp,
    order_id)) AS order_id, arg_min(review_score, (order_purchase_timestamp, order_id))
    FILTER (review_score IS NOT NULL) AS review_score, count(*) AS n_orders FROM ob
    GROUP BY customer_unique_id"""
)
def first_order_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = base(spark, folder).select(
        "customer_unique_id", "order_purchase_timestamp", "order_id", "review_score"
    )
    return features_.first_order_per_customer(orders).drop("order_purchase_timestamp")


@query(
    f"""WITH {BASE}, n AS (SELECT customer_unique_id, count(*) AS n FROM ob GROUP BY 1)
    SELECT c.customer_unique_id, CAST(coalesce(n.n, 0) >= 2 AS BIGINT) AS repeat
    FROM m_customers c LEFT JOIN n USING (customer_unique_id)"""
)
def target_reindex(spark: SparkSession, folder: str) -> DataFrame:
    people = tables(spark, folder).customers
    return tidy(features_.repeat_targets(people, base(spark, folder)))


# ---------------------------------------------------------------- splits and metrics

_PART = """SELECT order_id, CAST(CASE {cases} END AS BIGINT) AS {name} FROM (SELECT order_id, y,
    row_number() OVER (PARTITION BY y ORDER BY md5('42:' || order_id), order_id) AS r,
    count(*) OVER (PARTITION BY y) AS n FROM review_f)"""


@query(
    _review_sql(
        _PART.format(name="is_test", cases="WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 1 ELSE 0")
    )
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(_review_features(spark, folder).select("order_id", "y"))
    train, test = splits.stratified_split(rows, "order_id", "y")
    return tidy(
        train.select("order_id", F.lit(0).alias("is_test")).unionByName(
            test.select("order_id", F.lit(1).alias("is_test"))
        )
    )


@query(
    _review_sql(
        _PART.format(
            name="fold",
            cases=" ".join(
                f"WHEN r <= floor(n * {i / 5}::DOUBLE + 0.5) THEN {i - 1}" for i in range(1, 5)
            ) + " ELSE 4",
        )
    )
)
def stratified_kfold(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(_review_features(spark, folder).select("order_id", "y"))
    return tidy(splits.stratified_folds(rows, "order_id", "y").select("order_id", "fold"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed score with many ties, so that metrics can be checked to the last digit."""
    score = F.pmod(F.col("order_id") * 7919, F.lit(1000)) / 1000.0
    return _review_features(spark, folder).select("order_id", "y", score.alias("score"))


@query(
    _review_sql(
        """SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
        2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE
        AS accuracy, (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 AS balanced_accuracy
        FROM (SELECT count(*) FILTER (y = 0 AND score < 0.5) AS tn,
        count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5)
        AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM scored)"""
    )
)
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.classification_metrics(_scored(spark, folder), 0.5)


_CURVE = """, curve AS (SELECT score, n, p, CAST(sum(n) OVER w AS DOUBLE) AS upto,
    CAST(sum(p) OVER w AS DOUBLE) AS hits, CAST(sum(p) OVER () AS DOUBLE) AS all_hits,
    CAST(sum(n) OVER () AS DOUBLE) AS all_n FROM (SELECT score, count(*) AS n,
    CAST(sum(y) AS BIGINT) AS p FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC))"""


@query(
    _review_sql(
        _CURVE + f""" SELECT {half_even("sum(p / all_hits * (hits / upto))", 9)} AS average_precision
        FROM curve"""
    )
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.ranking_metrics(_scored(spark, folder))
    return tidy(found.select("average_precision"), 9)


@query(
    _review_sql(
        _CURVE + f""" SELECT {half_even("sum((n - p) * (hits - p + p / 2.0::DOUBLE)) / (max(all_hits) * (max(all_n) - max(all_hits)))", 9)}
        AS roc_auc FROM curve"""
    )
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(metrics.ranking_metrics(_scored(spark, folder)).select("roc_auc"), 9)


@query(
    _review_sql(
        _CURVE + """ SELECT score AS threshold, 2 * hits / (upto + all_hits) AS f1 FROM curve
        ORDER BY 2 * hits / (upto + all_hits) DESC, score LIMIT 1"""
    )
)
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_threshold(_scored(spark, folder))


@query(
    _review_sql(
        """, ranked AS (SELECT y, row_number() OVER (ORDER BY score DESC, order_id) AS r,
        count(*) OVER () AS n, CAST(sum(y) OVER () AS DOUBLE) AS p FROM scored)
        SELECT top, k, hits / p AS captured, hits / k AS rate, (hits / k) / (p / n) AS lift FROM (
        SELECT top, CAST(floor(n * top) AS BIGINT) AS k, any_value(n) AS n, any_value(p) AS p,
        CAST(sum(y) FILTER (r <= floor(n * top)) AS DOUBLE) AS hits FROM ranked,
        (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS top) GROUP BY ALL)"""
    )
)
def lift_at(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.lift(_scored(spark, folder), "order_id")


# ---------------------------------------------------------------- training

REVIEW = models.Features(
    "order_id", features_.REVIEW_NUMERIC, features_.REVIEW_CATEGORIES
)
REPEAT = models.Features(
    "customer_unique_id", features_.REPEAT_NUMERIC, features_.REPEAT_CATEGORIES
)


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = settle(_review_features(spark, folder))
    return splits.stratified_split(rows, "order_id", "y")


def _family(name: str | None = None) -> list[models.Candidate]:
    family = models.review_candidates()
    return [c for c in family if name in (None, c.name)]


def _candidate_scores(spark: SparkSession, folder: str, name: str) -> DataFrame:
    train, test = _split(spark, folder)
    (candidate,) = _family(name)
    model = models.fit(candidate, train, REVIEW)
    return tidy(models.scored(model, test).select("order_id", "y", "score"))


_TEST_ROWS = """, parts AS (SELECT order_id, y, row_number() OVER (PARTITION BY y
    ORDER BY md5('42:' || order_id), order_id) <= floor(count(*) OVER (PARTITION BY y)
    * 0.2::DOUBLE + 0.5) AS is_test FROM review_f)"""


def _scaled_sql() -> str:
    fill = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in features_.REVIEW_NUMERIC)
    filled = ", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in features_.REVIEW_NUMERIC)
    moments = ", ".join(
        f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_dev" for c in features_.REVIEW_NUMERIC
    )
    scaled = ", ".join(
        half_even(f"(coalesce(t.{c}, m.{c}) - {c}_mean) / CASE WHEN {c}_dev > 0 THEN {c}_dev ELSE 1 END", 6) + f" AS {c}_scaled"
        for c in features_.REVIEW_NUMERIC
    )
    kept = ", ".join(
        f"CASE WHEN t.{c} IN (SELECT {c} FROM train GROUP BY 1 HAVING count(*) >= 0.01 * "
        f"(SELECT count(*) FROM train)) THEN t.{c} ELSE '{models.RARE}' END AS {c}_kept"
        for c in features_.REVIEW_CATEGORIES
    )
    return _review_sql(
        _TEST_ROWS + f""", typed AS (SELECT order_id, {_doubles(features_.REVIEW_NUMERIC)}, cat, customer_state,
          payment_type, is_test FROM review_f JOIN (SELECT order_id, is_test FROM parts) USING (order_id)),
        train AS (SELECT * FROM typed WHERE NOT is_test),
        med AS (SELECT {fill} FROM train),
        filled AS (SELECT {filled} FROM train t, med m),
        mom AS (SELECT {moments} FROM filled)
        SELECT t.order_id, {scaled}, {kept} FROM typed t, med m, mom WHERE is_test"""
    )


@query(_scaled_sql())
def preprocess(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows with the medians, moments and levels of the training rows."""
    train, test = _split(spark, folder)
    ready = models.fit_preprocessing(train, REVIEW).transform(test)
    return tidy(
        ready.select(
            "order_id",
            *[f"{c}_scaled" for c in REVIEW.numeric],
            *[f"{c}_kept" for c in REVIEW.categories],
        ),
        6,
    )


@query(
    _review_sql(
        _TEST_ROWS + """ SELECT order_id, y, (SELECT CASE WHEN sum(y) * 2 > count(*) THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END FROM parts WHERE NOT is_test) AS score FROM parts WHERE is_test"""
    )
)
def majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _candidate_scores(spark, folder, "baseline")


@query()
def logistic(spark: SparkSession, folder: str) -> DataFrame:
    return _candidate_scores(spark, folder, "logistic")


@query()
def random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _candidate_scores(spark, folder, "forest")


_DRAWS = 50


def _draws_sql() -> str:
    drawn = " + ".join(
        f"CASE WHEN substr(md5('{models.SEED}:' || tree || ':' || order_id), 1, {forest.HASH_DIGITS}) "
        f">= '{b}' THEN 1 ELSE 0 END" for b in forest.draw_bounds()
    )
    return f"""SELECT CAST(tree AS BIGINT) AS tree, y, CAST(drawn AS BIGINT) AS drawn,
      sum(drawn) OVER (PARTITION BY tree) / (2.0::DOUBLE * drawn) AS weight FROM (
      SELECT tree, y, sum({drawn}) AS drawn FROM review_f,
      (SELECT unnest(range({_DRAWS})) AS tree) GROUP BY tree, y)"""


@query(_review_sql(_draws_sql()))
def forest_draws(spark: SparkSession, folder: str) -> DataFrame:
    """What the first trees draw of either class, and the weights that balance it."""
    rows = settle(_review_features(spark, folder).select("order_id", "y"))
    pairs = forest.drawn(rows, "order_id", range(_DRAWS), models.SEED)
    return tidy(forest.class_weights(pairs).drop("rows"))


@query()
def gradient_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return _candidate_scores(spark, folder, "boosting")


# Columns and edges for which the first trees are grown in SQL as well.
_EDGES = {
    "tempo_entrega_dias": [20.0, 40.0, 60.0, 80.0, 100.0],
    "valor_por_item": [15_000.0, 25_000.0, 35_000.0, 45_000.0],
    "n_items": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    "dow": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0],
}
_STEP, _LEAST = 0.3, boosting.LEAST_ROWS


def _tree_sql(t: int) -> str:
    """One tree of two levels on the raw scores ``s{t}``, to those after it."""
    sums = "sum(s.w * (s.p - s.y)) AS g, sum(s.w * s.p * (1 - s.p)) AS h, count(*) AS n"

    def cuts(source: str) -> str:
        running = ", ".join(
            f"sum({c}) OVER (PARTITION BY node, feature ORDER BY bin) AS {c}l, "
            f"sum({c}) OVER (PARTITION BY node, feature) AS {c}a" for c in "ghn"
        )
        gain = "gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)"
        return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node
          ORDER BY gain DESC, feature, bin) AS rn FROM (SELECT *, round({gain}, 9) AS gain
          FROM (SELECT node, feature, bin, {running} FROM {source})
          WHERE nl >= {_LEAST} AND na - nl >= {_LEAST} AND hl >= 0.001 AND ha - hl >= 0.001)
          WHERE gain > 0) WHERE rn = 1"""

    return f"""s{t} AS (SELECT order_id, y, w, 1 / (1 + exp(-raw)) AS p, raw FROM r{t}),
    h{t}_0 AS (SELECT 0 AS node, feature, bin, {sums} FROM s{t} s JOIN bl USING (order_id)
      GROUP BY feature, bin),
    c{t}_0 AS ({cuts(f"h{t}_0")}),
    n{t} AS (SELECT s.*, CASE WHEN bl.bin <= c.bin THEN 1 ELSE 2 END AS node FROM s{t} s
      JOIN bl USING (order_id) JOIN c{t}_0 c ON c.feature = bl.feature),
    h{t}_1 AS (SELECT node, feature, bin, {sums} FROM n{t} s JOIN bl USING (order_id)
      GROUP BY node, feature, bin),
    c{t}_1 AS ({cuts(f"h{t}_1")}),
    l{t} AS (SELECT s.*, CASE WHEN c.node IS NULL THEN 0 WHEN bl.bin <= c.bin THEN 1 ELSE 2 END AS side
      FROM n{t} s LEFT JOIN c{t}_1 c USING (node)
      LEFT JOIN bl ON bl.order_id = s.order_id AND bl.feature = c.feature),
    v{t} AS (SELECT node, side, -{_STEP}::DOUBLE * sum(w * (p - y)) / (sum(w * p * (1 - p)) + 1) AS v
      FROM l{t} GROUP BY node, side),
    r{t + 1} AS (SELECT order_id, y, w, raw + v AS raw FROM l{t} JOIN v{t} USING (node, side))"""


_BINNED = " UNION ALL ".join(
    f"SELECT order_id, {i} AS feature, " + " + ".join(
        f"CASE WHEN coalesce({c}, 0) > {e} THEN 1 ELSE 0 END" for e in edges
    ) + " AS bin FROM review_f"
    for i, (c, edges) in enumerate(_EDGES.items())
)


@query(
    _review_sql(
        f""", bl AS ({_BINNED}),
        one AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM review_f),
        r0 AS (SELECT order_id, CAST(y AS DOUBLE) AS y, 1.0::DOUBLE AS w, ln(p / (1 - p)) AS raw
          FROM review_f, one), {_tree_sql(0)}, {_tree_sql(1)}
        """ + " UNION ALL ".join(
            f"SELECT CAST({t} AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, "
            f"CAST(feature AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, "
            f"{half_even('g', 6)} AS g, {half_even('h', 6)} AS h, n FROM h{t}_{d}"
            for t in (0, 1) for d in (0, 1)
        )
    )
)
def boosting_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """The sums from which the first two trees are grown, on a few columns with given edges."""
    values = F.array(*[F.coalesce(c, F.lit(0.0)).cast("double") for c in _EDGES])
    edges = list(_EDGES.values())
    rows = settle(
        _review_features(spark, folder).select(
            boosting.binned(values, edges).alias("bins"),
            F.col("y").cast("double").alias("y"),
            F.lit(1.0).alias("weight"),
            F.lit(False).alias("validation"),
        )
    )
    settings = boosting.Settings(iterations=2, depth=2, step=_STEP, least_rows=_LEAST)
    model = boosting.fit_boosting(rows, edges, settings)
    raw, parts = F.lit(model.start), []
    for t, tree in enumerate(model.trees):
        current, stump = rows.withColumn("raw", raw), boosting.Tree()
        parts.append(boosting.histograms(current, stump, [0]).withColumn("tree", F.lit(t)))
        stump.split(0, tree.feature[0], tree.cut[0], (0.0, 0.0))
        parts.append(boosting.histograms(current, stump, [1, 2]).withColumn("tree", F.lit(t)))
        raw = raw + tree.column(tree.value)
    return tidy(reduce(DataFrame.unionByName, parts), 6)


@query(
    f"""WITH {BASE}, c AS (SELECT CAST(n >= 2 AS BIGINT) AS y, count(*) AS k FROM (
      SELECT customer_unique_id, count(*) AS n FROM ob GROUP BY 1) GROUP BY 1)
    SELECT y, (SELECT max(k) FROM c) AS n FROM c"""
)
def smote(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(features_.repeat_features(_order_mart(spark, folder)))
    preparation = models.fit_preprocessing(rows, REPEAT)
    prepared = settle(preparation.transform(rows).select(REPEAT.id_column, "y", "features"))
    more = oversampling.oversample(prepared, REPEAT.id_column)
    return tidy(more.groupBy("y").agg(F.count(F.lit(1)).alias("n")))


# Columns of the repeat model without nulls of their own, brought to similar widths.
_POINT = {"first_items_value": 100_000.0, "n_items": 1.0, "month": 6.0, "dow": 7.0, "year": 2.0}


@query(
    f"""WITH rows_ AS ({_repeat_sql("column")}),
    minor AS (SELECT y FROM rows_ GROUP BY y ORDER BY count(*), y LIMIT 1),
    p AS (SELECT customer_unique_id AS id, {", ".join(f"coalesce({c}, 0) / {w}::DOUBLE AS {c}" for c, w in _POINT.items())}
      FROM rows_ WHERE y = (SELECT y FROM minor)),
    d AS (SELECT a.id, b.id AS neighbour, round(sqrt({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _POINT)}), 9)
      AS distance FROM p a JOIN p b ON a.id <> b.id)
    SELECT id, place, neighbour, {half_even("distance", 6)} AS distance FROM (SELECT *, row_number()
      OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d) WHERE place <= 5"""
)
def minority_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours between which oversampling places new rows, for a few plain columns."""
    rows = settle(features_.repeat_features(_order_mart(spark, folder)))
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    minor = sizes.orderBy("n", "y").limit(1).select("y")
    point = F.array(*[F.coalesce(c, F.lit(0.0)).cast("double") / w for c, w in _POINT.items()])
    points = rows.join(F.broadcast(minor), "y").select(
        F.col("customer_unique_id").alias("id"), point.alias("p")
    )
    near = nearest(settle(points), oversampling.NEIGHBOURS)
    found = near.select("id", F.posexplode("near").alias("place", "n"))
    return tidy(
        found.select(
            "id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbour"),
            F.col("n.distance").alias("distance"),
        ),
        6,
    )


FOLDS = 5


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _split(spark, folder)
    return settle(splits.stratified_folds(train, "order_id", "y", folds=FOLDS))


@query()
def cross_validate(spark: SparkSession, folder: str) -> DataFrame:
    return training.cross_validate(_folded(spark, folder), _family(), REVIEW)


@query()
def select_best(spark: SparkSession, folder: str) -> DataFrame:
    results = training.cross_validate(_folded(spark, folder), _family(), REVIEW)
    best = training.select_best(results, [c.name for c in _family()])
    return spark.createDataFrame([(best,)], "model string")


_FIXED_MODELS = ("a", "b")


@query(
    _review_sql(
        _PART.format(
            name="fold",
            cases=" ".join(f"WHEN r <= floor(n * {i / 5}::DOUBLE + 0.5) THEN {i - 1}" for i in range(1, 5))
            + " ELSE 4",
        ).join([", folds AS (", ")"]) + """, sc AS (
        SELECT m, fold, part, y, ((order_id * CASE m WHEN 'a' THEN 7919 ELSE 104729 END + fold) % 1000)
          / 1000.0::DOUBLE AS score
        FROM (SELECT f.order_id, f.fold AS own, r.y FROM folds f JOIN review_f r USING (order_id)),
          (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(range(5)) AS fold),
          LATERAL (SELECT CASE WHEN own = fold THEN 'test' ELSE 'train' END AS part)),
        c AS (SELECT m, fold, part, count(*) FILTER (y = 1 AND score >= 0.5) AS tp,
          count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn,
          count(*) AS n FROM sc GROUP BY ALL),
        f AS (SELECT m, fold, part, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, tp / (tp + fp)::DOUBLE AS pr,
          tp / (tp + fn)::DOUBLE AS rc, (n - fp - fn) / n::DOUBLE AS acc FROM c)
        SELECT m AS model, """ + ", ".join(
            f"{half_even(x, 9)} AS {n}" for n, x in {
                "f1_cv": "avg(f1) FILTER (part = 'test')",
                "f1_cv_std": "stddev_pop(f1) FILTER (part = 'test')",
                "f1_train": "avg(f1) FILTER (part = 'train')",
                "overfit_gap": "avg(f1) FILTER (part = 'train') - avg(f1) FILTER (part = 'test')",
                "precision_cv": "avg(pr) FILTER (part = 'test')",
                "recall_cv": "avg(rc) FILTER (part = 'test')",
                "accuracy_cv": "avg(acc) FILTER (part = 'test')",
            }.items()
        ) + " FROM f GROUP BY m"
    )
)
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means over folds and the gap to training, for two fixed scores per fold."""
    rows = settle(_review_features(spark, folder).select("order_id", "y"))
    folded = settle(splits.stratified_folds(rows, "order_id", "y", folds=FOLDS))
    factor = F.when(F.col("model") == "a", 7919).otherwise(104729)
    scores = (
        folded.withColumnRenamed("fold", "own")
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in _FIXED_MODELS])))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
        .select(
            "model", "fold", "y",
            F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("part"),
            (F.pmod(F.col("order_id") * factor + F.col("fold"), F.lit(1000)) / 1000.0).alias("score"),
        )
    )
    found = training.summarise_folds(scores)
    return tidy(
        found.select("model", "f1_cv", "f1_cv_std", "f1_train", "overfit_gap", "precision_cv",
                     "recall_cv", "accuracy_cv"),
        9,
    )


@query()
def tune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    threshold = training.tune_threshold(_folded(spark, folder), _family("logistic")[0], REVIEW)
    return spark.createDataFrame([(threshold,)], "threshold double")


@query()
def evaluate_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows at 0.5 and at the threshold tuned on the training rows."""
    train, test = _split(spark, folder)
    train = settle(splits.stratified_folds(train, "order_id", "y", folds=FOLDS))
    threshold = training.tune_threshold(train, _family("logistic")[0], REVIEW)
    model = models.fit(_family("logistic")[0], train, REVIEW)
    return training.evaluate_holdout(model, train, test, threshold)


_REPEATS = 5


@query(
    _review_sql(
        _TEST_ROWS + f""", t AS (SELECT order_id FROM parts WHERE is_test),
        base AS (SELECT order_id, row_number() OVER (ORDER BY md5('42:' || order_id), order_id) AS r FROM t),
        other AS (SELECT order_id AS donor, f, k, row_number() OVER (PARTITION BY f, k
            ORDER BY md5('42:' || f || ':' || k || ':' || order_id), order_id) AS r
          FROM t, (SELECT unnest({[*features_.REVIEW_NUMERIC, *features_.REVIEW_CATEGORIES]!r}) AS f),
            (SELECT unnest(range(1, {_REPEATS + 1})) AS k))
        SELECT f AS feature, CAST(k AS BIGINT) AS repeat, base.order_id AS id, donor FROM other JOIN base USING (r)"""
    )
)
def permutation_donors(spark: SparkSession, folder: str) -> DataFrame:
    """Which row's value each row gets, for every feature and repeat."""
    _, test = _split(spark, folder)
    names = [*REVIEW.numeric, *REVIEW.categories]
    ids = settle(test.select("order_id"))
    return tidy(training.permutation_donors(ids, "order_id", names, _REPEATS, models.SEED))


@query()
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _split(spark, folder)
    model = models.fit(_family("logistic")[0], train, REVIEW)
    return training.permutation_importance(model, test, REVIEW)


@query()
def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The whole protocol of the review model: train, store, load, score, sum by state."""
    path = scratch_folder(spark, "review-model")
    found = tables(spark, folder, with_delivery=True).with_(reviews=_all_reviews(spark, folder))
    plans.train_review_model(found, path, STATUS)
    return plans.score_review_risk(found, path, STATUS)


@query()
def repeat_protocol(spark: SparkSession, folder: str) -> DataFrame:
    """The whole protocol of the repeat model, and its stored report in a few numbers."""
    path = scratch_folder(spark, "repeat-model")
    metrics = plans.train_repeat_model(_order_mart(spark, folder), path)
    _, stored = training.load_artifacts(spark, path)
    rows = [(stored["best_model"], stored["threshold"], stored["test"]["roc_auc"], metrics["n_samples"])]
    return spark.createDataFrame(rows, "model string, threshold double, roc_auc double, n bigint")
