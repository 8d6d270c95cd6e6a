"""Segmentation, affinity and regression queries.

Only the full-rank affinity is plain SQL: with every singular value kept, the scores are the matrix itself.
The other queries are checked by their invariants in the tests.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronage.plans import affinity, regress, retail, segments
from patronage.plans import bookings as booking_plan
from patronage.registry.core import query
from patronage.session import durable
from patronage.sources import views
from patronage.sources.tables import table

# ---- store segments ----


def _store_features(spark, folder, scaling="range"):
    cleaned = retail.clean_stores(views.stores(spark, folder))
    return segments.store_features(cleaned, segments.levels_of(cleaned, "region"), scaling)


@query()
def ml_kmeans_labels(spark, folder):
    labelled = segments.cluster_labels(_store_features(spark, folder))
    return labelled.select("store_code", "region", "store_format", "cluster")


@query("SELECT count(*) AS stores, count(DISTINCT store_code) AS labelled, true AS in_range FROM fx_stores")
def ml_kmeans_cover(spark, folder):
    """Every store has exactly one label, from 1 to the number of clusters."""
    cluster = F.col("cluster")
    inside = F.coalesce(cluster.between(1, segments.CLUSTERS), F.lit(False))
    return ml_kmeans_labels(spark, folder).agg(
        F.count(F.lit(1)).alias("stores"),
        F.countDistinct("store_code").alias("labelled"),
        F.min(inside).alias("in_range"),
    )


@query("SELECT count(*) AS stores, true AS nearest_own FROM fx_stores")
def ml_kmeans_nearest(spark, folder):
    """Every store is nearest to the mean of its own cluster."""
    labelled = durable(segments.cluster_labels(_store_features(spark, folder)).select("cluster", vector_to_array("features").alias("x")))
    entries = labelled.select("cluster", F.posexplode("x").alias("at", "value"))
    means = entries.groupBy("cluster", "at").agg(F.avg("value").alias("mean"))
    means = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("mean"))
    centres = means.agg(F.collect_list(F.struct("cluster", F.col("mean.mean").alias("centre")))).scalar()
    apart = lambda c: F.aggregate(F.zip_with("x", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    judged = labelled.withColumn("_centres", centres).select(
        F.array_min(F.transform("_centres", apart)).alias("least"),
        apart(F.filter("_centres", lambda c: c["cluster"] == F.col("cluster"))[0]).alias("own"),
    )
    near = F.coalesce(F.min(F.col("own") <= F.col("least") + 1e-9), F.lit(False))
    return judged.agg(F.count(F.lit(1)).alias("stores"), near.alias("nearest_own"))


@query("SELECT 19 AS ks, true AS falling")
def ml_elbow_falls(spark, folder):
    """One cost for every number of clusters, the more clusters the lower, until every store is its own."""
    curve = ml_elbow(spark, folder)
    before = F.lag("cost").over(Window.orderBy("k"))
    return curve.select(F.coalesce((F.col("cost") < before) | (F.col("cost") < 1e-9), F.lit(True)).alias("falls")).agg(
        F.count(F.lit(1)).cast("int").alias("ks"), F.min("falls").alias("falling")
    )


@query()
def ml_elbow(spark, folder):
    return segments.elbow_curve(_store_features(spark, folder))


@query()
def ml_bisecting_labels(spark, folder):
    labelled = segments.hierarchy_labels(_store_features(spark, folder, "sd"))
    return labelled.select("store_code", "region", "store_format", "cluster")


@query()
def ml_linkage_labels(spark, folder):
    """The stores grouped bottom-up by complete linkage."""
    labelled = segments.linkage_labels(_store_features(spark, folder, "sd"))
    return labelled.select("store_code", "region", "store_format", "cluster")


@query(f"SELECT count(*) AS stores, count(DISTINCT store_code) AS labelled, {segments.CLUSTERS} AS clusters FROM fx_stores")
def ml_linkage_cover(spark, folder):
    """Every store has exactly one label, and all clusters have stores."""
    return ml_linkage_labels(spark, folder).agg(
        F.count(F.lit(1)).alias("stores"),
        F.countDistinct("store_code").alias("labelled"),
        F.countDistinct("cluster").cast("int").alias("clusters"),
    )


# ---- affinity ----


def _matrix(spark, folder):
    return durable(affinity.cells(views.transactions(spark, folder), views.test_pairs(spark, folder)))


def _candidates(spark, folder):
    """The test stores: the highest codes there are."""
    codes = table(spark, folder, "supplier").select("s_suppkey").distinct().orderBy(F.desc("s_suppkey"))
    return sorted(row[0] for row in codes.limit(views.TEST_STORES).collect())


_FULL_RANK_SQL = """
    SELECT p.customer_id, CAST(p.store_code AS BIGINT) AS store_code, coalesce(value, 0) AS value
    FROM fx_test_pairs p LEFT JOIN (
         SELECT customer_id, store_code, CAST(sum(revenue) AS DOUBLE) AS value FROM fx_transactions GROUP BY ALL) t
      ON p.customer_id = t.customer_id AND CAST(p.store_code AS BIGINT) = t.store_code"""


@query()
def ml_svd_singular_values(spark, folder):
    matrix = _matrix(spark, folder)
    return affinity.energy(affinity.decompose(matrix), matrix).select("position", "singular_value")


@query(
    """SELECT round(sum(value * value) / 1e6, 2) AS squares FROM (
           SELECT CAST(sum(revenue) AS DOUBLE) AS value FROM fx_transactions GROUP BY customer_id, store_code)"""
)
def ml_svd_total(spark, folder):
    """The squared singular values add up to the squared cells."""
    values = affinity.decompose(_matrix(spark, folder)).values
    found = spark.createDataFrame([(float((values**2).sum()),)], "squares double")
    return found.select(F.round(F.col("squares") / 1e6, 2).alias("squares"))


@query()
def ml_svd_energy(spark, folder):
    matrix = _matrix(spark, folder)
    found = affinity.decompose(matrix)
    kept = F.col("position") <= found.rank_for()
    return affinity.energy(found, matrix).select("position", "share", kept.alias("kept"))


def _full_rank(spark, folder):
    scored = affinity.full_rank_scores(_matrix(spark, folder), _candidates(spark, folder))
    return affinity.predictions(scored)


@query(f"SELECT customer_id, store_code, round(value, 2) AS score FROM ({_FULL_RANK_SQL})")
def ml_svd_scores(spark, folder):
    # adding zero turns the negative zeros of rounding into plain ones
    score = (F.round("score", 2) + F.lit(0.0)).alias("score")
    return _full_rank(spark, folder).select("customer_id", "store_code", score)


@query(
    f"""SELECT customer_id, store_code, CASE WHEN value > 0 THEN 1 ELSE 0 END AS prediction
        FROM ({_FULL_RANK_SQL})"""
)
def ml_svd_predictions(spark, folder):
    return _full_rank(spark, folder).select("customer_id", "store_code", "prediction")


@query()
def ml_svd_low_rank_predictions(spark, folder):
    scored = affinity.affinity(
        views.transactions(spark, folder), views.test_pairs(spark, folder), _candidates(spark, folder)
    )
    return affinity.predictions(scored)


# ---- spend regression ----


def _vectors(spark, folder):
    return regress.vectors(booking_plan.features(views.bookings(spark, folder)))


@query()
def ml_ridge_cv(spark, folder):
    train, test = _vectors(spark, folder)
    model = regress.ridge_cv(train).bestModel
    return regress.predict(model, test, "ridge").select(*views.BOOKING_KEY, "ridge")


@query()
def ml_gbt(spark, folder):
    train, test = _vectors(spark, folder)
    model = regress.fit(regress.boosted_trees(), train)
    return regress.predict(model, test, "boosted").select(*views.BOOKING_KEY, "boosted")


_COVER = "SELECT count(*) AS bookings, true AS all_finite{more} FROM fx_bookings WHERE is_train = 0"


def _all_finite(names):
    value = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf")) for n in names]
    return F.min(F.coalesce(F.least(*value) if len(value) > 1 else value[0], F.lit(False))).alias("all_finite")


@query(_COVER.format(more=""))
def ml_ridge_cover(spark, folder):
    """Every test booking has one finite prediction."""
    return ml_ridge_cv(spark, folder).agg(F.count(F.lit(1)).alias("bookings"), _all_finite(["ridge"]))


@query(_COVER.format(more=", true AS all_blended"))
def ml_blend_cover(spark, folder):
    """Every test booking has one finite prediction of each model, and their blend by the fixed weights."""
    names = ["boosted", "winner", "ridge", "prediction"]
    off = F.abs(0.55 * F.col("boosted") + 0.40 * F.col("winner") + 0.05 * F.col("ridge") - F.col("prediction"))
    return ml_blend_predictions(spark, folder).agg(
        F.count(F.lit(1)).alias("bookings"),
        _all_finite(names),
        F.min(off <= 1e-9 * F.abs("prediction") + 1e-9).alias("all_blended"),
    )


@query()
def ml_leaderboard(spark, folder):
    train, _ = _vectors(spark, folder)
    board = regress.leaderboard(train, regress.search_candidates())
    return spark.createDataFrame(board, "place int, model string, rmse double")


@query()
def ml_blend_predictions(spark, folder):
    return regress.spend_predictions(booking_plan.features(views.bookings(spark, folder)))
