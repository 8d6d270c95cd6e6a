"""Store segmentation: encoded store features, k-means, elbow curve and a top-down hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.labels import MALL_STORE, STANDALONE_STORE
from patronage.operators.encode import one_hot, range_scale, sd_scale
from patronage.plans import linkage, lloyd

# Cluster count, restarts and range of the elbow curve, and the measures clustered on.
CLUSTERS = 5
RESTARTS = 20
ELBOW = range(2, 21)
ELBOW_RESTARTS = 5
MEASURES = ("store_size_sq_ft", "sales_per_day", "store_age", "rev_age")
FORMATS = (STANDALONE_STORE, MALL_STORE)


def levels_of(df: DataFrame, column: str) -> list[str]:
    """The column's distinct values in order. Each becomes a feature, so a table has as many as it can hold."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(row[0] for row in rows)


def store_features(cleaned_stores: DataFrame, regions: Sequence[str], scaling: str = "range") -> DataFrame:
    """Stores with one-hot region and format, scaled measures, and all of them as ``features``."""
    if scaling not in ("range", "sd"):
        raise ValueError("scaling is 'range' or 'sd'")
    df = one_hot(cleaned_stores, "region", regions, "region")
    df = one_hot(df, "store_format", FORMATS, "format")
    df = (range_scale if scaling == "range" else sd_scale)(df, MEASURES)
    inputs = [
        *[f"region_{i}" for i in range(len(regions))],
        *[f"format_{i}" for i in range(len(FORMATS))],
        *[f"{m}_{scaling}" for m in MEASURES],
    ]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(df)


def best_kmeans(features: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = 1) -> lloyd.Run:
    """The k-means run of least cost among ``restarts`` seeded starts, all in the same passes."""
    runs = lloyd.fit(features, [k] * restarts, range(seed, seed + restarts))
    return min(runs, key=lambda run: run.cost)


def cluster_labels(
    features: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = 1, name: str = "cluster"
) -> DataFrame:
    """Every store with its cluster, numbered from 1."""
    return best_kmeans(features, k, restarts, seed).label(features, name)


def elbow_curve(
    features: DataFrame, ks: Sequence[int] = ELBOW, restarts: int = ELBOW_RESTARTS, seed: int = 1
) -> DataFrame:
    """(k, cost) rows: the least within-cluster sum of squares of a few starts for every k, all in the same passes."""
    pairs = [(k, seed + i) for k in ks for i in range(restarts)]
    runs = lloyd.fit(features, [k for k, _ in pairs], [s for _, s in pairs])
    costs = [(k, min(run.cost for run in runs if run.k == k)) for k in ks]
    return features.sparkSession.createDataFrame(costs, "k int, cost double")


def hierarchy_labels(features: DataFrame, k: int = CLUSTERS, seed: int = 1) -> DataFrame:
    """Every store with its cluster from repeated splitting in two."""
    model = BisectingKMeans(k=k, seed=seed).fit(features)
    labelled = model.transform(features).withColumn("cluster", F.col("prediction") + 1)
    return labelled.drop("prediction")


def linkage_labels(features: DataFrame, k: int = CLUSTERS, method: str = "complete") -> DataFrame:
    """Every store with its cluster from merging bottom-up, by complete or average linkage."""
    return linkage.hierarchy(features, method).label(features, k, "cluster")
