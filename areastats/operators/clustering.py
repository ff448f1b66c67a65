"""Clustering of areas on scaled features.

Every function fits an MLlib model, whose passes aggregate over all partitions, and returns the
predictions as a DataFrame next to the model.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.clustering import (
    LDA,
    BisectingKMeans,
    BisectingKMeansModel,
    GaussianMixture,
    GaussianMixtureModel,
    KMeans,
    KMeansModel,
    LDAModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import PARTITION_ROWS
from .features import clustering_features


class Clustering(NamedTuple):
    """A fitted model and ``(key, prediction)`` of every row that has no null."""

    predictions: DataFrame
    model: Model


def _fit(df: DataFrame, key: str, features: Sequence[str], k: int, estimator):
    if k < 2:
        raise ValueError("ask for at least two clusters")
    data = clustering_features(df, key, features)
    # the fits pass over the rows many times; the cache spills to disk and is rebuilt if lost
    data.persist(StorageLevel.MEMORY_AND_DISK)
    gathered = _gathered(data)
    try:
        model = estimator.fit(gathered)
    finally:
        gathered.unpersist()
        data.unpersist()
    return data, model


def _gathered(cached: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """All rows of a cached table in as many partitions as the cores or the rows ask for.

    Every task of every pass of a fit answers to the driver, so a table in the many small
    partitions of a shuffle sends it far more than the fit needs.  One in few partitions stays as it is.
    """
    cores = cached.sparkSession.sparkContext.defaultParallelism
    enough = max(cores, -(-cached.count() // partition_rows))
    if cached.rdd.getNumPartitions() <= enough:
        return cached
    gathered = cached.coalesce(enough).persist(StorageLevel.MEMORY_AND_DISK)
    gathered.count()
    cached.unpersist()
    return gathered


def kmeans(
    df: DataFrame, key: str, features: Sequence[str], k: int, max_iter: int = 20, seed: int = 1, tol: float = 1e-4
) -> Clustering:
    data, model = _fit(df, key, features, k, KMeans(k=k, maxIter=max_iter, seed=seed, tol=tol))
    return Clustering(model.transform(data).select(key, "prediction"), model)


def bisecting_kmeans(
    df: DataFrame, key: str, features: Sequence[str], k: int, max_iter: int = 20, seed: int = 1
) -> Clustering:
    data, model = _fit(df, key, features, k, BisectingKMeans(k=k, maxIter=max_iter, seed=seed))
    return Clustering(model.transform(data).select(key, "prediction"), model)


def gaussian_mixture(
    df: DataFrame, key: str, features: Sequence[str], k: int, max_iter: int = 100, seed: int = 1
) -> Clustering:
    data, model = _fit(df, key, features, k, GaussianMixture(k=k, maxIter=max_iter, seed=seed))
    return Clustering(model.transform(data).select(key, "prediction"), model)


def lda(
    df: DataFrame, key: str, features: Sequence[str], k: int, max_iter: int = 20, seed: int = 1
) -> Clustering:
    """``prediction`` is the topic of largest weight; ``topics`` holds all weights."""
    data, model = _fit(df, key, features, k, LDA(k=k, maxIter=max_iter, seed=seed))
    weights = model.transform(data).select(
        key, vector_to_array("topicDistribution").alias("topics")
    )
    best = F.array_position("topics", F.array_max("topics")) - 1
    return Clustering(weights.select(key, best.cast("int").alias("prediction"), "topics"), model)


def model_summary(model: Model, data: DataFrame | None = None) -> DataFrame:
    """What a model consists of, as ``(component, measure, i, j, value)``.

    Centres of k-means and bisecting k-means; weights, means and covariances of a mixture;
    topic-term weights of LDA and, with the ``data`` it is judged on, its bounds on
    log-likelihood and log-perplexity.  A model is as large as clusters times features.
    """
    rows: list[tuple] = []
    if isinstance(model, (KMeansModel, BisectingKMeansModel)):
        for c, centre in enumerate(model.clusterCenters()):
            rows += [(c, "center", i, None, float(x)) for i, x in enumerate(centre)]
    elif isinstance(model, GaussianMixtureModel):
        for c, (weight, gaussian) in enumerate(zip(model.weights, model.gaussians)):
            rows.append((c, "weight", None, None, float(weight)))
            rows += [(c, "mean", i, None, float(x)) for i, x in enumerate(gaussian.mean)]
            rows += [
                (c, "cov", i, j, float(x))
                for i, line in enumerate(gaussian.cov.toArray())
                for j, x in enumerate(line)
            ]
    elif isinstance(model, LDAModel):
        for i, line in enumerate(model.topicsMatrix().toArray()):
            rows += [(c, "term", i, None, float(x)) for c, x in enumerate(line)]
        if data is not None:
            rows.append((None, "log_likelihood", None, None, float(model.logLikelihood(data))))
            rows.append((None, "log_perplexity", None, None, float(model.logPerplexity(data))))
    else:
        raise ValueError(f"no summary for {type(model).__name__}")
    spark = data.sparkSession if data is not None else _session()
    return spark.createDataFrame(
        rows, "component int, measure string, i int, j int, value double"
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()
