"""Checks of fitted clusterings against their own rows.

A fit depends on where it starts, so its answer cannot be foretold; what must hold of any answer
can.  Each check takes the scaled rows ``(key, features)`` and a model and tells, per row or per
component, whether it holds.  Models are as large as clusters times features, and every check is
one or two passes over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeansModel, GaussianMixtureModel, KMeansModel, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch

#: What rounding and an almost settled fit may move a centre by, on features scaled to [0, 1].
SETTLED = 1e-6


def _distance(x: Column, centre: Sequence[float]) -> Column:
    """Squared distance of an array column from a point."""
    parts = [(F.get(x, F.lit(i)) - F.lit(float(c))) ** 2 for i, c in enumerate(centre)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _predicted(data: DataFrame, model) -> DataFrame:
    return model.transform(data).withColumn("x", vector_to_array("features"))


def nearest_centres(data: DataFrame, key: str, model: KMeansModel) -> DataFrame:
    """``(key, x, nearest)``: whether no centre is nearer to the row than the predicted one."""
    distances = F.array(*(_distance(F.col("x"), centre) for centre in model.clusterCenters()))
    rows = _predicted(data, model).withColumn("_d", distances)
    return rows.select(key, "x", (F.get("_d", "prediction") <= F.array_min("_d") * (1 + 1e-12) + 1e-15).alias("nearest"))


def centres_of_members(data: DataFrame, model: KMeansModel, settled: float = SETTLED) -> DataFrame:
    """``(component, i, size, centre, mean, is_mean, spread)`` for every centre and feature.

    Size, mean and spread are those of the rows predicted to be the component's.
    """
    centres = model.clusterCenters()
    size = len(centres[0])
    held = _predicted(data, model).select("prediction", F.posexplode("x").alias("i", "value"))
    found = held.groupBy("prediction", "i").agg(
        F.count("*").alias("size"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")
    )
    model_rows = [(c, i, float(centres[c][i])) for c in range(len(centres)) for i in range(size)]
    listed = data.sparkSession.createDataFrame(model_rows, "component int, i int, centre double")
    joined = listed.join(found.withColumnRenamed("prediction", "component"), ["component", "i"], "left")
    return joined.select(
        "component", "i", F.coalesce("size", F.lit(0)).alias("size"), "centre", "mean",
        F.coalesce(F.abs(F.col("mean") - F.col("centre")) <= settled, F.lit(False)).alias("is_mean"), "spread",
    )


def split_tree(model: BisectingKMeansModel, scratch: Scratch) -> list[dict]:
    """The nodes of a bisecting model's tree: index, centre, size and the indices of the children."""
    path = f"{scratch.root}/bisecting"
    model.write().overwrite().save(path)
    nodes = scratch.spark.read.parquet(f"{path}/data/data").collect()  # two nodes for each cluster
    return [
        {"index": n["index"], "centre": n["center"].toArray().tolist(), "size": n["size"], "children": list(n["children"])}
        for n in nodes
    ]


def walked_tree(data: DataFrame, key: str, model: BisectingKMeansModel) -> DataFrame:
    """``(key, x, agrees)``: whether the row's way down the split tree ends at its predicted cluster.

    At each split a row goes to the child whose centre is nearer; a leaf's index is its cluster.
    """
    nodes = {n["index"]: n for n in split_tree(model, Scratch(data.sparkSession))}
    root = next(i for i in nodes if not any(i in n["children"] for n in nodes.values()))

    def end(index: int) -> Column:
        children = nodes[index]["children"]
        if not children:
            return F.lit(index)
        ends = [end(child) for child in children]
        distances = [_distance(F.col("x"), nodes[child]["centre"]) for child in children]
        nearest, found = distances[0], ends[0]
        for distance, at in zip(distances[1:], ends[1:]):
            found = F.when(distance < nearest, at).otherwise(found)
            nearest = F.least(nearest, distance)
        return found

    rows = _predicted(data, model)
    return rows.select(key, "x", (end(root) == F.col("prediction")).alias("agrees"))


def _log_densities(x: Column, model: GaussianMixtureModel) -> list[Column]:
    """Log of weight times density of each component, by the Cholesky factor of its covariance."""
    found = []
    for weight, gaussian in zip(model.weights, model.gaussians):
        factor = np.linalg.cholesky(gaussian.cov.toArray())
        inverse, mean = np.linalg.inv(factor), gaussian.mean.toArray()
        size = len(mean)
        constant = np.log(weight) - size / 2 * np.log(2 * np.pi) - np.log(np.diag(factor)).sum()
        total = F.lit(float(constant))
        for i in range(size):
            part = F.lit(0.0)
            for j in range(i + 1):
                part = part + F.lit(float(inverse[i, j])) * (F.get(x, F.lit(j)) - F.lit(float(mean[j])))
            total = total - part * part / 2
        found.append(total)
    return found


def mixture_shares(data: DataFrame, key: str, model: GaussianMixtureModel) -> DataFrame:
    """``(key, x, prediction, shares)``: each component's share of the row's density."""
    logs = F.array(*_log_densities(F.col("x"), model))
    rows = _predicted(data, model).withColumn("_log", logs)
    powers = F.transform("_log", lambda v: F.exp(v - F.array_max("_log")))
    rows = rows.withColumn("_power", powers)
    total = F.aggregate("_power", F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn("_total", total).select(
        key, "x", "prediction", F.transform("_power", lambda v: v / F.col("_total")).alias("shares")
    )


def likeliest_components(data: DataFrame, key: str, model: GaussianMixtureModel) -> DataFrame:
    """``(key, x, likeliest)``: whether no component has a larger share than the predicted one."""
    shares = mixture_shares(data, key, model)
    return shares.select(key, "x", (F.get("shares", "prediction") >= F.array_max("shares") - 1e-9).alias("likeliest"))


def mixture_step(data: DataFrame, model: GaussianMixtureModel, key: str, settled: float) -> DataFrame:
    """One more step of expectation and maximisation: ``(component, weight, next_weight, mean_moved, stays)``.

    ``mean_moved`` is the largest move of a coordinate of the mean; a settled fit stays where it is.
    """
    shares = mixture_shares(data, key, model).select("x", F.posexplode("shares").alias("component", "share"))
    size = len(model.gaussians[0].mean)
    sums = shares.groupBy("component").agg(
        F.sum("share").alias("total"),
        *(F.sum(F.col("share") * F.get("x", F.lit(i))).alias(f"m{i}") for i in range(size)),
    )
    rows = [(c, float(w), [float(v) for v in g.mean]) for c, (w, g) in enumerate(zip(model.weights, model.gaussians))]
    listed = data.sparkSession.createDataFrame(rows, "component int, weight double, mean array<double>")
    n = sums.agg(F.sum("total").alias("n"))
    moved = F.greatest(F.lit(0.0), *(F.abs(F.col(f"m{i}") / F.col("total") - F.get("mean", F.lit(i))) for i in range(size)))
    joined = listed.join(sums, "component").join(F.broadcast(n))  # one row
    return joined.select(
        "component", "weight", (F.col("total") / F.col("n")).alias("next_weight"), moved.alias("mean_moved")
    ).withColumn("stays", (F.abs(F.col("next_weight") - F.col("weight")) <= settled) & (F.col("mean_moved") <= settled))


def huber_settled(
    df: DataFrame, key: str, features: Sequence[str], label: str, fitted: DataFrame, params, settled: float = 1e-3
) -> DataFrame:
    """``(key, n, gradient, settled)`` of a Huber fit: the largest derivative of its loss, without a unit.

    The loss is that of ``linear_regression``; slopes are taken by standardised features.
    """
    rows = df.join(F.broadcast(fitted) if fitted.count() <= 100_000 else fitted, key)
    error = F.col(label) - F.col("intercept")
    for i, name in enumerate(features):
        error = error - F.get("slopes", F.lit(i)) * F.col(name)
    rows = rows.withColumn("_r", error).withColumn("_near", F.abs("_r") <= params.epsilon * F.col("scale"))
    pull = F.when(F.col("_near"), F.col("_r") / F.col("scale")).otherwise(params.epsilon * F.signum("_r"))
    rows = rows.withColumn("_pull", pull)
    square = F.when(F.col("_near"), (F.col("_r") / F.col("scale")) ** 2).otherwise(params.epsilon**2)
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg("_pull").alias("_b"),
        ((1 - F.avg(square)) / 2).alias("_s"),
        *(F.covar_pop("_pull", name).alias(f"_c{i}") for i, name in enumerate(features)),
        *(F.stddev_samp(name).alias(f"_d{i}") for i, name in enumerate(features)),
        *(F.first(F.get("slopes", F.lit(i))).alias(f"_w{i}") for i in range(len(features))),
    )
    by_slope = [
        F.abs(-F.col(f"_c{i}") / F.col(f"_d{i}") + params.reg_param * F.col(f"_w{i}") * F.col(f"_d{i}"))
        for i in range(len(features))
    ]
    largest = F.greatest(F.abs("_b"), F.abs("_s"), *by_slope)
    return sums.select(key, "n", largest.alias("gradient"), (largest <= settled).alias("settled"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the log of the gamma function, for positive numbers."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(6):  # the series below is exact to rounding above 6
        shift -= 1 / x
        x = x + 1
    square = 1 / (x * x)
    series = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return shift + np.log(x) - 0.5 / x - series


def topic_mixtures(data: DataFrame, key: str, model: LDAModel, iterations: int = 200) -> DataFrame:
    """``(key, x, topics, inferred)``: the model's topic weights and those inferred from its topic matrix.

    The inference alternates between a row's topic weights and its terms' topics until neither
    moves, for all rows of a batch at once.
    """
    matrix = model.topicsMatrix().toArray()
    log_terms = _digamma(matrix) - _digamma(matrix.sum(axis=0))
    terms, prior = np.exp(log_terms), model.estimatedDocConcentration().toArray()

    @F.pandas_udf("array<double>")
    def infer(x: pd.Series) -> pd.Series:
        counts = np.array(x.tolist(), float).reshape(len(x), -1)
        gamma = np.ones((len(x), len(prior)))
        for _ in range(iterations):
            topics = np.exp(_digamma(gamma) - _digamma(gamma.sum(axis=1, keepdims=True)))
            gamma = prior + topics * ((counts / (topics @ terms.T + 1e-100)) @ terms)
        gamma = gamma / gamma.sum(axis=1, keepdims=True)
        gamma[counts.sum(axis=1) == 0] = 0  # a row without terms has no topics
        return pd.Series(list(gamma))

    rows = _predicted(data, model)
    return rows.select(key, "x", vector_to_array("topicDistribution").alias("topics"), infer("x").alias("inferred"))


def inferred_topics(data: DataFrame, key: str, model: LDAModel, settled: float = 0.01) -> DataFrame:
    """``(key, x, agrees)``: whether the model's topic weights are those inferred, up to ``settled``."""
    apart = F.array_max(F.zip_with("topics", "inferred", lambda a, b: F.abs(a - b)))
    return topic_mixtures(data, key, model).select(key, "x", (apart <= settled).alias("agrees"))


def topic_bounds(data: DataFrame, model: LDAModel) -> DataFrame:
    """``(component, i, term, share, positive, bounds_agree)`` per topic and term.

    ``share`` is the term's share of its topic.  The bound on the perplexity is that on the
    likelihood for each token, which ``bounds_agree`` checks.
    """
    matrix = model.topicsMatrix().toArray()
    tokens = data.select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v).alias("n"))
    total = tokens.agg(F.sum("n")).first()[0]
    likelihood, perplexity = model.logLikelihood(data), model.logPerplexity(data)
    agree = bool(abs(perplexity * total + likelihood) <= 1e-3 * abs(likelihood))
    sums = matrix.sum(axis=0)
    rows = [
        (c, i, float(matrix[i, c]), float(matrix[i, c] / sums[c]), bool(matrix[i, c] > 0), agree)
        for c in range(matrix.shape[1])
        for i in range(matrix.shape[0])
    ]
    return data.sparkSession.createDataFrame(
        rows, "component int, i int, term double, share double, positive boolean, bounds_agree boolean"
    )
