import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from areastats.operators import clustering, features, metrics, trees
from areastats.operators.params import BoostParams, ForestParams

KEYS = ("a", "b", "hot")


@pytest.fixture(scope="module")
def df(spark):
    """Few distinct feature values, so that every value is a cut and splits agree exactly."""
    rng = random.Random(11)
    rows = []
    for key, n in zip(KEYS, (150, 90, 700)):
        for i in range(n):
            x, z = rng.randint(0, 7), rng.randint(0, 5)
            rows.append((key, i, float(x), float(z), (x - 3) ** 2 + 2.0 * z + rng.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "k string, i int, x double, z double, y double").cache()


def assembled(df, key):
    train, test = features.train_test_split(df, 0.8, ["k", "i"], 42)
    to_vector = VectorAssembler(inputCols=["x", "z"], outputCol="features")
    return [to_vector.transform(side.filter(F.col("k") == key)) for side in (train, test)]


def judged(model, test):
    predicted = model.transform(test)
    return [
        RegressionEvaluator(labelCol="y", metricName=name).evaluate(predicted) for name in ("rmse", "r2")
    ]


@pytest.mark.parametrize("fewer", [0, 4], ids=["cells", "rows"])
def test_single_tree_equals_mllib(df, fewer, monkeypatch):
    monkeypatch.setattr(trees, "_FEWER", fewer)
    options = {"max_depth": 4, "min_instances_per_node": 3}
    params = ForestParams(bootstrap=False, min_info_gain=0.01, **options)
    got = {r["k"]: r for r in trees.random_forest(df, "k", ["x", "z"], "y", params, id_cols=["k", "i"]).collect()}
    assert set(got) == set(KEYS)
    for key in KEYS:
        train, test = assembled(df, key)
        model = RandomForestRegressor(
            labelCol="y", numTrees=1, bootstrap=False, maxDepth=4, minInstancesPerNode=3, minInfoGain=0.01
        ).fit(train)
        assert [got[key]["rmse"], got[key]["r2"]] == pytest.approx(judged(model, test), rel=1e-6)


@pytest.mark.parametrize("loss, fewer", [("squared", 0), ("squared", 4), ("absolute", 4)])
def test_boosting_equals_mllib(df, loss, fewer, monkeypatch):
    monkeypatch.setattr(trees, "_FEWER", fewer)
    params = BoostParams(max_depth=3, max_iter=4, step_size=0.3, loss_type=loss)
    got = {r["k"]: r for r in trees.gradient_boost(df, "k", ["x", "z"], "y", params, keys=["a", "hot"], id_cols=["k", "i"]).collect()}
    assert set(got) == {"a", "hot"}
    for key in got:
        train, test = assembled(df, key)
        model = GBTRegressor(labelCol="y", maxDepth=3, maxIter=4, stepSize=0.3, lossType=loss, featureSubsetStrategy="all").fit(train)
        assert [got[key]["rmse"], got[key]["r2"]] == pytest.approx(judged(model, test), rel=1e-6)


@pytest.mark.parametrize("fewer", [0, 4], ids=["cells", "rows"])
def test_bootstrapped_forest_is_as_good_as_mllib(df, fewer, monkeypatch):
    monkeypatch.setattr(trees, "_FEWER", fewer)
    params = ForestParams(num_trees=12, max_depth=5, subsampling_rate=0.9, feature_subset_strategy="all")
    first = trees.random_forest(df, "k", ["x", "z"], "y", params, id_cols=["k", "i"])
    for r in first.collect():
        train, test = assembled(df, r["k"])
        model = RandomForestRegressor(
            labelCol="y", numTrees=12, maxDepth=5, subsamplingRate=0.9, featureSubsetStrategy="all", seed=1
        ).fit(train)
        assert r["rmse"] == pytest.approx(judged(model, test)[0], rel=0.25)


def test_one_feature_per_node(df):
    params = ForestParams(num_trees=4, max_depth=3, feature_subset_strategy="1", bootstrap=False)
    got = trees.random_forest(df, "k", ["x", "z"], "y", params).collect()
    assert len(got) == 3 and all(r["rmse"] > 0 for r in got)


def test_small_keys(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("two", 1.0, 3.0), ("two", 2.0, 4.0)], "k string, x double, y double")
    got = trees.random_forest(df, "k", ["x"], "y", ForestParams(bootstrap=False, train_split=0.99))
    for r in got.collect():
        assert r["rmse"] is None and r["r2"] is None
    with pytest.raises(Exception, match="null in"):
        trees.random_forest(spark.createDataFrame([("a", None, 1.0)], "k string, x double, y double"), "k", ["x"], "y").collect()


def test_tree_parameters():
    assert ForestParams(subsampling_rate=1.5, max_depth=0, train_split=1.0) == ForestParams()
    assert ForestParams().num_trees == 1 and BoostParams(step_size=2.0).step_size == 0.1
    assert BoostParams().feature_subset_strategy == "all"
    with pytest.raises(ValueError):
        BoostParams(loss_type="nosuch")
    with pytest.raises(ValueError):
        ForestParams(impurity="gini")
    sizes = [trees._subset_size(s, 10, 5) for s in ("auto", "all", "sqrt", "log2", "onethird", "3", "0.25")]
    assert sizes == [4, 10, 4, 4, 4, 3, 3]
    with pytest.raises(ValueError):
        trees._subset_size("nosuch", 10, 5)


def test_metrics_equal_mllib(df):
    pairs = df.select("k", F.col("y").alias("label"), (F.col("x") * 2).alias("prediction"))
    got = {r["k"]: r for r in metrics.regression_metrics(pairs, by="k").collect()}
    for key in KEYS:
        mine = pairs.filter(F.col("k") == key)
        for name in ("rmse", "r2"):
            assert got[key][name] == pytest.approx(RegressionEvaluator(metricName=name).evaluate(mine))
    origin = metrics.regression_metrics(pairs, through_origin=True).first()
    evaluator = RegressionEvaluator(metricName="r2", throughOrigin=True)
    assert origin["r2"] == pytest.approx(evaluator.evaluate(pairs))
    flat = metrics.regression_metrics(pairs.withColumn("label", F.lit(1.0))).first()
    assert flat["r2"] is None
    assert metrics.regression_metrics(pairs.limit(0)).first()["rmse"] is None


def test_split_is_stable(df):
    train, test = features.train_test_split(df, 0.7, ["k", "i"])
    assert train.count() + test.count() == df.count()
    again, _ = features.train_test_split(df.repartition(7), 0.7, ["k", "i"])
    assert again.exceptAll(train).count() == 0 and 0.6 < train.count() / df.count() < 0.8
    with pytest.raises(ValueError):
        features.train_test_split(df, 1.0)


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 3.0, 5), ("c", 2.0, 5)], "k string, x double, c int")
    got = {r["k"]: (r["x"], r["c"]) for r in features.min_max_scale(df, ["x", "c"]).collect()}
    assert got == {"a": (0.0, 0.5), "b": (1.0, 0.5), "c": (0.5, 0.5)}
    with pytest.raises(Exception):
        features.assemble(spark.createDataFrame([(None,)], "x double"), ["x"]).collect()


@pytest.fixture(scope="module")
def areas(spark):
    rng = random.Random(2)
    centres = [(0, 0), (10, 0), (0, 10), (10, 10)]
    rows = [
        (f"G{c}-{i}", x + rng.gauss(0, 0.3), y + rng.gauss(0, 0.3))
        for c, (x, y) in enumerate(centres)
        for i in range(30)
    ]
    return spark.createDataFrame([*rows, ("Gnull", None, 1.0)], "k string, x double, y double").cache()


@pytest.mark.parametrize("fit", [clustering.kmeans, clustering.bisecting_kmeans, clustering.gaussian_mixture])
def test_clusters(areas, fit):
    found, model = fit(areas, "k", ["x", "y"], 4, seed=3)
    got = {r["k"]: r["prediction"] for r in found.collect()}
    assert len(got) == 120 and set(got.values()) <= set(range(4))
    again = {r["k"]: r["prediction"] for r in fit(areas, "k", ["x", "y"], 4, seed=3).predictions.collect()}
    assert again == got
    summary = clustering.model_summary(model)
    measures = {r["measure"] for r in summary.collect()}
    assert measures == ({"weight", "mean", "cov"} if fit is clustering.gaussian_mixture else {"center"})


def test_kmeans_assigns_the_nearest_centre(areas):
    found, model = clustering.kmeans(areas, "k", ["x", "y"], 4)
    centres = np.array(model.clusterCenters())
    points = features.clustering_features(areas, "k", ["x", "y"]).withColumn("features", vector_to_array("features"))
    for r in points.join(found, "k").collect():
        distances = ((centres - np.array(r["features"])) ** 2).sum(axis=1)
        assert distances[r["prediction"]] == pytest.approx(distances.min())


def test_lda(areas):
    found, model = clustering.lda(areas, "k", ["x", "y"], 3, max_iter=5)
    for r in found.collect():
        assert math.isclose(sum(r["topics"]), 1, rel_tol=1e-6)
        assert r["topics"][r["prediction"]] == max(r["topics"])
    data = features.clustering_features(areas, "k", ["x", "y"])
    summary = clustering.model_summary(model, data)
    assert {"term", "log_likelihood", "log_perplexity"} == {r["measure"] for r in summary.collect()}
    with pytest.raises(ValueError):
        clustering.lda(areas, "k", ["x", "y"], 1)


def test_fits_pass_over_few_partitions_with_all_rows(spark, areas):
    points = features.clustering_features(areas, "k", ["x", "y"])
    many = points.repartition(90).cache()
    gathered = clustering._gathered(many)
    assert gathered.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(row["k"] for row in gathered.collect()) == sorted(row["k"] for row in points.collect())
    few = points.coalesce(1).cache()
    assert clustering._gathered(few) is few
    for df in (many, gathered, few):
        df.unpersist()
