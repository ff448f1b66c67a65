import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from areastats.operators.linear import linear_regression
from areastats.operators.params import LinearParams


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = []
    for key, slope in (("a", 2.0), ("b", -0.7)):
        for _ in range(80):
            x, z = rng.gauss(50, 4), rng.uniform(-1, 3)
            noise = rng.gauss(0, 1) if rng.random() < 0.85 else rng.gauss(0, 25)
            made.append((key, x, z, 7 + slope * x - 3 * z + noise))
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, x double, z double, y double").cache()


def mllib(df, key, features, params):
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df.filter(df.k == key))
    return LinearRegression(
        labelCol="y", loss=params.loss, regParam=params.reg_param,
        elasticNetParam=params.elastic_net, fitIntercept=params.fit_intercept,
        standardization=params.standardization, epsilon=params.epsilon, maxIter=500, tol=1e-12,
    ).fit(data)


def check(got, model, tolerance):
    assert got["intercept"] == pytest.approx(model.intercept, rel=tolerance, abs=tolerance)
    assert got["slopes"] == pytest.approx(list(model.coefficients), rel=tolerance, abs=tolerance)
    assert got["rmse"] == pytest.approx(model.summary.rootMeanSquaredError, rel=tolerance)
    assert got["r2"] == pytest.approx(model.summary.r2, rel=tolerance, abs=tolerance)


@pytest.mark.parametrize("features", [["x"], ["x", "z"]], ids=["one", "two"])
@pytest.mark.parametrize(
    "options",
    [
        {"reg_param": 0.0},
        {},
        {"fit_intercept": False},
        {"standardization": False, "reg_param": 1.0},
        {"reg_param": 1.0, "elastic_net": 0.5},
        {"reg_param": 2.0, "elastic_net": 1.0, "standardization": False},
        {"reg_param": 0.3, "elastic_net": 0.7, "fit_intercept": False},
    ],
)
def test_equals_mllib(df, features, options):
    params = LinearParams(**options)
    got = {r["k"]: r for r in linear_regression(df, "k", features, "y", params).collect()}
    assert set(got) == {"a", "b"}
    for key in got:
        check(got[key], mllib(df, key, features, params), 1e-5)
    assert got["a"]["total_iterations"] == (None if params.elastic_net else 0)


@pytest.mark.parametrize(
    "features, options",
    [
        (["x"], {"reg_param": 0.0}),
        (["x"], {"fit_intercept": False}),
        (["x", "z"], {}),
        (["x", "z"], {"standardization": False}),
    ],
)
def test_huber_equals_mllib(df, features, options):
    params = LinearParams(loss="huber", max_iterations=60, tolerance=1e-12, **options)
    got = {r["k"]: r for r in linear_regression(df, "k", features, "y", params).collect()}
    for key in ("a", "b"):
        check(got[key], mllib(df, key, features, params), 1e-4)
        history = got[key]["objective_history"]
        assert all(b <= a for a, b in zip(history, history[1:]))


def test_degenerate_keys(spark):
    df = spark.createDataFrame(
        [("flat_x", 1.0, 2.0), ("flat_x", 1.0, 4.0), ("flat_y", 1.0, 5.0), ("flat_y", 2.0, 5.0), ("one", 3.0, 9.0)],
        "k string, x double, y double",
    )
    got = {r["k"]: r for r in linear_regression(df, "k", ["x"], "y").collect()}
    for key, mean in (("flat_x", 3.0), ("flat_y", 5.0), ("one", 9.0)):
        assert (got[key]["slopes"], got[key]["intercept"]) == ([0.0], mean)
    assert got["flat_x"]["r2"] == 0 and got["flat_x"]["rmse"] == 1
    assert got["flat_y"]["r2"] is None and got["flat_y"]["rmse"] == 0
    assert got["one"]["r2"] is None and got["one"]["rmse"] == 0
    two = {r["k"]: r for r in linear_regression(df.withColumn("z", df.x * 2), "k", ["x", "z"], "y").collect()}
    assert two["flat_y"]["r2"] is None and two["flat_x"]["slopes"] == [0.0, 0.0]
    huber = LinearParams(loss="huber")
    settled = {r["k"]: r for r in linear_regression(df, "k", ["x"], "y", huber).collect()}
    assert settled["flat_y"]["intercept"] == pytest.approx(5.0)
    assert settled["one"]["rmse"] == pytest.approx(0.0)


def test_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 9.0), (None, 1.0, 1.0)], "k string, x double, y double"
    )
    with pytest.raises(Exception, match="null among"):
        linear_regression(df, "k", ["x"], "y").collect()
    (got,) = linear_regression(df, "k", ["x"], "y", LinearParams(reg_param=0.0), nulls="drop").collect()
    assert got["slopes"] == pytest.approx([2.0])


def test_iterative_solver_answers_in_request_order(df):
    params = LinearParams(solver="l-bfgs", reg_param=0.0, max_iterations=90, tolerance=1e-10)
    got = linear_regression(df, "k", ["x"], "y", params, keys=["b", "nosuch", "a", "b"]).orderBy("req_ord").collect()
    assert [(r["req_ord"], r["k"]) for r in got] == [(0, "b"), (2, "a"), (3, "b")]
    closed = {r["k"]: r for r in linear_regression(df, "k", ["x"], "y", LinearParams(reg_param=0.0), keys=["a", "b"]).collect()}
    for r in got:
        assert r["slopes"] == pytest.approx(closed[r["k"]]["slopes"], rel=1e-5)
        assert r["total_iterations"] >= 1 and len(r["objective_history"]) >= 1
    with pytest.raises(ValueError):
        linear_regression(df, "k", ["x"], "y", params)


def test_bad_requests(df):
    for params in (
        LinearParams(loss="huber", elastic_net=0.5),
        LinearParams(loss="nosuch"),
        LinearParams(solver="nosuch"),
        LinearParams(loss="huber", solver="normal"),
    ):
        with pytest.raises(ValueError):
            linear_regression(df, "k", ["x"], "y", params)
    with pytest.raises(ValueError):
        linear_regression(df, "k", [], "y")


def test_one_shuffle(df):
    plan = linear_regression(df, "k", ["x"], "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan


def test_values_out_of_range_become_defaults():
    params = LinearParams(max_iterations=100, reg_param=11, elastic_net=-1, epsilon=1.0, loss=" ", aggregation_depth=11)
    assert params == LinearParams()
    assert LinearParams(max_iterations=0, reg_param=0.0).max_iterations == 0
    assert not math.isnan(params.tolerance)
