"""Rare values, draws that follow the row, and fits that do not settle."""

import math

import numpy as np
import pytest

from areastats import scale
from areastats.operators import linear, trees
from areastats.operators.params import BoostParams, ForestParams


def test_rare_values_are_split(spark):
    rows = [("k", float(i), v, 10.0 * v) for i in range(2000) for v in [0.0 if i % 100 else 1.0 + i // 100 % 2]]
    df = spark.createDataFrame(rows, "key string, id double, x double, y double")
    params = ForestParams(num_trees=1, bootstrap=False, max_depth=3)
    row = trees.random_forest(df, "key", ["x"], "y", params, id_cols=["id"]).first()
    assert row["rmse"] < 1e-6


def test_draws_do_not_follow_the_file_layout(spark):
    rng = np.random.default_rng(1)
    rows = [("k", i, float(rng.normal()), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, id long, x double, y double")
    params = ForestParams(num_trees=3, max_depth=3)
    one, two = (
        trees.random_forest(df.repartition(n, "id"), "key", ["x"], "y", params, id_cols=["id"]).first()["rmse"]
        for n in (1, 7)
    )
    assert one == pytest.approx(two, rel=1e-9)


def test_draws_are_uniform_and_poisson_counts_whole(spark):
    drawn = spark.range(40_000).select(trees._uniform("id", 7).alias("u"))
    low, high, mean = drawn.selectExpr("min(u)", "max(u)", "avg(u)").first()
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01
    draws = trees._Draws(1.0, True, 7)
    top = spark.sql(f"select {draws.sql(repr(1 - 2.0**-53) + 'D')} as n").first()["n"]
    assert top > 14 and sum(math.exp(-1) / math.factorial(k) for k in range(top + 1)) == pytest.approx(1, abs=1e-15)


@pytest.mark.parametrize("rate, poisson", [(0.9, True), (1.0, True), (0.3, False), (1.0, False)])
def test_rows_and_cells_draw_alike(spark, rate, poisson):
    draws = trees._Draws(rate, poisson, -5)
    ids = spark.range(3000).selectExpr("xxhash64(id) as id").withColumn("u", trees._uniform("id", -5 + 3))
    rows = ids.selectExpr("id", f"{draws.sql('u')} as n").collect()
    mine = draws.counts(np.array([r["id"] for r in rows]), 3)
    assert mine.tolist() == [float(r["n"]) for r in rows]


def test_one_join_per_depth(spark, monkeypatch):
    """Depth 8, whose last pass joins the slices with the trees once, and reads each once."""
    plans = []
    real = trees._Data.with_trees

    def seen(self, fields):
        found = real(self, fields)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(trees._Data, "with_trees", seen)
    rng = np.random.default_rng(2)
    rows = [("k", i, float(rng.normal()), float(rng.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, id long, x double, y double")
    params = ForestParams(num_trees=2, max_depth=8)
    trees.random_forest(df, "key", ["x"], "y", params, id_cols=["id"]).collect()
    assert len(plans) == 9 and all(plan.count("Join") == (k > 0) for k, plan in enumerate(plans))


def test_hot_key_in_many_slices(spark, monkeypatch):
    """The same trees whether a key is one slice or many."""
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.integers(0, 9)), float(rng.integers(0, 7)), float(rng.normal())) for k in ("hot", "a") for i in range(900 if k == "hot" else 60)]
    df = spark.createDataFrame(rows, "key string, id long, x double, z double, y double")
    params = ForestParams(num_trees=4, max_depth=4, subsampling_rate=0.8, feature_subset_strategy="1")

    def answers():
        got = trees.random_forest(df, "key", ["x", "z"], "y", params, id_cols=["key", "id"]).collect()
        return {r["key"]: (r["rmse"], r["r2"]) for r in got}

    monkeypatch.setattr(trees, "_FEWER", 100)
    whole = answers()
    monkeypatch.setattr(trees, "_SLICE_RECORDS", 50)
    sliced = answers()
    monkeypatch.setattr(trees, "_FEWER", 0)
    cells = answers()
    for key in whole:
        assert sliced[key] == pytest.approx(whole[key], rel=1e-9)
        assert cells[key] == pytest.approx(whole[key], rel=1e-9)


@pytest.mark.parametrize("boosted", [False, True])
@pytest.mark.parametrize("cells", [False, True])
def test_keys_of_one_slice_are_not_moved_for_their_trees(spark, monkeypatch, boosted, cells):
    """Where the trees are too many to be broadcast: the same answers, and only slices of larger keys are joined."""
    rng = np.random.default_rng(5)
    rows = [(f"k{j}", i, float(rng.integers(0, 9)), float(rng.integers(0, 7)), float(rng.normal())) for j in range(6) for i in range([60, 900, 2][j % 3])]
    df = spark.createDataFrame(rows, "key string, id long, x double, z double, y double")
    read, real = [], trees._Data.with_trees

    def seen(self, fields):
        found = real(self, fields)
        read.append({r["key"] for r in found.select("key").collect()})
        return found

    monkeypatch.setattr(trees._Data, "with_trees", seen)
    monkeypatch.setattr(trees, "_FEWER", 0 if cells else 100)

    def answers():
        read.clear()
        fit, params = trees.random_forest, ForestParams(num_trees=3, max_depth=3, subsampling_rate=0.8, feature_subset_strategy="1")
        if boosted:
            fit, params = trees.gradient_boost, BoostParams(max_iter=3, max_depth=2, step_size=0.3, subsampling_rate=0.5)
        got = fit(df, "key", ["x", "z"], "y", params, id_cols=["key", "id"]).collect()
        return {r["key"]: (r["rmse"], r["r2"]) for r in got}

    want = answers()
    assert read and len(want) >= 4
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 0)
    got = answers()
    assert not read
    monkeypatch.setattr(trees, "_SLICE_RECORDS", 300)
    sliced = answers()
    assert read and set().union(*read) == {"k1", "k4"}
    assert set(got) == set(sliced) == set(want)
    for key, (rmse, r2) in want.items():
        for found in (got[key], sliced[key]):
            assert [x is None for x in found] == [rmse is None, r2 is None]
            assert [x or 0 for x in found] == pytest.approx([rmse or 0, r2 or 0], rel=1e-9)


def test_answers_in_request_order(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.normal()), float(rng.normal())) for k in "abc" for i in range(60)]
    df = spark.createDataFrame(rows, "key string, id long, x double, y double")
    params = ForestParams(num_trees=2, max_depth=2)
    got = trees.random_forest(df, "key", ["x"], "y", params, keys=["c", "nosuch", "a", "c"], id_cols=["id"])
    found = {r["req_ord"]: r["key"] for r in got.collect()}
    assert found == {0: "c", 2: "a", 3: "c"} and got.columns[0] == "req_ord"
    many = ["c", *[f"no{i}" for i in range(100_000)], "a"]
    found = {r["req_ord"]: r["key"] for r in trees.random_forest(df, "key", ["x"], "y", params, keys=many, id_cols=["id"]).collect()}
    assert found == {0: "c", 100_001: "a"}


def objective(gram, cross, l1, beta):
    return beta @ gram @ beta / 2 - cross @ beta + (l1 * np.abs(beta)).sum()


@pytest.mark.parametrize("seed", range(6))
def test_active_sets_find_the_minimum(seed):
    """Against the conditions of a minimum, for independent, correlated and collinear features."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        size = int(rng.integers(1, 7))
        x = rng.normal(size=(30, size))
        if seed % 3 == 1:
            x = x + 20 * rng.normal(size=(30, 1))
        if seed % 3 == 2 and size > 1:
            x[:, -1] = x[:, 0] * 2
        y = x @ rng.normal(size=size) + rng.normal(size=30)
        gram, cross = x.T @ x / 30, x.T @ y / 30
        l1 = np.full(size, rng.choice([1e-6, 0.01, 0.3, 3.0])) * np.abs(cross).max()
        beta = linear._active_sets(gram, cross, l1)
        gradient = cross - gram @ beta
        tolerance = 1e-7 * max(np.abs(cross).max(), 1)
        on = beta != 0
        assert np.abs(gradient[on] - l1[on] * np.sign(beta[on])).max(initial=0) < tolerance
        assert (np.abs(gradient[~on]) - l1[~on]).max(initial=0) < tolerance


def test_collinear_keys_are_answered_beside_others(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key in ("plain", "near", "same"):
        for _ in range(60):
            x, z = rng.normal(), rng.normal()
            z = {"plain": z, "near": x * (1 + 1e-7) + 1e-9 * z, "same": 3 * x}[key]
            rows.append((key, x, z, 2 * x + z + rng.normal() / 10))
    df = spark.createDataFrame(rows, "key string, x double, z double, y double")
    params = linear.LinearParams(reg_param=0.01, elastic_net=1.0)
    both = {r["key"]: r for r in linear.linear_regression(df, "key", ["x", "z"], "y", params).collect()}
    alone = linear.linear_regression(df.filter("key = 'plain'"), "key", ["x", "z"], "y", params).first()
    assert both["plain"]["slopes"] == pytest.approx(alone["slopes"])
    assert set(both) == {"plain", "near", "same"} and all(r["rmse"] < 0.2 for r in both.values())
