"""The same answers where nothing is small enough to be broadcast."""

import pytest
from check_oracles import compare

from areastats import scale
from areastats.operators.linear import linear_regression
from areastats.operators.params import LinearParams
from areastats.plans import frames

SF = "/root/testdata/sf0.001"


@pytest.fixture
def nothing_small(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "name",
    [
        "requested_keys",
        "moving_average_split",
        "moving_average_requested",
        "ordered_series_split",
        "random_forest_plain",
        "gradient_boost_plain",
    ],
)
def test_query(spark, nothing_small, name):
    assert compare(spark, SF, name) == ""


def test_huber(spark, nothing_small, monkeypatch):
    def fitted():
        params = LinearParams(loss="huber", max_iterations=20)
        rows = linear_regression(frames.readings(spark, SF), "gis_join", ["gross_price"], "net_price", params)
        return {r["gis_join"]: (r["rmse"], r["intercept"], *r["slopes"]) for r in rows.collect()}

    shuffled = fitted()
    monkeypatch.setattr(scale, "BROADCAST_VALUES", 4_000_000)
    broadcast = fitted()
    assert shuffled.keys() == broadcast.keys()
    for key, values in shuffled.items():
        assert values == pytest.approx(broadcast[key], rel=1e-6)


def test_hot_key_of_huber_is_dealt_over_slices(spark, nothing_small, monkeypatch):
    """Rows of one key go to many groups of the first sum, and a row per slice to the second."""
    from pyspark.sql import functions as F

    from areastats.operators import linear

    seen = []
    real = linear._huber_sums

    def watched(rows, trials, *more):
        seen.append((rows.groupBy("_slice").count().count(), trials.select(F.countDistinct("_slice")).first()[0]))
        return real(rows, trials, *more)

    monkeypatch.setattr(linear, "_huber_sums", watched)
    hot = spark.range(2000).selectExpr("'k' as k", "cast(id % 100 as double) as x", "2 * (id % 100) + (id % 7) as y")
    linear_regression(hot, "k", ["x"], "y", LinearParams(loss="huber", max_iterations=3)).collect()
    assert seen and all(pair == (linear._SLICES, linear._SLICES) for pair in seen)
