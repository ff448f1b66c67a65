import random
import statistics

import pytest

from areastats.operators.medians import median_per_key


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return {
        "hot": [rng.randint(0, 4_000) / 8 for _ in range(9_000)],
        "one_value": [2.5] * 3_000,
        "two_halves": [1.0] * 500 + [4.0] * 500,
        "odd": [rng.random() for _ in range(31)],
        "even": [rng.random() for _ in range(32)],
        "single": [-7.25],
        "some_nulls": [None, 3.0, None, None, 9.0],
        "all_null": [None, None],
    }


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_medians_of_keys_over_several_partitions(spark, data, partitions):
    flat = [(k, v, k) for k, values in data.items() for v in values]
    random.Random(3).shuffle(flat)
    # columns of the caller may be called as the answer's, or as those on the way
    df = spark.createDataFrame([*flat, (None, 5.0, "x")], "_key string, rows double, median string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["_key"]: (r["n"], r["m"]) for r in median_per_key(df, "_key", "rows").toDF("_key", "n", "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = {k: [v for v in values if v is not None] for k, values in data.items()}
    assert got == {k: (len(v), statistics.median(known[k]) if known[k] else None) for k, v in data.items()}


def test_whole_numbers_nan_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 2**53)], "k int, v long")
    assert sorted(map(tuple, median_per_key(df, "k", "v").collect())) == [(1, 2, 2.5), (2, 1, float(2**53))]
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert [tuple(r) for r in median_per_key(odd, "k", "v").collect()] == [("a", 3, 2.0)]
    assert median_per_key(odd.limit(0), "k", "v").collect() == []
    with pytest.raises(ValueError):
        median_per_key(odd, "k", "w")
