import pytest

from areastats.operators import joins

COLUMNS = ["k", "v", "l", "r"]


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [("a", 1, "la"), ("b", None, "lb"), (None, 9, "l?")], "k string, v int, l string"
    )
    right = spark.createDataFrame(
        [("b", 20, "rb"), ("c", 30, "rc"), (None, 90, "r?")], "k string, v int, r string"
    )
    return left, right


EXPECTED = {
    "inner": [("b", None, "lb", "rb")],
    "left": [("a", 1, "la", None), ("b", None, "lb", "rb"), (None, 9, "l?", None)],
    "right": [("b", None, "lb", "rb"), ("c", 30, None, "rc"), (None, 90, None, "r?")],
    "outer": [
        ("a", 1, "la", None), ("b", None, "lb", "rb"), ("c", 30, None, "rc"),
        (None, 9, "l?", None), (None, 90, None, "r?"),
    ],
}


@pytest.mark.parametrize("how", sorted(EXPECTED))
def test_left_wins_even_with_null(sides, how):
    got = joins.merge_join(*sides, "k", how)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(EXPECTED[how], key=repr)


def test_unknown_join(sides):
    with pytest.raises(ValueError):
        joins.merge_join(*sides, "k", "cross")


def test_latest_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w"), (None, 5, "v")],
        "k string, at int, v string",
    )
    got = joins.latest_per_key(df, "k", ["at"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", "y"), ("b", "w")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # one row per key leaves each map task


def test_surrogates_are_unique(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    keys = [r["k"] for r in joins.with_surrogate_key(df, "k").collect()]
    assert "a" in keys and len(set(keys)) == 3
    assert sum(k.startswith("~") for k in keys) == 2


def test_compound(spark, sides):
    left, right = sides
    third = spark.createDataFrame([("b", "t1", 1), ("b", "t2", 2)], "k string, t string, at int")
    nested = joins.compound(((left, right), joins.latest_per_key(third, "k", ["at"])), "k")
    assert [(r["k"], r["l"], r["r"], r["t"]) for r in nested.collect()] == [("b", "lb", "rb", "t2")]
    single = joins.compound(third, "k", order_by=["at"])
    assert [r["t"] for r in single.collect()] == ["t2"]
    kept = joins.compound((left, "outer", right), "k")
    keys = [r["k"] for r in kept.collect()]
    assert len(keys) == len(set(keys)) == 5 and sum(k.startswith("~") for k in keys) == 2


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_repeated_keys_are_joined_once(spark, how):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")], "k string, t int, l string")
    right = spark.createDataFrame([("a", 5, "p"), ("a", 4, "q"), ("c", 1, "r"), (None, 1, "m")], "k string, t int, r string")
    found = joins.merge_join(left, right, "k", how, order_by=["t"]).collect()
    rows = sorted((tuple(x) for x in found), key=str)
    want = [("a", 3, None, "p")]
    if how in ("left", "outer"):
        want += [("b", 1, "z", None), (None, 1, "n", None), (None, 1, "n", None)]
    if how in ("right", "outer"):
        want += [("c", 1, None, "r"), (None, 1, None, "m")]
    assert rows == sorted(want, key=str)


def test_a_hot_key_on_both_sides_is_one_row(spark):
    left = spark.range(20_000).selectExpr("'k' as k", "id as t")
    right = spark.range(20_000).selectExpr("'k' as k", "id as t", "id as v")
    assert [tuple(r) for r in joins.merge_join(left, right, "k", order_by=["t"]).collect()] == [("k", 19_999, 19_999)]
