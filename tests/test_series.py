import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from areastats import scale
from areastats.operators import series

DAY = dt.date(2024, 1, 1)


def trailing(points, days):
    """Brute force on one key's ordered points."""
    answer = []
    for i in range(days - 1, len(points)):
        values = [v for _, v in points[i - days + 1 : i + 1] if v is not None]
        mean = round(sum(values) / len(values), 9) if values else None
        answer.append((points[i][0], mean, points[0][0]))
    return answer


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    lengths = {"hot": 260, "warm": 90, "short": 3, "one": 1}
    return {
        key: [
            (DAY + dt.timedelta(days=3 * i), None if i < 8 or rng.random() < 0.1 else rng.randint(0, 50))
            for i in range(n)
        ]
        for key, n in lengths.items()
    }


@pytest.fixture(scope="module")
def df(spark, data):
    flat = [(key, day, value) for key, points in data.items() for day, value in points]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame([*flat, (None, DAY, 1)], "k string, d date, v int")


def answers(result):
    return sorted(
        (r["k"], r["d"], None if r["avg"] is None else round(r["avg"], 9), r["start_date"])
        for r in result.collect()
    )


@pytest.mark.parametrize("days", [1, 4, 7, 40])
@pytest.mark.parametrize("hot_rows", [None, 10_000, 100, 20])
def test_moving_average(df, data, days, hot_rows):
    got = series.moving_average(df, "k", "d", "v", days, hot_rows=hot_rows)
    expected = sorted((k, *row) for k, points in data.items() for row in trailing(points, days))
    assert answers(got) == expected


@pytest.mark.parametrize("array_rows", [10_000, 50])
def test_array_form_equals_window_form(df, data, array_rows):
    arrays = series.moving_average_array(df, "k", "d", "v", 7, array_rows=array_rows)
    lengths = {(r["k"], r["total"], r["num_windows"]) for r in arrays.collect()}
    assert lengths == {(k, len(points), max(0, len(points) - 6)) for k, points in data.items()}
    form = arrays.select("k", "start_date", F.explode("moving_averages").alias("m"))
    got = form.select("k", F.col("m.date").alias("d"), F.col("m.avg").alias("avg"), "start_date")
    expected = sorted((k, *row) for k, points in data.items() for row in trailing(points, 7))
    assert answers(got) == expected


def test_series_is_ordered_and_whole(df, data):
    arrays = series.collect_series(df, "k", "d", "v", array_rows=50).orderBy("k", "chunk").collect()
    joined = {}
    for row in arrays:
        assert len(row["series"]) <= 50
        joined.setdefault(row["k"], []).extend((p["date"], p["value"]) for p in row["series"])
    assert joined == data


def test_long_arrays_take_linear_time(spark):
    long = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("d"), F.col("id").alias("v"))
    start = time.perf_counter()
    averages = series.moving_average_array(long, "k", "d", "v", 7)
    row = averages.select(F.size("moving_averages").alias("n"), F.col("moving_averages")[99_993]["avg"].alias("last")).first()
    assert (row["n"], row["last"]) == (99_994, 99_996.0)
    assert time.perf_counter() - start < 60


def test_requested_short_series(df, data):
    got = series.moving_average(df, "k", "d", "v", 7, keys=["short", "nosuch"]).collect()
    rows = {r["k"]: (r["d"], r["avg"], r["num_days"], r["start_date"]) for r in got}
    assert rows == {"short": (None, None, 7, data["short"][0][0]), "nosuch": (None, None, None, None)}


def test_requested_keys(df):
    got = series.moving_average(df, "k", "d", "v", 7, keys=["short", "warm", "nosuch", "warm"])
    counts = {r["req_ord"]: (r["k"], r["n"]) for r in got.groupBy("req_ord", "k").agg(F.count("avg").alias("n")).collect()}
    assert counts[0] == ("short", 0) and counts[2] == ("nosuch", 0)
    assert counts[1] == counts[3] and counts[1][0] == "warm"


def test_equal_dates_follow_the_tiebreak(spark):
    df = spark.createDataFrame(
        [("a", DAY, 3, 30), ("a", DAY, 1, 10), ("a", DAY, 2, 20)], "k string, d date, t int, v int"
    )
    got = series.moving_average(df, "k", "d", "v", 2, tiebreak=["t"])
    assert sorted(r["avg"] for r in got.collect()) == [15.0, 25.0]


def test_copies_of_a_row_are_spread(spark):
    copies = spark.range(600).select(F.lit("a").alias("k"), F.lit(DAY).alias("d"), F.lit(1).alias("v"))
    numbered = scale.number_rows(copies, "k", ["d", "v"], 1, 600)
    assert sorted(r["_pos"] for r in numbered.collect()) == list(range(600))
    assert series.moving_average(copies, "k", "d", "v", 5, hot_rows=100).count() == 596


def test_bad_window(df):
    with pytest.raises(ValueError):
        series.moving_average(df, "k", "d", "v", 0)
    with pytest.raises(ValueError):
        series.moving_average(df, "k", "nosuch", "v", 2)


def test_date_range_mean(df, data):
    end = DAY + dt.timedelta(days=60)
    values = [v for d, v in data["warm"] if d <= end and v is not None]
    got = series.date_range_mean(df, "k", "warm", "d", "v", DAY, end).first()["mean"]
    assert got == pytest.approx(sum(values) / len(values))
    with pytest.raises(ValueError):
        series.date_range_mean(df, "k", "warm", "d", "v", "not a date at all", end)


def test_checkpoints_go_to_the_folder_of_the_session(spark, checkpoints):
    before = set(checkpoints.iterdir())
    assert scale.checkpoint(spark.range(3)).count() == 3
    assert len(set(checkpoints.iterdir()) - before) == 1


def test_more_hot_keys_than_a_filter_lists(df, data, monkeypatch):
    listed = answers(series.moving_average(df, "k", "d", "v", 4, hot_rows=20))
    monkeypatch.setattr(scale, "LISTED_KEYS", 1)
    assert scale.split_hot(df, "k", 20).hot_keys == 2
    assert answers(series.moving_average(df, "k", "d", "v", 4, hot_rows=20)) == listed
