import datetime as dt

import pytest
from pyspark.sql import functions as F

from areastats.functions import array_mean, elem, has_json_key, int_range, json_key, parse_day, slice0
from areastats.operators import rows
from areastats.plans import pipeline
from areastats.sources import Resolution, count_tables, load_resolution, resolution_table, to_documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ranges_and_slices(spark):
    arr = F.array(*(F.lit(x) for x in (10, 20, 30, 40)))
    assert one(spark, elem(arr, 0)) == 10
    assert one(spark, elem(arr, 4)) is None
    assert one(spark, int_range(0, 3)) == [0, 1, 2]
    assert one(spark, int_range(3, 3)) == []
    assert one(spark, int_range(0, -5)) == []
    assert one(spark, slice0(arr, 1, 2)) == [20, 30]
    assert one(spark, slice0(arr, 3, 5)) == [40]


def test_array_mean_skips_nulls(spark):
    assert one(spark, array_mean(F.expr("array(1, null, 5)"))) == 3.0
    assert one(spark, array_mean(F.expr("array(cast(null as int))"))) is None
    assert one(spark, array_mean(F.expr("cast(array() as array<int>)"))) is None


def test_parse_day(spark):
    assert one(spark, parse_day("2020-01-25 00:00:00.000 UTC")) == dt.date(2020, 1, 25)
    assert one(spark, parse_day("2020-01-25 23:30:00.000 EST")) == dt.date(2020, 1, 26)
    with pytest.raises(ValueError):
        parse_day("25 January 2020")


def test_json(spark):
    df = spark.createDataFrame(
        [('{"GISJOIN": "G1", "a": 2}',), ('{"GISJOIN": null}',), ('{"b": 1}',), (None,)], "d string"
    )
    got = df.select(has_json_key("d", "GISJOIN"), json_key("d", "GISJOIN")).collect()
    assert [tuple(r) for r in got] == [(True, "G1"), (True, None), (False, None), (False, None)]
    parsed = rows.parse_documents(df.limit(1), "d", "GISJOIN string, a int").first()
    assert tuple(parsed) == ("G1", 2)


def test_for_keys_in_request_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    got = rows.for_keys(df, "k", ["b", "a", "x", "b"]).orderBy("req_ord", "v").collect()
    assert [(r["req_ord"], r["k"], r["v"]) for r in got] == [
        (0, "b", 3), (1, "a", 1), (1, "a", 2), (2, "x", None), (3, "b", 3),
    ]


def test_between_dates_is_inclusive_and_pushed(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, h) for d in (1, 2, 3, 4) for h in (0, 23)]
    path = str(tmp_path / "t")
    spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz").write.parquet(path)
    df = rows.between_dates(spark.read.parquet(path), "ts", dt.date(2024, 1, 2), "2024-01-03")
    assert sorted(r["ts"] for r in df.collect()) == days[2:6]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_find(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "k string, v int")
    assert rows.find(df, {"k": "b", "v": None}).count() == 1
    assert rows.find(df, [("v", ">=", 2)]).count() == 1
    assert rows.find(df, {}).count() == 3
    with pytest.raises(ValueError):
        rows.find(df, [("v", "~", 2)])
    with pytest.raises(ValueError):
        rows.find(df, {"nosuch": 1})


def test_project_and_drop_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, "x"), (None, 1.0, 2.0, "x")], "k string, f double, y double, rest string"
    )
    projected = rows.project(df, "k", ["f"], "y")
    assert projected.columns == ["k", "f", "label"]
    assert rows.drop_nulls(projected).count() == 1
    with pytest.raises(ValueError):
        rows.project(df, "k", ["nosuch"])


def test_documents_leave_nulls_out(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    assert [r["data"] for r in to_documents(df).collect()] == ['{"k":"a"}', '{"k":"b","v":2}']


def test_resolutions(spark):
    names = []
    load_resolution(spark, "", Resolution.TRACT, lambda s, b, n: names.append(n))
    assert names == ["tract_stats"]
    assert resolution_table(Resolution.BLOCK) == "block_stats"


def test_counts_in_request_order(spark):
    got = count_tables(spark, "/root/testdata/sf0.001", ["nation", "region", "nation"])
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [
        (0, "nation", 25), (1, "region", 5), (2, "nation", 25),
    ]
    with pytest.raises(ValueError):
        count_tables(spark, "", [])


def test_pipeline_stages(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 1.0)], "k string, d int, v double")
    got = pipeline.pipeline(
        df,
        pipeline.match([("v", ">", 1.0)]),
        pipeline.group_push("k", "d", "v"),
        pipeline.add_fields({"n": F.size("series")}),
        pipeline.explode("series", "x"),
        pipeline.sort("k", "x.date"),
        pipeline.select("k", "n", "x.value"),
    )
    assert [tuple(r) for r in got.collect()] == [("a", 2, 5.0), ("a", 2, 7.0)]
