"""Registered queries: each operator over whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import array_mean, elem, has_json_key, int_range, json_key, parse_day, slice0
from ..operators import certificates, clustering, features, joins, linear, medians, metrics, rows, series, trees
from ..operators.params import BoostParams, ForestParams, LinearParams
from ..operators.per_key import per_key
from ..sources import Resolution, count_tables, load, load_resolution, to_documents
from ..scale import Scratch
from . import frames, pipeline

# fixed values: the collections of the test data in their usual order
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

STAT_FEATURES = ["total_population", "median_household_income"]


def _r(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits)


# --- sources and rows -----------------------------------------------------------------------


def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tables(spark, sf, TABLES)


def _resolution(resolution: Resolution):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return load_resolution(spark, sf, resolution, frames.load_stats)

    return query


def loaded_collection(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation")


def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf)
    return to_documents(
        stats.withColumn("total_population", F.nullif("total_population", F.lit(0)))
    )


def key_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events: few keys of many different values."""
    return medians.median_per_key(load(spark, sf, "events"), "event_type", "value").withColumn("median", _r("median"))


def project_label(spark: SparkSession, sf: str) -> DataFrame:
    projected = rows.project(
        frames.readings(spark, sf), "gis_join", ["gross_price", "l_discount"], "net_price"
    )
    return projected.withColumns(
        {"gross_price": _r("gross_price"), "label": _r("label")}
    )


def key_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rows.for_key(frames.readings(spark, sf), "gis_join", "S7").select(
        "gis_join", "l_orderkey", "l_linenumber", "l_extendedprice"
    )


REQUEST = ["click", "view", "nosuch", "click"]


def requested_keys(spark: SparkSession, sf: str) -> DataFrame:
    return rows.for_keys(frames.daily(spark, sf), "gisjoin", REQUEST)


def date_range_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rows.between_dates(
        frames.daily(spark, sf),
        "formatted_date",
        "2024-01-05 00:00:00.000 UTC",
        "2024-01-20 00:00:00.000 UTC",
    )


def timestamp_range_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "ts", "value")
    picked = rows.between_dates(events, "ts", "2024-01-05", "2024-01-20")
    return picked.select("event_id", "value")


def parsed_days(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))
    return load(spark, sf, "events").select("event_id", parse_day(text).alias("day"))


def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    readings = frames.readings(spark, sf).select(
        "gis_join", F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_quantity"
    )
    return rows.drop_nulls(readings)


def find_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = rows.find(
        load(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    )
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


def find_rows_compare(spark: SparkSession, sf: str) -> DataFrame:
    found = rows.find(
        load(spark, sf, "orders"),
        [("o_totalprice", ">=", 1000.0), ("o_totalprice", "<", 200000.0), ("o_custkey", ">", 9)],
    )
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select(
        "event_id",
        has_json_key("props", "k").alias("has_k"),
        has_json_key("props", "GISJOIN").alias("has_gisjoin"),
        json_key("props", "k").alias("k_text"),
        "props",
    )
    return rows.parse_documents(events, "props", "k bigint")


# --- joins ----------------------------------------------------------------------------------


def _order_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line sums per order and orders, of which the pending ones have no key."""
    lines = (
        load(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("O"), "l_orderkey").alias("gisjoin"))
        .agg(
            _r(F.sum("l_extendedprice"), 2).alias("price"),
            F.sum("l_quantity").alias("quantity"),
        )
    )
    key = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("O"), "o_orderkey"))
    orders = load(spark, sf, "orders").select(
        key.alias("gisjoin"), F.col("o_totalprice").alias("price"), "o_orderpriority"
    )
    return lines, orders


def _compound(how: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        lines, orders = _order_sides(spark, sf)
        return joins.merge_join(lines, orders, "gisjoin", how)

    return query


def _nation_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customers = (
        load(spark, sf, "customer")
        .groupBy(F.concat(F.lit("N"), "c_nationkey").alias("gisjoin"))
        .agg(F.count("*").alias("customers"), _r(F.sum("c_acctbal"), 2).alias("balance"))
    )
    suppliers = (
        load(spark, sf, "supplier")
        .groupBy(F.concat(F.lit("N"), "s_nationkey").alias("gisjoin"))
        .agg(F.count("*").alias("suppliers"), _r(F.sum("s_acctbal"), 2).alias("balance"))
    )
    nations = load(spark, sf, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("gisjoin"), F.col("n_name").alias("name")
    )
    return customers, suppliers, nations


def compound_nested(spark: SparkSession, sf: str) -> DataFrame:
    customers, suppliers, nations = _nation_sides(spark, sf)
    return joins.compound(((customers, suppliers), "right", nations), "gisjoin")


def _user_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user; those of user 13 have no key."""
    return load(spark, sf, "events").select(
        F.concat(F.lit("U"), F.nullif("user_id", F.lit(13))).alias("gisjoin"),
        "ts",
        "event_id",
        "event_type",
        "value",
    )


def compound_single(spark: SparkSession, sf: str) -> DataFrame:
    single = joins.compound(_user_events(spark, sf), "gisjoin", order_by=["ts", "event_id"])
    shown = F.when(F.col("gisjoin").startswith("~"), "~").otherwise(F.col("gisjoin"))
    return single.select(shown.alias("gisjoin"), "event_id", "event_type", "value")


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    latest = joins.latest_per_key(_user_events(spark, sf), "gisjoin", ["ts", "event_id"])
    return latest.select("gisjoin", "event_id", "event_type", "value")


def surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    keyed = joins.with_surrogate_key(_user_events(spark, sf), "gisjoin")
    per_key_ = keyed.groupBy("gisjoin").agg(F.count("*").alias("n"))
    lone = F.col("gisjoin").startswith("~")
    return per_key_.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("keys"),
        F.count_if(lone).alias("surrogates"),
        F.max(F.when(lone, F.col("n"))).alias("rows_per_surrogate"),
    )


# --- series ---------------------------------------------------------------------------------


def ordered_series(spark: SparkSession, sf: str) -> DataFrame:
    collected = series.collect_series(
        frames.daily(spark, sf), "gisjoin", "formatted_date", "cases"
    )
    return collected.select("gisjoin", "start_date", F.posexplode("series").alias("pos", "x")).select(
        "gisjoin", "start_date", "pos", F.col("x.date").alias("date"), F.col("x.value").alias("value")
    )


def ordered_series_split(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events: every key is longer than an array may be, so each series spans several."""
    per_array = 700
    collected = series.collect_series(
        load(spark, sf, "events"), "event_type", "ts", "value", ["event_id"], array_rows=per_array
    )
    points = collected.select("event_type", "chunk", F.posexplode("series").alias("at", "x"))
    return points.select(
        "event_type",
        (F.col("chunk") * per_array + F.col("at")).alias("pos"),
        F.col("x.value").alias("value"),
    )


def date_range_mean(spark: SparkSession, sf: str) -> DataFrame:
    mean = series.date_range_mean(
        frames.daily(spark, sf),
        "gisjoin",
        "click",
        "formatted_date",
        "cases",
        "2024-01-05 00:00:00.000 UTC",
        "2024-01-20 00:00:00.000 UTC",
    )
    return mean.select(_r("mean").alias("mean"))


def _rounded_average(result: DataFrame) -> DataFrame:
    return result.withColumn("avg", _r("avg"))


def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_average(
        series.moving_average(
            frames.daily(spark, sf), "gisjoin", "formatted_date", "cases", 7
        )
    )


def moving_average_users(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_average(
        series.moving_average(
            frames.daily_user(spark, sf), "gisjoin", "formatted_date", "cases", 7
        )
    )


def moving_average_requested(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_average(
        series.moving_average(
            frames.daily(spark, sf), "gisjoin", "formatted_date", "cases", 7, keys=REQUEST
        )
    )


def moving_average_split(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events: every key counts as hot, so the windows run in overlapping blocks."""
    events = load(spark, sf, "events")
    averaged = series.moving_average(
        events, "event_type", "ts", "value", 7, tiebreak=["event_id"], hot_rows=700
    )
    return averaged.select(
        "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"), _r("avg").alias("avg")
    )


def moving_average_array(spark: SparkSession, sf: str) -> DataFrame:
    averaged = series.moving_average_array(
        frames.daily(spark, sf), "gisjoin", "formatted_date", "cases", 7
    )
    return averaged.select(
        "gisjoin", "start_date", "num_days", "num_windows", F.explode("moving_averages").alias("m")
    ).select(
        "gisjoin",
        "start_date",
        "num_days",
        "num_windows",
        F.col("m.date").alias("date"),
        _r("m.avg").alias("avg"),
    )


def moving_average_array_split(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events in arrays far shorter than the series; no window may be lost at their borders."""
    averaged = series.moving_average_array(
        load(spark, sf, "events"), "event_type", "ts", "value", 7, ["event_id"], array_rows=50
    )
    return averaged.select("event_type", "num_windows", F.explode("moving_averages").alias("m")).select(
        "event_type",
        "num_windows",
        F.date_format("m.date", "yyyy-MM-dd HH:mm:ss").alias("second"),
        _r("m.avg").alias("avg"),
    )


def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Each array function on the daily series of a key."""
    collected = series.collect_series(
        frames.daily(spark, sf), "gisjoin", "formatted_date", "cases"
    )
    values = F.col("series").getField("value")
    return collected.select(
        "gisjoin",
        elem(values, 2).alias("third"),
        elem(values, 100_000).alias("beyond"),
        F.size(values).alias("length"),
        F.size(int_range(0, F.size(values) - 6)).alias("windows"),
        F.size(int_range(5, 5)).alias("empty_range"),
        F.array_join(slice0(values, 3, 4), ",").alias("slice"),
        F.array_join(F.transform(values, lambda x: x + 1), ",").alias("mapped"),
        _r(array_mean(values)).alias("mean"),
        _r(
            array_mean(F.transform(values, lambda x: F.when(x % 2 == 0, x)))
        ).alias("mean_of_even"),
    )


def direct_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.pipeline(
        load(spark, sf, "events"),
        pipeline.match([("value", ">=", 10.0)]),
        pipeline.add_fields({"day": F.to_date("ts")}),
        pipeline.group(["user_id", "day"], total=F.count("*")),
        pipeline.group_push("user_id", "day", "total"),
        pipeline.add_fields(
            {"num_days": F.col("total").cast("int"), "last": elem("series", F.size("series") - 1)["date"]}
        ),
        pipeline.select("user_id", "start_date", "num_days", "last"),
        pipeline.sort("user_id"),
    )


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    readings = frames.readings(spark, sf).select(
        "gis_join",
        F.col("net_price").alias("label"),
        (F.col("gross_price") * 0.98).alias("prediction"),
    )
    measured = metrics.regression_metrics(readings, by="gis_join")
    return measured.select("gis_join", "n", _r("rmse").alias("rmse"), _r("r2").alias("r2"))


# --- features -------------------------------------------------------------------------------


def assembled_features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    assembled = features.assemble(frames.county_stats(spark, sf), STAT_FEATURES)
    return assembled.select(
        "gisjoin", F.posexplode(vector_to_array("features")).alias("pos", "value")
    )


def min_max_scaled(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf).withColumn("constant", F.lit(3.0))
    scaled = features.min_max_scale(stats, [*STAT_FEATURES, "constant"])
    return scaled.select("gisjoin", *(_r(name).alias(name) for name in [*STAT_FEATURES, "constant"]))


def clustering_features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    stats = frames.tract_stats(spark, sf).withColumn(
        "total_population", F.nullif("total_population", F.lit(0))
    )
    prepared = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
    return prepared.select(
        "gisjoin", F.posexplode(vector_to_array("features")).alias("pos", "value")
    ).withColumn("value", _r("value"))


def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = features.train_test_split(
        load(spark, sf, "events").select("event_id"), 0.8, ["event_id"], 42
    )
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


# --- models ---------------------------------------------------------------------------------


def _linear(params: LinearParams, names: list[str] | None = None):
    names = names or ["gross_price"]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        fitted = linear.linear_regression(
            frames.readings(spark, sf), "gis_join", names, "net_price", params
        )
        return fitted.select(
            "gis_join",
            "total_iterations",
            _r("rmse").alias("rmse"),
            _r("r2").alias("r2"),
            _r("intercept").alias("intercept"),
            *(_r(F.get("slopes", F.lit(i))).alias(f"slope{i}") for i in range(len(names))),
            F.get("objective_history", F.lit(0)).alias("first_objective"),
        )

    return query


def per_key_models(spark: SparkSession, sf: str) -> DataFrame:
    """One MLlib fit per order priority, answered in request order."""
    from pyspark.ml.regression import LinearRegression

    def fit(mine: DataFrame) -> dict:
        model = LinearRegression(regParam=0.5, solver="normal").fit(
            features.assemble(mine, ["custkey"])
        )
        return {"slope": float(model.coefficients[0]), "rmse": model.summary.rootMeanSquaredError}

    orders = load(spark, sf, "orders").select(
        "o_orderpriority",
        F.col("o_custkey").cast("double").alias("custkey"),
        (F.col("o_totalprice") / 1000).alias("label"),
    )
    request = ["5-LOW", "1-URGENT", "nosuch", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    fitted = per_key(orders, "o_orderpriority", request, fit, "slope double, rmse double")
    return fitted.select(
        "req_ord", "o_orderpriority", _r("slope").alias("slope"), _r("rmse").alias("rmse")
    )


TREE_FEATURES = ["gross_price", "l_discount"]
# fixed values: the sample request of each kind of tree
FOREST = ForestParams(
    bootstrap=True,
    subsampling_rate=0.9,
    num_trees=10,
    feature_subset_strategy="sqrt",
    max_depth=4,
    max_bins=50,
    train_split=0.9,
    min_info_gain=0.01,
    min_instances_per_node=2,
    min_weight_fraction_per_node=0.1,
)
BOOST = BoostParams(
    subsampling_rate=0.9,
    step_size=0.1,
    feature_subset_strategy="sqrt",
    max_depth=4,
    max_bins=50,
    train_split=0.9,
    min_info_gain=0.01,
    min_instances_per_node=2,
    min_weight_fraction_per_node=0.1,
    loss_type="squared",
    max_iter=5,
)


def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    return trees.random_forest(
        frames.readings(spark, sf), "gis_join", TREE_FEATURES, "net_price", FOREST
    )


def gradient_boost(spark: SparkSession, sf: str) -> DataFrame:
    return trees.gradient_boost(
        frames.readings(spark, sf), "gis_join", TREE_FEATURES, "net_price", BOOST
    )


# few distinct values, each of them a cut, so that SQL can grow the same trees
PLAIN_FEATURES = ["l_discount", "l_tax"]
PLAIN_TREE = ForestParams(
    bootstrap=False, max_depth=2, max_bins=200, min_instances_per_node=5, train_split=0.8
)
PLAIN_BOOST = BoostParams(
    max_iter=3, step_size=0.3, max_depth=1, max_bins=200, min_instances_per_node=5, train_split=0.8
)


def _rounded_metrics(answer: DataFrame) -> DataFrame:
    return answer.withColumns({"rmse": _r("rmse"), "r2": _r("r2")})


def random_forest_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(
        trees.random_forest(
            frames.readings(spark, sf), "gis_join", PLAIN_FEATURES, "net_price", PLAIN_TREE,
            id_cols=["l_orderkey", "l_linenumber"],
        )
    )


def gradient_boost_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(
        trees.gradient_boost(
            frames.readings(spark, sf), "gis_join", PLAIN_FEATURES, "net_price", PLAIN_BOOST,
            id_cols=["l_orderkey", "l_linenumber"],
        )
    )


def _cluster(fit, **options):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        stats = frames.tract_stats(spark, sf)
        found = fit(stats, "gisjoin", STAT_FEATURES, 10, **options).predictions
        return found.select("gisjoin", "prediction")

    return query


def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf)
    return clustering.model_summary(clustering.kmeans(stats, "gisjoin", STAT_FEATURES, 10).model)


def model_summary_mixture(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf)
    model = clustering.gaussian_mixture(stats, "gisjoin", STAT_FEATURES, 3).model
    return clustering.model_summary(model)


def model_summary_lda(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf)
    model = clustering.lda(stats, "gisjoin", STAT_FEATURES, 3).model
    data = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
    return clustering.model_summary(model, data)


def _checked(fit, check, k: int = 10, **options):
    """A check of a clustering per area, beside the scaled features it was fitted on."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        stats = frames.tract_stats(spark, sf)
        data = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
        checked = check(data, "gisjoin", fit(stats, "gisjoin", STAT_FEATURES, k, **options).model)
        scaled = [_r(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(len(STAT_FEATURES))]
        return checked.select("gisjoin", *scaled, checked.columns[-1])

    return query


def kmeans_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Every centre is the mean of its members, and every area is a member once."""
    stats = frames.tract_stats(spark, sf)
    data = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
    model = clustering.kmeans(stats, "gisjoin", STAT_FEATURES, 10, max_iter=500, tol=1e-9).model
    centres = certificates.centres_of_members(data, model)
    total = centres.groupBy("i").agg(
        F.sum("size").alias("members"), _r(F.sum(F.col("size") * F.col("centre")) / F.sum("size")).alias("overall_mean")
    )
    return centres.join(total, "i").select(
        "component", "i", "is_mean", (F.col("size") > 0).alias("has_members"), "members", "overall_mean"
    )


def bisecting_kmeans_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves and sizes of the split tree: every split hands on all members of its node."""
    stats = frames.tract_stats(spark, sf)
    model = clustering.bisecting_kmeans(stats, "gisjoin", STAT_FEATURES, 10).model
    nodes = certificates.split_tree(model, Scratch(spark))
    sizes = {n["index"]: n["size"] for n in nodes}
    splits = [n for n in nodes if n["children"]]
    whole = all(n["size"] == sum(sizes[c] for c in n["children"]) for n in splits)
    rows = [(len(nodes) - len(splits), len(splits), whole, int(max(sizes.values())))]
    return spark.createDataFrame(rows, "leaves int, splits int, splits_are_whole boolean, members long")


def gaussian_mixture_step(spark: SparkSession, sf: str) -> DataFrame:
    """One more step leaves a settled mixture where it is."""
    stats = frames.tract_stats(spark, sf)
    data = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
    model = clustering.gaussian_mixture(stats, "gisjoin", STAT_FEATURES, 3).model
    step = certificates.mixture_step(data, model, "gisjoin", settled=0.01)
    total = step.agg(_r(F.sum("weight")).alias("weights"), _r(F.sum("next_weight")).alias("next_weights"))
    return step.join(F.broadcast(total)).select("component", "stays", "weights", "next_weights")  # one row


def lda_bounds(spark: SparkSession, sf: str) -> DataFrame:
    stats = frames.tract_stats(spark, sf)
    data = features.clustering_features(stats, "gisjoin", STAT_FEATURES)
    model = clustering.lda(stats, "gisjoin", STAT_FEATURES, 3).model
    bounds = certificates.topic_bounds(data, model)
    total = bounds.groupBy("component").agg(_r(F.sum("share")).alias("shares"))
    return bounds.join(total, "component").select("component", "i", "positive", "bounds_agree", "shares")


def huber_settled(spark: SparkSession, sf: str) -> DataFrame:
    """At every key's Huber fit the loss has no slope."""
    readings, params = frames.readings(spark, sf), LinearParams(loss="huber", max_iterations=50)
    fitted = linear.linear_regression(readings, "gis_join", ["gross_price"], "net_price", params)
    settled = certificates.huber_settled(readings, "gis_join", ["gross_price"], "net_price", fitted, params)
    return settled.select("gis_join", "n", "settled")


def compound_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events on both sides: the last large and the last small one of each user."""
    events = load(spark, sf, "events").withColumn("gisjoin", F.concat(F.lit("U"), "user_id"))
    large = events.filter("value >= 50").select("gisjoin", "event_id", "value")
    rest = events.filter("value < 50").select("gisjoin", "event_id", "event_type")
    return joins.merge_join(large, rest, "gisjoin", "outer", order_by=["event_id"])


def requested_fits(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped regression answered in request order, a repeated key again, unknown ones skipped."""
    fitted = linear.linear_regression(
        frames.readings(spark, sf), "gis_join", ["gross_price"], "net_price", LinearParams(reg_param=0.0),
        keys=["S3", "nosuch", "S1", "S3", "S2"],
    )
    return fitted.select(
        "req_ord", "gis_join", _r("intercept").alias("intercept"), _r(F.get("slopes", F.lit(0))).alias("slope")
    )


def requested_trees(spark: SparkSession, sf: str) -> DataFrame:
    answered = trees.random_forest(
        frames.readings(spark, sf), "gis_join", PLAIN_FEATURES, "net_price", PLAIN_TREE,
        keys=["S3", "nosuch", "S1", "S3", "S2"], id_cols=["l_orderkey", "l_linenumber"],
    )
    return _rounded_metrics(answered)


QUERIES = {
    "loaded_collection": loaded_collection,
    "collection_counts": collection_counts,
    "resolution_stats": _resolution(Resolution.COUNTY),
    "resolution_stats_state": _resolution(Resolution.STATE),
    "resolution_stats_tract": _resolution(Resolution.TRACT),
    "resolution_stats_block": _resolution(Resolution.BLOCK),
    "key_medians": key_medians,
    "result_documents": result_documents,
    "project_label": project_label,
    "key_rows": key_rows,
    "requested_keys": requested_keys,
    "date_range_rows": date_range_rows,
    "timestamp_range_rows": timestamp_range_rows,
    "parsed_days": parsed_days,
    "drop_null_rows": drop_null_rows,
    "find_rows": find_rows,
    "find_rows_compare": find_rows_compare,
    "json_fields": json_fields,
    "compound_inner": _compound("inner"),
    "compound_left": _compound("left"),
    "compound_right": _compound("right"),
    "compound_outer": _compound("outer"),
    "compound_nested": compound_nested,
    "compound_single": compound_single,
    "latest_per_key": latest_per_key,
    "surrogate_keys": surrogate_keys,
    "ordered_series": ordered_series,
    "ordered_series_split": ordered_series_split,
    "date_range_mean": date_range_mean,
    "regression_metrics": regression_metrics,
    "moving_average": moving_average,
    "moving_average_users": moving_average_users,
    "moving_average_requested": moving_average_requested,
    "moving_average_split": moving_average_split,
    "moving_average_array": moving_average_array,
    "moving_average_array_split": moving_average_array_split,
    "array_functions": array_functions,
    "direct_pipeline": direct_pipeline,
    "assembled_features": assembled_features,
    "min_max_scaled": min_max_scaled,
    "clustering_features": clustering_features,
    "train_test_split": train_test_split,
    "linear_regression_ols": _linear(LinearParams(reg_param=0.0)),
    "linear_regression_ridge": _linear(LinearParams()),
    "linear_regression_elastic": _linear(LinearParams(reg_param=1.0, elastic_net=0.5)),
    "linear_regression_lasso": _linear(
        LinearParams(reg_param=2.0, elastic_net=1.0, standardization=False)
    ),
    "linear_regression_origin": _linear(LinearParams(reg_param=0.5, fit_intercept=False)),
    "linear_regression_many": _linear(
        LinearParams(reg_param=0.0), ["gross_price", "l_discount"]
    ),
    "linear_regression_huber": _linear(LinearParams(loss="huber", max_iterations=50)),
    "per_key_models": per_key_models,
    "random_forest": random_forest,
    "gradient_boost": gradient_boost,
    "random_forest_plain": random_forest_plain,
    "gradient_boost_plain": gradient_boost_plain,
    "kmeans": _cluster(clustering.kmeans),
    "bisecting_kmeans": _cluster(clustering.bisecting_kmeans),
    "gaussian_mixture": _cluster(clustering.gaussian_mixture),
    "lda": _cluster(clustering.lda),
    "model_summary": model_summary,
    "model_summary_mixture": model_summary_mixture,
    "model_summary_lda": model_summary_lda,
    "kmeans_nearest": _checked(clustering.kmeans, certificates.nearest_centres, max_iter=100),
    "kmeans_centres": kmeans_centres,
    "bisecting_kmeans_walk": _checked(clustering.bisecting_kmeans, certificates.walked_tree),
    "bisecting_kmeans_tree": bisecting_kmeans_tree,
    "gaussian_mixture_likeliest": _checked(clustering.gaussian_mixture, certificates.likeliest_components, k=3),
    "gaussian_mixture_step": gaussian_mixture_step,
    "lda_inferred": _checked(clustering.lda, certificates.inferred_topics, k=3),
    "lda_bounds": lda_bounds,
    "huber_settled": huber_settled,
    "compound_latest": compound_latest,
    "requested_fits": requested_fits,
    "requested_trees": requested_trees,
}
