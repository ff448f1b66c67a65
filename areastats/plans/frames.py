"""Keyed frames over the test tables, in place of the geographic collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.medians import median_per_key
from ..sources import load


def daily(spark: SparkSession, base: str) -> DataFrame:
    """One row per event type and day."""
    return (
        load(spark, base, "events")
        .groupBy(F.col("event_type").alias("gisjoin"), F.to_date("ts").alias("formatted_date"))
        .agg(F.count("*").alias("cases"), F.round(F.sum("value"), 2).alias("total_value"))
    )


def daily_user(spark: SparkSession, base: str) -> DataFrame:
    """One row per user and day: many keys."""
    return (
        load(spark, base, "events")
        .groupBy(
            F.concat(F.lit("U"), "user_id").alias("gisjoin"),
            F.to_date("ts").alias("formatted_date"),
        )
        .agg(F.count("*").alias("cases"))
    )


def readings(spark: SparkSession, base: str) -> DataFrame:
    """Measurements per supplier; net_price depends almost linearly on gross_price."""
    price = F.col("l_extendedprice")
    return load(spark, base, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("gis_join"),
        F.col("l_shipdate").alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_extendedprice",
        (price / 10000).alias("gross_price"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 10000).alias("net_price"),
    )


def _area_stats(customers: DataFrame, prefix: str, area: str) -> DataFrame:
    keyed = customers.select(F.concat(F.lit(prefix), area).alias("gisjoin"), "c_acctbal")
    return median_per_key(keyed, "gisjoin", "c_acctbal").select(
        "gisjoin",
        F.col("rows").alias("total_population"),
        F.round("median", 4).alias("median_household_income"),
    )


def state_stats(spark: SparkSession, base: str) -> DataFrame:
    nation = load(spark, base, "nation")
    customer = load(spark, base, "customer")
    return _area_stats(
        customer.join(nation, customer.c_nationkey == nation.n_nationkey), "R", "n_regionkey"
    )


def county_stats(spark: SparkSession, base: str) -> DataFrame:
    return _area_stats(load(spark, base, "customer"), "N", "c_nationkey")


def tract_stats(spark: SparkSession, base: str) -> DataFrame:
    orders = load(spark, base, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customer = load(spark, base, "customer")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(
        F.concat(F.lit("C"), "c_custkey").alias("gisjoin"),
        F.coalesce("n", F.lit(0)).alias("total_population"),
        F.col("c_acctbal").alias("median_household_income"),
    )


def block_stats(spark: SparkSession, base: str) -> DataFrame:
    lines = load(spark, base, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = load(spark, base, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.concat(F.lit("O"), "o_orderkey").alias("gisjoin"),
        F.coalesce("n", F.lit(0)).alias("total_population"),
        F.col("o_totalprice").alias("median_household_income"),
    )


_STATS = {
    "state_stats": state_stats,
    "county_stats": county_stats,
    "tract_stats": tract_stats,
    "block_stats": block_stats,
}


def load_stats(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A loader for ``load_resolution`` that derives the statistics from the test tables."""
    return _STATS[name](spark, base)
