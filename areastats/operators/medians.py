"""Exact medians per key, whatever the number of rows or of different values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import checkpoint, require_columns


def median_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows and exact median of each key: ``(key, rows, median)``.

    The median is a double: the middle value, or the mean of the two middle ones.  Null values count
    as rows and have no part in the median, which is null where all are null; NaN is the largest
    value.  Rows without a key are left out, an empty table has no answer.

    Equal values of a key are counted before the shuffle, so neither a hot key nor a hot value piles
    up.  The counts are range-partitioned by key and value; sums per key and partition tell the one or
    two partitions that hold a key's middle, and only there are running sums taken.  No task holds
    more of a key than one of its partitions.
    """
    require_columns(df, key, value)
    counts = (
        df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"))
        .filter(F.col("_key").isNotNull())
        .groupBy("_key", "_value")
        .agg(F.count("*").alias("_rows"), F.count("_value").alias("_n"))
    )
    ranged = checkpoint(
        counts.repartitionByRange("_key", "_value").withColumn("_part", F.spark_partition_id())
    )
    of_key = Window.partitionBy("_key")
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("_key", "_part")
        .agg(F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                "rows": F.sum("_rows").over(of_key),
                "_total": F.sum("_n").over(of_key),
            }
        )
        .filter(_holds_middle(F.col("_before"), F.col("_n")))
        .select("_key", "_part", "_before", "rows", "_total")
    )
    within = Window.partitionBy("_key", "_part").orderBy("_value")
    middle = (
        ranged.select("_key", "_part", "_value", "_n")
        .join(parts, ["_key", "_part"])
        .withColumn("_start", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
        .filter(_holds_middle(F.col("_start"), F.col("_n")))
    )
    return middle.groupBy(F.col("_key").alias(key)).agg(
        F.max("rows").alias("rows"), ((F.min("_value") + F.max("_value")) / 2).alias("median")
    )


def _holds_middle(start, n):
    """Whether the ``n`` places from ``start`` on hold a middle place of ``_total``.

    A key of nulls alone has no place; its group of no values starts at the middle and is kept.
    """
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return (start + n > low) & (start <= high)
