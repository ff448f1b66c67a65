"""Named collections: one Parquet table per name under a base folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Loader = Callable[[SparkSession, str, str], DataFrame]


class Resolution(Enum):
    """Census resolutions, each with its own table of statistics."""

    STATE = "state"
    COUNTY = "county"
    TRACT = "tract"
    BLOCK = "block"


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def resolution_table(resolution: Resolution) -> str:
    return f"{resolution.value}_stats"


def load_resolution(
    spark: SparkSession, base: str, resolution: Resolution, loader: Loader = load
) -> DataFrame:
    """Load the statistics table of a resolution; ``loader`` may derive it from other tables."""
    return loader(spark, base, resolution_table(resolution))


def _load_rows_only(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of a collection without columns, which needs no look at its schema."""
    return spark.read.schema(StructType([])).parquet(f"{base.rstrip('/')}/{name}.parquet")


def count_tables(
    spark: SparkSession, base: str, names: Sequence[str], loader: Loader = _load_rows_only
) -> DataFrame:
    """Count the rows of each collection: ``(ord, collection, count)`` in request order.

    All counts are one plan, so the tables are scanned side by side and no column is read.
    """
    if not names:
        raise ValueError("name at least one collection")
    counts = [
        loader(spark, base, name)
        .agg(F.count("*").alias("count"))
        .select(F.lit(ord_).alias("ord"), F.lit(name).alias("collection"), "count")
        for ord_, name in enumerate(names)
    ]
    return reduce(DataFrame.unionByName, counts)
