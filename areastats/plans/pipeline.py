"""Direct queries: an ordered list of stages on one collection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import find
from ..operators.series import collect_series

Stage = Callable[[DataFrame], DataFrame]


def pipeline(df: DataFrame, *stages: Stage) -> DataFrame:
    """Apply the stages in order; any function from DataFrame to DataFrame is a stage."""
    for stage in stages:
        df = df.transform(stage)
    return df


def match(criteria) -> Stage:
    return lambda df: find(df, criteria)


def sort(*columns: str | Column) -> Stage:
    return lambda df: df.orderBy(*columns)


def add_fields(fields: Mapping[str, Column]) -> Stage:
    return lambda df: df.withColumns(dict(fields))


def group(keys: Sequence[str], **aggregates: Column) -> Stage:
    return lambda df: df.groupBy(*keys).agg(
        *(column.alias(name) for name, column in aggregates.items())
    )


def group_push(key: str, date: str, value: str, **options) -> Stage:
    """Group by key and collect the ordered array of ``{value, date}``."""
    return lambda df: collect_series(df, key, date, value, **options)


def select(*columns: str | Column) -> Stage:
    return lambda df: df.select(*columns)


def explode(column: str, alias: str) -> Stage:
    return lambda df: df.withColumn(alias, F.explode(column))
