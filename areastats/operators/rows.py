"""Projection and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_day
from ..scale import LISTED_KEYS, require_columns, small

_COMPARE = {"=": eq, ">": gt, "<": lt, ">=": ge, "<=": le}


def project(
    df: DataFrame, key: str, features: Sequence[str], label: str | None = None
) -> DataFrame:
    """Key, features and, when named, the label under the name ``label``."""
    require_columns(df, key, *features, *([label] if label else []))
    columns = [F.col(key), *(F.col(name) for name in features)]
    if label:
        columns.append(F.col(label).alias("label"))
    return df.select(*columns)


def for_key(df: DataFrame, key: str, value) -> DataFrame:
    require_columns(df, key)
    return df.filter(F.col(key) == F.lit(value))


def request_frame(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """The requested keys as ``(req_ord, key)``; a key listed twice appears twice."""
    schema = T.StructType(
        [T.StructField("req_ord", T.IntegerType()), T.StructField(key, df.schema[key].dataType)]
    )
    return df.sparkSession.createDataFrame(list(enumerate(keys)), schema)


def key_list_rows(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Rows of the listed keys.

    A short list is part of the filter and so reaches the scan; a long one is a table, whose join
    is broadcast only while it is small.
    """
    distinct = list(dict.fromkeys(keys))
    if len(distinct) <= LISTED_KEYS:
        return df.filter(F.col(key).isin(distinct))
    wanted = request_frame(df, key, distinct).drop("req_ord")
    return df.join(small(wanted, len(distinct), 1), key, "left_semi")


def in_request_order(answers: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """The answers, one row per key, as ``(req_ord, ...)``: one for each place of the request.

    A repeated key is answered again; a key without an answer is skipped.
    """
    request = small(request_frame(answers, key, keys), len(keys), 2)
    columns = [answers[name] for name in answers.columns]
    return request.join(answers, request[key].eqNullSafe(answers[key])).select("req_ord", *columns)


def for_keys(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Rows of each requested key with its place in the request as ``req_ord``.

    A repeated key is answered again; a key without rows gives one row of nulls.  The table is
    filtered to the listed keys at the scan, and the request is the side that is broadcast.
    """
    require_columns(df, key)
    request = request_frame(df, key, keys)
    found = key_list_rows(df, key, keys)
    answered = found.join(small(request, len(keys), 2), key)
    present = found.select(key).distinct()
    empty = request.join(present, key, "left_anti")
    return answered.unionByName(empty, allowMissingColumns=True)


def between_dates(df: DataFrame, date: str, start, end) -> DataFrame:
    """Rows with ``start <= date <= end`` by day, both ends included.

    Bounds are ``datetime.date`` values, ISO days or full ``parse_day`` texts.  A timestamp
    column is compared with the instants that bound the range, so the filter needs no cast of
    the column and reaches the scan.
    """
    require_columns(df, date)
    first, last = _day(start), _day(end)
    column = F.col(date)
    kind = df.schema[date].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.filter(
            (column >= first.cast(kind)) & (column < F.date_add(last, 1).cast(kind))
        )
    return df.filter(column.between(first, last))


def _day(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and len(value) > 10:
        return parse_day(value)
    return F.lit(value).cast("date")


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in any of the columns, the key included."""
    return df.na.drop(subset=list(columns) if columns else None)


def find(df: DataFrame, criteria: Mapping | Iterable[tuple]) -> DataFrame:
    """Rows that match an example (``{"col": value}``) or comparisons (``("col", ">=", value)``).

    ``None`` in an example matches null.  No criteria match every row.
    """
    if isinstance(criteria, Mapping):
        criteria = [(name, "=", value) for name, value in criteria.items()]
    criteria = list(criteria)
    require_columns(df, *(name for name, _, _ in criteria))
    tests = []
    for name, symbol, value in criteria:
        if symbol not in _COMPARE:
            raise ValueError(f"unknown comparison {symbol!r}; use one of {sorted(_COMPARE)}")
        if value is None and symbol == "=":
            tests.append(F.col(name).isNull())
        else:
            tests.append(_COMPARE[symbol](F.col(name), F.lit(value)))
    return df.filter(reduce(and_, tests)) if tests else df


def parse_documents(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Replace a column of JSON documents by its fields."""
    require_columns(df, column)
    rest = [name for name in df.columns if name != column]
    return df.withColumn(column, F.from_json(column, schema)).select(*rest, f"{column}.*")
