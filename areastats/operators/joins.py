"""Joins of keyed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import require_columns

_HOW = ("inner", "left", "right", "outer")


def latest_per_key(df: DataFrame, key: str, order_by: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by ``order_by``; rows without a key are left out.

    Catalyst limits each map task's rows to one per key before the shuffle, so a key with many
    rows costs no more than one with few.
    """
    require_columns(df, key)
    last = Window.partitionBy(key).orderBy(*(_descending(column) for column in order_by))
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def last_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order_by``, and of equal ones by a hash; all rows without a key.

    One aggregation whose partial maxima leave a row per key and map task before the shuffle.
    """
    require_columns(df, key, *order_by)
    others = [name for name in df.columns if name != key]
    keyed = df.filter(F.col(key).isNotNull())
    order = F.struct(*(F.col(name) for name in order_by), F.xxhash64(*others) if others else F.lit(0))
    last = keyed.groupBy(key).agg(F.max_by(F.struct(F.lit(0).alias("_one"), *others), order).alias("_last"))
    last = last.select(*(key if name == key else F.col(f"_last.`{name}`").alias(name) for name in df.columns))
    return last.unionByName(df.filter(F.col(key).isNull()))


def _descending(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_last()


def with_surrogate_key(df: DataFrame, key: str) -> DataFrame:
    """Give every row without a key a unique text key that starts with ``~``.

    Use it on rows that are about to be returned: the value is random, so it must not decide a
    shuffle.  The joins below set keyless rows aside instead.
    """
    require_columns(df, key)
    return df.withColumn(
        key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.uuid()))
    )


def merge_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", order_by: Sequence[str] | None = None
) -> DataFrame:
    """Equi-join on the key with merged fields; the left value wins where names are equal.

    With ``order_by``, columns of both sides, each side is first reduced to the last row of every
    key, so that a key repeated on both sides is joined once and not once for each pair.  Without
    it the caller vouches for one row per key.

    In right and outer joins the right value is taken only where no left row matched, so a null
    of a matching left row stays.  Rows without a key match nothing.  They bypass the join, so
    they cannot pile up in one partition; the null test is pushed to the scan.
    """
    if how not in _HOW:
        raise ValueError(f"unknown join {how!r}; use one of {_HOW}")
    require_columns(left, key)
    require_columns(right, key)
    if order_by is not None:
        left, right = last_per_key(left, key, order_by), last_per_key(right, key, order_by)
    shared = [name for name in right.columns if name in left.columns and name != key]
    added = [name for name in right.columns if name not in left.columns]
    has_key = F.col(key).isNotNull()

    if how in ("inner", "left"):
        joined = left.filter(has_key).join(right.filter(has_key).select(key, *added), key, how)
    else:
        left_side = left.filter(has_key).withColumn("_matched", F.lit(True))
        right_side = right.filter(has_key).select(
            key, *added, *(F.col(name).alias(f"_right_{name}") for name in shared)
        )
        joined = left_side.join(right_side, key, "right" if how == "right" else "full")
        for name in shared:
            joined = joined.withColumn(
                name, F.when(F.col("_matched"), F.col(name)).otherwise(F.col(f"_right_{name}"))
            )
    joined = joined.select(key, *(name for name in left.columns if name != key), *added)
    kept = [left] * (how in ("left", "outer")) + [right] * (how in ("right", "outer"))
    for side in kept:
        if side.schema[key].nullable:
            joined = joined.unionByName(side.filter(~has_key), allowMissingColumns=True)
    return joined


def compound(node, key: str, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Join results that may themselves be joins.

    A node is a DataFrame, ``(node, node)`` for an inner join, or ``(node, how, node)``.  With
    ``order_by`` each DataFrame is first reduced to the last row of every key; without it the
    caller vouches for one row per key.  Rows without a key match nothing; where the join keeps
    them, or where the node is one DataFrame, they come back under surrogate text keys.
    """
    result = _joined(node, key, order_by)
    if isinstance(result.schema[key].dataType, T.StringType):
        return with_surrogate_key(result, key)
    return result


def _joined(node, key: str, order_by) -> DataFrame:
    if isinstance(node, DataFrame):
        if order_by is None:
            return node
        keyless = node.filter(F.col(key).isNull())
        return latest_per_key(node, key, order_by).unionByName(keyless)
    left, how, right = node if len(node) == 3 else (node[0], "inner", node[1])
    return merge_join(_joined(left, key, order_by), _joined(right, key, order_by), key, how)
