"""Time series per key: ordered arrays, trailing means and means over a date range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import (
    ARRAY_ROWS,
    HOT_ROWS,
    number_rows,
    partitions_for,
    require_columns,
    small,
    split_hot,
    with_chunks,
)
from .rows import between_dates, for_key, request_frame


def moving_average(
    df: DataFrame,
    key: str,
    date: str,
    value: str,
    days: int,
    tiebreak: Sequence[str] = (),
    keys: Sequence | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Trailing mean over the last ``days`` rows of each key.

    Gives ``(key, date, avg, num_days, start_date)``: the date is that of the window's last row,
    ``num_days`` the window length and ``start_date`` the first date of the key's series.  Only
    full windows are answered.  The window counts rows, so gaps between dates are not filled; a
    null value keeps its place and the mean skips it.  Rows with equal dates are ordered by
    ``tiebreak`` and then by value.  With ``keys`` the answers carry ``req_ord``, a repeated key
    is answered again, a key with too few rows for a window gives one row without date and mean, and
    an unknown key one row of nulls.

    Keys of up to ``hot_rows`` rows are windowed after one shuffle on the key.  Larger keys are
    numbered by range and windowed in overlapping blocks of that many rows.
    """
    if days < 1:
        raise ValueError("a window covers at least one row")
    require_columns(df, key, date, value, *tiebreak)
    if keys is not None:
        df = df.filter(F.col(key).isin(list(set(keys))))
    order = _order(date, value, tiebreak)
    rows = df.select(*dict.fromkeys([key, date, *tiebreak, value]))
    split = split_hot(rows, key, hot_rows)

    by_key = Window.partitionBy(key).orderBy(*order)
    result = split.even.select(
        key,
        date,
        F.avg(value).over(by_key.rowsBetween(1 - days, 0)).alias("avg"),
        F.first(date).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("start_date"),
        F.row_number().over(by_key).alias("_n"),
    ).filter(F.col("_n") >= days)
    result = result.select(key, date, "avg", F.lit(days).alias("num_days"), "start_date")

    if split.hot is not None:
        numbered = number_rows(split.hot, key, order, split.hot_keys, split.hot_rows, heads=True)
        blocks = with_chunks(numbered, max(hot_rows, days), days - 1).repartition(
            partitions_for(df.sparkSession, split.hot_rows), key, "_chunk"
        )
        in_block = Window.partitionBy(key, "_chunk").orderBy("_pos").rowsBetween(1 - days, 0)
        windowed = blocks.withColumn("avg", F.avg(value).over(in_block)).filter(
            F.col("_own") & (F.col("_pos") >= days - 1)
        )
        start = F.col("_start").alias("start_date")
        result = result.unionByName(windowed.select(key, date, "avg", F.lit(days).alias("num_days"), start))
    if keys is None:
        return result
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(date).alias("start_date"))
    return _in_request_order(result, sizes, key, keys, days)


def _order(date: str, value: str, tiebreak: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([date, *tiebreak, value]))


def _in_request_order(result: DataFrame, sizes: DataFrame, key: str, keys: Sequence, days: int) -> DataFrame:
    request = request_frame(result, key, keys)
    answered = result.join(small(request, len(keys), 2), key)
    short = sizes.filter(F.col("_n") < days).select(key, F.lit(days).alias("num_days"), "start_date")
    empty = request.join(sizes.filter(F.col("_n") >= days).select(key), key, "left_anti").join(short, key, "left")
    return answered.unionByName(empty, allowMissingColumns=True)


def collect_series(
    df: DataFrame,
    key: str,
    date: str,
    value: str,
    tiebreak: Sequence[str] = (),
    array_rows: int = ARRAY_ROWS,
    halo: int = 0,
) -> DataFrame:
    """Ordered arrays of ``{value, date}``: ``(key, chunk, offset, total, start_date, series)``.

    A key of up to ``array_rows`` rows is one array with ``chunk = 0``.  A longer one is cut
    into consecutive arrays of that many points, so no row has to hold an unbounded group; each
    array after the first starts with the ``halo`` points before it, which lets windows of
    ``halo + 1`` points be taken within one array.  ``offset`` is the position in the key of an
    array's first point, ``total`` the number of points of the whole key; lengths of a key are
    taken from ``total``, which does not depend on the cuts.
    """
    require_columns(df, key, date, value, *tiebreak)
    return _collect(df, key, date, value, tiebreak, array_rows, halo, None)


def _collect(df, key, date, value, tiebreak, array_rows, halo, days) -> DataFrame:
    """The arrays of ``collect_series``; with ``days`` also ``moving_averages``.

    The means are taken by a window over the rows, before these become arrays.
    """
    order = _order(date, value, tiebreak)
    rows = df.select(*dict.fromkeys([key, date, *tiebreak, value]))
    split = split_hot(rows, key, array_rows)

    def averaged(rows: DataFrame, by: list[str], order: list[str], position: Column) -> DataFrame:
        if days is None:
            return rows.withColumn("_avg", F.lit(None).cast("double")).withColumn("_full", F.lit(False))
        window = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("_avg", F.avg(value).over(window.rowsBetween(1 - days, 0))).withColumn(
            "_full", position.over(window) >= days if by == [key] else position
        )

    def collected(*by: str) -> Column:
        point = F.struct(F.col(value).alias("value"), F.col(date).alias("date"))
        mean = F.when(F.col("_full"), F.struct(F.col("_avg").alias("avg"), F.col(date).alias("date")))
        item = F.struct(F.struct(*by).alias("by"), point.alias("point"), mean.alias("mean"))
        return F.sort_array(F.collect_list(item)).alias("_sorted")

    def answer(arrays: DataFrame) -> DataFrame:
        columns = [key, "chunk", "offset", "total", "start_date", F.col("_sorted.point").alias("series")]
        if days is not None:
            means = F.filter(F.col("_sorted.mean"), lambda mean: mean.isNotNull())
            columns.append(means.alias("moving_averages"))
        return arrays.select(*columns)

    result = answer(
        averaged(split.even, [key], order, F.row_number())
        .groupBy(key)
        .agg(collected(*order))
        .select(
            key,
            F.lit(0).cast("bigint").alias("chunk"),
            F.lit(0).cast("bigint").alias("offset"),
            F.size("_sorted").cast("bigint").alias("total"),
            F.col("_sorted")[0]["point"]["date"].alias("start_date"),
            "_sorted",
        )
    )
    if split.hot is not None:
        numbered = number_rows(split.hot, key, order, split.hot_keys, split.hot_rows, heads=True)
        blocks = with_chunks(numbered, max(array_rows, halo), halo).repartition(
            partitions_for(df.sparkSession, split.hot_rows), key, "_chunk"
        )
        full = F.col("_own") & (F.col("_pos") >= (days or 1) - 1)
        cut = (
            averaged(blocks, [key, "_chunk"], ["_pos"], full)
            .groupBy(key, F.col("_chunk").alias("chunk"))
            .agg(
                collected("_pos"),
                F.min("_pos").alias("offset"),
                F.max("_own").alias("_any_own"),
                F.first("_total").alias("total"),  # one value per key, as is the start
                F.first("_start").alias("start_date"),
            )
            .filter("_any_own")
        )
        result = result.unionByName(answer(cut))
    return result


def with_series_info(series: DataFrame, days: int) -> DataFrame:
    """Add ``num_days``, the window length, and ``num_windows``, the full windows of the key."""
    windows = F.greatest(F.col("total") - (days - 1), F.lit(0)).cast("int")
    return series.withColumns({"num_days": F.lit(days), "num_windows": windows})


def moving_average_array(
    df: DataFrame,
    key: str,
    date: str,
    value: str,
    days: int,
    tiebreak: Sequence[str] = (),
    array_rows: int = ARRAY_ROWS,
) -> DataFrame:
    """Trailing means as arrays of ``{avg, date}``: ``collect_series`` with ``moving_averages``.

    Also gives ``num_days`` and ``num_windows``.  The arrays of a long key overlap by
    ``days - 1`` points, so together they hold every full window once; a series shorter than the
    window has an empty array.  ``moving_average`` gives the same rows faster; this form answers
    documents.
    """
    if days < 1:
        raise ValueError("a window covers at least one row")
    require_columns(df, key, date, value, *tiebreak)
    arrays = _collect(df, key, date, value, tiebreak, array_rows, days - 1, days)
    return with_series_info(arrays, days)


def date_range_mean(df: DataFrame, key: str, value, date: str, column: str, start, end):
    """Mean of a column for one key over an inclusive range of days, as one row ``mean``."""
    require_columns(df, key, date, column)
    rows = between_dates(for_key(df, key, value), date, start, end)
    return rows.agg(F.avg(column).alias("mean"))
