"""Array functions with 0-based positions and end-exclusive ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _int(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def elem(arr: ColumnOrName, i: Column | int) -> Column:
    """Element at 0-based position ``i``; null outside the array."""
    return F.get(_col(arr), _int(i))


def int_range(start: Column | int, end: Column | int) -> Column:
    """Integers from ``start`` up to, but not including, ``end``; empty when ``end <= start``."""
    start, end = _int(start), _int(end)
    # the upper bound is clamped as well, because sequence counts down past its start
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(
        F.array().cast("array<int>")
    )


def slice0(arr: ColumnOrName, pos: Column | int, n: Column | int) -> Column:
    """``n`` elements from 0-based position ``pos``."""
    return F.slice(_col(arr), _int(pos) + 1, _int(n))


def array_mean(arr: ColumnOrName) -> Column:
    """Mean of the non-null elements; null when there are none."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        return F.when(x.isNull(), acc).otherwise(
            F.struct((acc["total"] + x.cast("double")).alias("total"), (acc["n"] + 1).alias("n"))
        )

    return F.aggregate(
        _col(arr), zero, add, lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"])
    )
