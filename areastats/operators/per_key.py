"""Model building for many keys at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import require_columns

MAX_PARALLEL = 20


def per_key(
    df: DataFrame,
    key: str,
    keys: Sequence,
    fit: Callable[[DataFrame], dict],
    schema: str,
    parallelism: int = MAX_PARALLEL,
) -> DataFrame:
    """Call ``fit`` on the rows of each requested key and return one answer row per key.

    ``fit`` takes the key's rows and returns a dict of the ``schema`` columns, which usually
    means that it fits an MLlib estimator.  The answers are ``(req_ord, key, *schema)`` in
    request order; repeated keys are answered again and keys without rows are skipped.

    The listed keys are filtered at the scan and cached once, in the partitions they were read
    in, so a key with many rows stays spread and every fit is a distributed job of its own.  At
    most 20 run at a time.  Jobs grow with the listed keys: for one model on each of many keys
    use the grouped fits of ``linear`` and ``trees``.
    """
    require_columns(df, key)
    spark = df.sparkSession
    distinct = list(dict.fromkeys(keys))
    rows = df.filter(F.col(key).isin(distinct)).persist(StorageLevel.MEMORY_AND_DISK)

    def answer(value):
        mine = rows.filter(F.col(key) == F.lit(value))
        return None if mine.isEmpty() else fit(mine)

    try:
        workers = max(1, min(parallelism, MAX_PARALLEL, len(distinct)))
        with ThreadPoolExecutor(workers) as pool:
            futures = [
                pool.submit(inheritable_thread_target(spark)(answer), value) for value in distinct
            ]
            answers = dict(zip(distinct, [future.result() for future in futures]))
    finally:
        rows.unpersist()

    names = [part.strip().split(" ")[0] for part in _columns(schema)]
    found = [
        (ord_, value, *(answers[value][name] for name in names))
        for ord_, value in enumerate(keys)
        if answers[value] is not None
    ]
    key_type = df.schema[key].dataType.simpleString()
    return spark.createDataFrame(found, f"req_ord int, {key} {key_type}, {schema}")


def _columns(schema: str) -> list[str]:
    """The column definitions of a schema text, split at its outer commas."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(schema):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]
