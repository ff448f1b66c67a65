"""Size checks and skew handling shared by the operators.

``HOT_ROWS`` is the number of rows of one key that a single task may sort or window, and
``ARRAY_ROWS`` the number that one array may hold, of which an aggregating task keeps many; keys
above them are split by position.  ``BROADCAST_VALUES`` is the number of values, array items
included, that a side may have to be broadcast; a larger side is joined by shuffle, where AQE
splits skewed partitions.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 20_000_000
ARRAY_ROWS = 100_000
BROADCAST_VALUES = 4_000_000
# rows that make a fair shuffle partition
PARTITION_ROWS = 5_000_000
# keys that a filter names one by one; longer lists are joined
LISTED_KEYS = 300
# bytes of a batch of texts that a task hands to Python
TEXT_BATCH = 1 << 21


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; the table has {df.columns}")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must reach.

    A temporary folder stands in for an unset name only where driver and executors share one
    machine; on a cluster an unset name is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="areastats-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``TEXT_BATCH`` bytes.

    Spark's own limit, 64 MB, is held in several copies by each task and its worker, outside the
    heap.  A limit that the session has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, TEXT_BATCH)
    try:
        yield
    finally:
        spark.conf.unset(name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back."""
    return checkpoint_counted(df)[0]


def checkpoint_counted(df: DataFrame, *columns: Column | str) -> tuple[DataFrame, list[int]]:
    """Write the rows to the shared folder and read them back; count the columns' values on the way.

    This cuts the lineage, so a lost executor costs no recomputation and values drawn at random
    stay as they were.  It also gives the planner the true size: the estimates of an iterative
    plan multiply at every join, and ``DataFrame.checkpoint`` would hand them on.
    """
    return Scratch(df.sparkSession).write_counted(df, *[F.count(column) for column in columns])


class Scratch:
    """Tables of one job in a folder of its own in the shared folder.

    ``drop`` deletes a table that no later step reads.  What the job's answer still reads stays
    until whoever owns the shared folder empties it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/areastats-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them back."""
        return self.write_counted(df)[0]

    def write_counted(self, df: DataFrame, *aggregates: Column) -> tuple[DataFrame, list]:
        """Write the rows and read them back; compute the aggregates on the way."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        values: list = []
        if aggregates:
            seen = Observation()
            named = [value.alias(f"n{i}") for i, value in enumerate(aggregates)]
            df.observe(seen, *named).write.parquet(path)
            values = [seen.get[f"n{i}"] for i in range(len(aggregates))]
        else:
            df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(written)] = path
        written._scratch = self  # keeps the id taken while the table is known
        return written, values

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that this object wrote."""
        for df in written:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)


def is_small(rows: int, values: int) -> bool:
    """Whether so many rows of ``values`` values each may be broadcast."""
    return rows * values <= BROADCAST_VALUES


def small(df: DataFrame, rows: int, values: int) -> DataFrame:
    """Mark a side of ``rows`` counted rows of ``values`` values each for broadcast if it is small."""
    return F.broadcast(df) if is_small(rows, values) else df


class Split(NamedTuple):
    """Rows of ordinary keys, rows of hot keys if there are any, and the numbers of the latter."""

    even: DataFrame
    hot: DataFrame | None = None
    hot_keys: int = 0
    hot_rows: int = 0


def split_hot(df: DataFrame, key: str, limit: int | None) -> Split:
    """Split into rows of ordinary keys and rows of keys with more than ``limit`` rows.

    Rows without a key belong to no area and are left out.  The check reads the key column only
    and aggregates before it shuffles.  ``limit=None`` skips it for data known to be even.  Up to
    ``LISTED_KEYS`` hot keys are part of both filters, so nothing is written; more are joined.
    """
    keyed = df.filter(F.col(key).isNotNull())
    if limit is None:
        return Split(keyed)
    sizes = keyed.groupBy(key).agg(F.count("*").alias("_size")).filter(F.col("_size") > limit)
    listed = sizes.take(LISTED_KEYS + 1)
    if not listed:
        return Split(keyed)
    if len(listed) <= LISTED_KEYS:
        is_hot = F.col(key).isin([row[key] for row in listed])
        return Split(
            keyed.filter(~is_hot), keyed.filter(is_hot), len(listed), sum(row["_size"] for row in listed)
        )
    written, (hot_keys, hot_rows) = Scratch(df.sparkSession).write_counted(sizes, F.count("*"), F.sum("_size"))
    hot = small(written.select(key), hot_keys, 1)
    return Split(
        keyed.join(hot, key, "left_anti"), keyed.join(hot, key, "left_semi"), hot_keys, hot_rows
    )


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for that many rows: the session's number, or more where it is too low."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Give every core a share of a table that many passes will read.

    A table of few rows may come as one split; one of many rows comes in enough splits as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if rows < cores * PARTITION_ROWS else df


def number_rows(
    df: DataFrame, key: str, order: Sequence[str], keys: int, rows: int, heads: bool = False
) -> DataFrame:
    """Add ``_pos``, the 0-based position of a row within its key, for keys of any size.

    With ``heads`` a row also has ``_total``, the rows of its key, and ``_start``, the first order
    column of the key's first row.

    The table of ``keys`` keys and ``rows`` rows is range-partitioned by key, order and a hash of
    the row, so a key that holds a third of it is spread over a third of the partitions.  A row's
    position is its place in its partition plus the rows of the same key in earlier partitions;
    that offset table has at most one row per key and partition border.  Rows that are equal in
    every column are interchangeable, so a lost executor cannot change what is written.
    """
    partitions = partitions_for(df.sparkSession, rows)
    by = [key, *order, "_hash"]
    ranged = checkpoint(
        df.withColumn("_hash", F.xxhash64(*df.columns))
        .repartitionByRange(partitions, *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
        .drop("_hash")
    )
    of_key = Window.partitionBy(key)
    in_order = of_key.orderBy("_part")
    first = [F.min_by(order[0], "_at").alias("_start")] if heads else []
    offsets = ranged.groupBy(key, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"), *first
    )
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if heads:
        whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = offsets.withColumns(
            {"_total": F.sum("_n").over(whole), "_start": F.first("_start").over(whole)}
        )
    return (
        ranged.join(small(offsets.drop("_n"), keys + partitions, 6), [key, "_part"])
        .withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_part", "_at", "_first", "_before")
    )


def with_chunks(df: DataFrame, chunk_rows: int, halo: int) -> DataFrame:
    """Cut numbered rows into ``_chunk`` blocks that start with the ``halo`` rows before them.

    Copied rows carry ``_own = false``.
    """
    if chunk_rows < halo:
        raise ValueError("a chunk must hold at least the rows that the next one repeats")
    own = F.floor(F.col("_pos") / chunk_rows)
    tail = F.col("_pos") % chunk_rows >= chunk_rows - halo

    def block(chunk: Column, mine: bool) -> Column:
        return F.struct(chunk.alias("chunk"), F.lit(mine).alias("own"))

    blocks = F.when(tail, F.array(block(own, True), block(own + 1, False))).otherwise(
        F.array(block(own, True))
    )
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_chunk", F.col("_block.chunk"))
        .withColumn("_own", F.col("_block.own"))
        .drop("_block")
    )
