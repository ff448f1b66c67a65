"""Shards of near-equal bytes: best-fit-decreasing packing of indivisible groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, number_rows
from ..scale import small as small_table
from .tables import id_and_text

#: A group is packed on its own when it has this share of all bytes or rows, so at most twice as
#: many groups as this number are.
LARGE_SHARE = 4_096
#: Smaller groups are packed in cells of about so many groups, each by one task.
CELL_GROUPS = 50_000


class FreeSpace:
    """Bins by free space in a balanced (AVL) search tree; equal spaces in order of the bin."""

    def __init__(self, spaces: Iterator[tuple[int, int]] = ()):
        self.root = None  # nodes are [key, left, right, height]
        for space, name in spaces:
            self.add(space, name)

    def add(self, space: int, name: int) -> None:
        self.root = self._add(self.root, (space, name))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least free space that is ``size`` or more."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best:
            self.root = self._remove(self.root, best)
        return best

    def take_roomiest(self) -> tuple[int, int]:
        """Remove and return the bin of most free space."""
        node = self.root
        while node[2]:
            node = node[2]
        best = node[0]
        self.root = self._remove(self.root, best)
        return best

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._balance(node)

    def _remove(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
            return self._balance(node)
        if node[1] is None or node[2] is None:
            return node[1] or node[2]
        heir = node[2]
        while heir[1]:
            heir = heir[1]
        node[2] = self._remove(node[2], heir[0])
        node[0] = heir[0]
        return self._balance(node)

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _balance(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        heavy = 1 if lean > 0 else 2
        child = node[heavy]
        if self._height(child[3 - heavy]) > self._height(child[heavy]):
            node[heavy] = self._rotate(child, 3 - heavy)
        return self._rotate(node, heavy)

    def _rotate(self, node, heavy):
        child = node[heavy]
        node[heavy], child[3 - heavy] = child[3 - heavy], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child


def best_fit_decreasing(
    sizes: list[tuple[int, object]], capacity: int | None = None, spaces: list[int] | None = None
) -> tuple[list[int], list[int]]:
    """Bin of each item of (size, name), and the free space of every bin.

    Items enter in order of decreasing size, equal sizes by name; each enters the bin of least
    free space that holds it.  With ``capacity`` a new bin of that capacity opens when none does,
    an item above the capacity getting a bin of its own.  With ``spaces`` the bins are given, and
    an item that fits in none enters the one of most free space.
    """
    free = list(spaces or [])
    tree = FreeSpace((space, b) for b, space in enumerate(free))
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1])):
        size = sizes[i][0]
        found = tree.take_tightest(size)
        if found is None and spaces is None:
            free.append(max(capacity, size))
            found = (free[-1], len(free) - 1)
        elif found is None:
            found = tree.take_roomiest()
        placed[i] = found[1]
        free[found[1]] = found[0] - size
        tree.add(free[found[1]], found[1])
    return placed, free


def _pack_cells(spaces: list[int], cells: int):
    """Each cell's groups into its share of every shard's free space."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        mine = [space * (cell + 1) // cells - space * cell // cells for space in spaces]
        sizes = list(zip(table.column("bytes").to_pylist(), table.column("key").to_pylist()))
        placed, _ = best_fit_decreasing(sizes, spaces=mine)
        return pa.table({"key": table.column("key"), "shard": pa.array(placed, pa.int32())})

    return run


def pack_groups(groups: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, list]:
    """Shard of every group of (key, bytes, n): small groups as a table, large ones as a list.

    The capacity is an equal share of all bytes.  Groups of a fixed share of all bytes or rows
    are few; the driver packs them first.  The space they leave is cut into equal parts, one for
    each cell of the other groups, and the cells are packed apart.  A group that no shard has room
    for, as a group larger than a shard, goes to the shard with most room.
    """
    total, rows, count = groups.agg(F.sum("bytes"), F.sum("n"), F.count(F.lit(1))).first()
    total, rows = total or 0, rows or 0
    is_large = (F.col("bytes") * LARGE_SHARE >= total) | (F.col("n") * LARGE_SHARE >= rows)
    large = [(row.bytes, bytes(row.key)) for row in groups.filter(is_large).select("key", "bytes").collect()]
    capacity = -(-total // shards)
    placed, free = best_fit_decreasing(large, spaces=[capacity] * shards)
    # a shard over its capacity has no room; the other ones take in what it has too much
    over = sum(-space for space in free if space < 0)
    open_shards = [b for b, space in enumerate(free) if space > 0]
    spaces = [max(0, space) for space in free]
    for k, b in enumerate(sorted(open_shards, key=lambda b: -spaces[b])):
        spaces[b] = max(0, spaces[b] - over // len(open_shards) - (k < over % len(open_shards)))
    cells = max(1, -(-count // CELL_GROUPS))
    small = (
        groups.filter(~is_large)
        .select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int").alias("cell"))
        .groupBy("cell")
        .applyInArrow(_pack_cells(spaces, cells), "key binary, shard int")
    )
    return scratch.write(small), [(key, b) for (_, key), b in zip(large, placed)]


def _open_bins(capacity: int, item: str):
    """Best-fit-decreasing packing of each cell's items into bins of its own."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column(item).to_pylist()
        placed, _ = best_fit_decreasing(list(zip(table.column("bytes").to_pylist(), names)), capacity=capacity)
        return table.append_column("bin", pa.array(placed, pa.int32()))

    return run


def pack_to_capacity(groups: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(key, shard) of every group of (key, bytes, n); shards of ``capacity`` bytes are numbered from 0.

    Groups are packed in cells of about ``CELL_GROUPS``, best fit decreasing.  What the bins of a
    cell leave free is less than a tenth but in a few; these are packed once more, as wholes.
    """
    count = groups.count()
    cell = lambda rows, *by: F.pmod(F.xxhash64(*by), F.lit(max(1, -(-rows // CELL_GROUPS)))).cast("int")
    placed = scratch.write(
        groups.select("key", "bytes", cell(count, "key").alias("cell"))
        .groupBy("cell")
        .applyInArrow(_open_bins(capacity, "key"), "key binary, bytes long, cell int, bin int")
    )
    bins = placed.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"))
    name = F.concat(F.lpad(F.col("cell").cast("string"), 10, "0"), F.lit("."), F.lpad(F.col("bin").cast("string"), 10, "0"))
    bins, (part_filled,) = scratch.write_counted(
        bins.withColumn("full", F.col("bytes") * 10 >= capacity * 9).withColumn("name", name), F.count_if(~F.col("full"))
    )
    again = bins.filter("not full").select("name", "bytes", cell(part_filled, "name").alias("cell"))
    again = again.groupBy("cell").applyInArrow(_open_bins(capacity, "name"), "name string, bytes long, cell int, bin int")
    joined = again.select("name", F.concat(F.lit("~"), "cell", F.lit("."), "bin").alias("last"))
    last = scratch.write(bins.filter("full").select("name", F.col("name").alias("last")).unionByName(joined))
    shards, (n,) = scratch.write_counted(last.select("last").distinct().withColumn("all", F.lit(0)), F.count(F.lit(1)))
    numbered = number_rows(shards, "all", ["last"], 1, n).select("last", F.col("_pos").cast("int").alias("shard"))
    of_bin = last.join(small_table(numbered, n, 2), "last").select("name", "shard")
    return placed.withColumn("name", name).join(of_bin, "name").select("key", "shard")


def shard_by_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16
) -> DataFrame:
    """``doc_id``, size, text_crc32, law, shard, slot and grown_shard of every row.

    A row's size is its UTF-8 bytes plus 1; a null text has size 1 and no crc32.  Rows of equal
    text form a group, null texts one and empty texts another, and a group stays in one shard.
    Shards have near-equal bytes (the law ``bytes``): two of them differ by no more than the
    largest groups of all cells together, or than the excess of groups larger than a shard.  Slots
    number a shard's rows from 0 in order of id; repeated rows get slots of their own.
    ``grown_shard`` belongs to another law and is null.  Texts are compared by their SHA-256.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows, groups = _rows_and_groups(docs, id_col, text_col, scratch)
    small, large = pack_groups(groups, shards, scratch)
    # the list has 2 * LARGE_SHARE groups at most
    listed = F.broadcast(spark.createDataFrame(large, "key binary, large_shard int"))
    return _numbered(rows, listed, small, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("_pos").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_by_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, size, text_crc32, shard and slot of every row, in shards of ``capacity`` bytes.

    Sizes, groups and slots are those of ``shard_by_bytes``; the number of shards follows from the
    packing, and a group above the capacity has a shard of its own.
    """
    if capacity < 1:
        raise ValueError("a shard must hold one byte at least")
    scratch = Scratch(docs.sparkSession)
    rows, groups = _rows_and_groups(docs, id_col, text_col, scratch)
    placed = scratch.write(pack_to_capacity(groups, capacity, scratch))
    total, shards = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], placed.agg(F.max("shard")).first()[0]
    # a group of so many rows would fill a task of the join: there are LARGE_SHARE of them at most
    large = groups.filter(F.col("n") * LARGE_SHARE >= total).select("key")
    listed = F.broadcast(placed.join(F.broadcast(large), "key").withColumnRenamed("shard", "large_shard"))
    numbered = _numbered(rows, listed, placed, (shards or 0) + 1)
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("_pos").alias("slot"))


def _rows_and_groups(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    rows = scratch.write(
        id_and_text(docs, id_col, text_col).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return rows, scratch.write(groups)


def _numbered(rows: DataFrame, listed: DataFrame, placed: DataFrame, shards: int) -> DataFrame:
    """Rows with their shards and, as ``_pos``, their slots; rows of listed groups do not move for it."""
    marked = rows.join(listed, "key", "left")
    sharded = (
        marked.filter("large_shard is not null")
        .withColumnRenamed("large_shard", "shard")
        .unionByName(marked.filter("large_shard is null").drop("large_shard").join(placed, "key"))
        .drop("key")
    )
    return number_rows(sharded, "shard", ["doc_id"], shards, rows.count())
