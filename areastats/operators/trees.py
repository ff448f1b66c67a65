"""Random forests and boosted trees, one model per key, grown for all keys together.

A tree split depends on a row only through the bins of its features.  Where the combinations of
bins are few against the rows, the rows are first reduced to cells, one per key and combination,
with the sums of every sample drawn from them; elsewhere the binned rows are kept with their
sample counts.  Either way the records of a key are packed once into slices of bounded size.

Trees grow level by level: one pass over the slices per depth joins each with its key's trees so
far, walks its records down them, and sums histograms of the nodes to be split.  A key of one
slice has its splits at once; the histograms of the others are added up by node first.  So the
number of jobs follows the depth and not the number of keys, a key with many rows is spread over
many tasks, and no pass writes the rows again.

Where the trees of all keys may be too many to be broadcast, every such join would move all
records.  A key of one slice has all it needs in one place, so there one pass grows all trees of
those keys, depth by depth, and tests them.  Only larger keys are left to the passes per depth:
they have more than ``_SLICE_RECORDS`` records each, so their trees are few beside their records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, is_small, partitions_for, require_columns, small, spread
from .features import split_bucket
from .metrics import r2_column
from .params import BoostParams, ForestParams
from .rows import in_request_order, key_list_rows

# the largest uniform number that a row can draw
_LARGEST = 1 - 2.0**-53

# cells must be at least this many times fewer than the rows to be worth a shuffle
_FEWER = 4

# records of one slice, which one task holds in memory
_SLICE_RECORDS = 50_000

# records times trees that are walked at once, and histogram places that are judged at once
_WALKED, _JUDGED = 1 << 20, 1 << 20

# node numbers below a tree's in one code
_NODE_BITS = 31


def random_forest(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    params: ForestParams | None = None,
    keys: Sequence | None = None,
    id_cols: Sequence[str] = (),
) -> DataFrame:
    """Fit a forest per key on its training rows: ``(key, rmse, r2)`` of the test rows.

    Rows are split by ``train_test_split``'s hash of ``id_cols`` (key, features and label by
    default) and drawn into samples by another hash of them, so rows with equal ids are drawn
    alike.  Keys without training rows are skipped; both metrics are null for a key without
    test rows.  A null feature or label is an error.  With ``keys`` only these are fitted, and
    answered as ``(req_ord, key, rmse, r2)`` in the order of the list, a repeated key again.
    """
    params = params or ForestParams()
    sampled = params.bootstrap or params.subsampling_rate < 1
    samples = params.num_trees if sampled else 1
    data = _packed(df, key, features, label, keys, id_cols, params, samples, params.bootstrap)
    subset = _subset_size(params.feature_subset_strategy, len(features), params.num_trees)
    turn = _Turn([(t, t if sampled else 0) for t in range(params.num_trees)], params.seed)
    weights = [1 / params.num_trees] * params.num_trees
    return _answers(_fitted(data, [turn], subset, params, weights), key, keys)


def gradient_boost(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    params: BoostParams | None = None,
    keys: Sequence | None = None,
    id_cols: Sequence[str] = (),
) -> DataFrame:
    """Fit boosted trees per key on its training rows: ``(key, rmse, r2)`` of the test rows.

    The first tree fits the label, each later one the negative gradient of the loss, added with
    weight ``step_size``.  Rows, splits, empty sides and ``keys`` are as in ``random_forest``.
    """
    params = params or BoostParams()
    sampled = params.subsampling_rate < 1
    samples = params.max_iter if sampled else 1
    rows_only = params.loss_type == "absolute"  # its gradient differs within a cell
    data = _packed(df, key, features, label, keys, id_cols, params, samples, False, rows_only)
    subset = _subset_size(params.feature_subset_strategy, len(features), 1)
    weights = [1.0] + [params.step_size] * (params.max_iter - 1)
    turns = [
        _Turn([(turn, turn if sampled else 0)], params.seed + turn, _Before(weights[:turn], params.loss_type))
        for turn in range(params.max_iter)
    ]
    return _answers(_fitted(data, turns, subset, params, weights), key, keys)


def _answers(metrics: DataFrame, key: str, keys: Sequence | None) -> DataFrame:
    return metrics if keys is None else in_request_order(metrics, key, keys)


def _subset_size(strategy: str, features: int, trees: int) -> int:
    """How many features a node chooses from."""
    sizes = {
        "all": features,
        "sqrt": math.ceil(math.sqrt(features)),
        "log2": max(1, math.ceil(math.log2(features))) if features > 1 else 1,
        "onethird": math.ceil(features / 3),
    }
    if strategy == "auto":
        return sizes["all"] if trees == 1 else sizes["onethird"]
    if strategy in sizes:
        return sizes[strategy]
    try:
        number = float(strategy)
    except ValueError:
        raise ValueError(f"unknown feature subset strategy {strategy!r}") from None
    if number.is_integer() and 1 <= number and "." not in strategy:
        return min(int(number), features)
    if 0 < number <= 1:
        return max(1, math.ceil(number * features))
    raise ValueError(f"unknown feature subset strategy {strategy!r}")


# --- rows to slices -------------------------------------------------------------------------


@dataclass
class _Data:
    """Slices of the records of all keys, and the trees grown so far.

    A slice has its key, a hash of it, the key's number of training rows, ``_rows``, and of
    slices, ``_slices``, and the list ``_records``.  A record has its bins ``_b0``, ``_b1`` ... .
    That of a cell has for each sample i its weight ``_n{i}`` and the weighted sums of the label
    and its square, ``_y{i}`` and ``_yy{i}``, and the same sums of its test rows as ``_tn``,
    ``_ty`` and ``_tyy``.  That of a row has its label ``_y``, the times ``_w{i}`` it was drawn
    and ``_tn``, 1 for a test row.  Labels are counted from the key's training mean, which keeps
    the squares small.  ``levels`` are tables (key, tree, node, value, f, bin, left, right): the
    children of node i are 2i+1 and 2i+2, ``value`` is the mean label, ``f`` the feature to split
    by, null for a leaf, ``bin`` the last bin that goes left, ``left`` and ``right`` the mean
    labels of the children.  ``apart`` is set where keys of one slice have no part in the levels.
    """

    key: str
    features: int
    keys: DataFrame
    count: int
    slices: DataFrame
    is_rows: bool
    draws: _Draws
    many_slices: bool
    scratch: Scratch
    levels: list[DataFrame] = field(default_factory=list)
    nodes: int = 0
    apart: bool = False

    def with_trees(self, fields: Sequence[str]) -> DataFrame:
        """The slices with the fields of their records and, by one join, the trees of their keys."""
        named = _quoted(self.key)
        joined = self.slices.filter("_slices > 1") if self.apart else self.slices
        read = joined.selectExpr(
            named, "_hash", "_rows", "_slices", *(f"_records.{name} as {name}" for name in fields)
        )
        if not self.levels:
            none = [f"cast(array() as array<{kind}>) as _m_{name}" for name, kind in _MODEL]
            return read.selectExpr("*", *none)
        grown = self.levels[0]
        for level in self.levels[1:]:
            grown = grown.unionByName(level)
        kept = grown.filter("node = 0 or f is not null")
        model = kept.groupBy(self.key).agg(F.collect_list(F.struct(*(name for name, _ in _MODEL))).alias("_m"))
        arrays = [f"_m.{name} as _m_{name}" for name, _ in _MODEL]
        return (
            read.join(small(model, self.nodes, len(_MODEL)), self.key)
            .selectExpr(named, "_hash", "_rows", "_slices", *fields, *arrays)
        )


_MODEL = (
    ("tree", "int"), ("node", "bigint"), ("value", "double"), ("f", "int"), ("bin", "int"),
    ("left", "double"), ("right", "double"),
)


def _packed(
    df, key, features, label, keys, id_cols, params, samples, bootstrap, rows_only=False
) -> _Data:
    require_columns(df, key, label, *features, *id_cols)
    if not features:
        raise ValueError("name at least one feature")
    if params.max_depth >= _NODE_BITS:
        raise ValueError(f"trees have {_NODE_BITS - 1} levels at most")
    ids = list(id_cols) or [key, *features, label]
    rows = df.filter(F.col(key).isNotNull())
    if keys is not None:
        rows = key_list_rows(rows, key, keys)
    x = [f"_x{i}" for i in range(len(features))]
    rows = rows.select(
        key,
        *(_present(name).alias(alias) for name, alias in zip(features, x)),
        _present(label).alias("_y"),
        (split_bucket(ids, params.seed) < round(params.train_split * 10000)).alias("_train"),
        F.xxhash64(*(F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ids)).alias("_id"),
    )

    # ranks are right to a twentieth of a bin
    steps = [i / params.max_bins for i in range(1, params.max_bins)] or [0.5]
    accuracy = max(1000, 20 * params.max_bins)
    cuts = F.array(
        *(
            F.coalesce(_midpoints(name, params.max_bins), F.array_distinct(F.percentile_approx(name, steps, accuracy)))
            for name in x
        )
    )
    scratch = Scratch(df.sparkSession)
    by_rows, by_cells = F.col("_rows") / params.train_split, F.lit(float(params.max_bins) ** len(x))
    per_key, (count, train_rows) = scratch.write_counted(
        rows.filter("_train")
        .groupBy(key)
        .agg(cuts.alias("_cuts"), F.avg("_y").alias("_mean"), F.count("*").alias("_rows"))
        .withColumn("_by_rows", F.ceil(by_rows / _SLICE_RECORDS).cast("int"))
        .withColumn("_by_cells", F.ceil(F.least(by_rows, by_cells) / _SLICE_RECORDS).cast("int")),
        F.count("*"),
        F.coalesce(F.sum("_rows"), F.lit(0)),
    )

    is_rows = rows_only or count * params.max_bins ** len(x) * _FEWER > train_rows
    known = small(per_key, count, 5 + len(x) * params.max_bins)
    bins = [f"_b{i}" for i in range(len(x))]
    binned = _with_bins(spread(rows, train_rows).join(known, key), x, params.max_bins).select(
        key,
        "_rows",
        F.col("_by_rows" if is_rows else "_by_cells").alias("_slices"),
        *bins,
        (F.col("_y") - F.col("_mean")).alias("_y"),
        "_train",
        "_id",
    )
    named = _quoted(key)
    draws = _Draws(params.subsampling_rate, bootstrap, params.seed)
    if is_rows:
        test = "tinyint(if(_train, 0, 1)) as _tn"
        # equal ids of one file part stay together: a slice is no larger than such a part
        place = "pmod(xxhash64(_id, spark_partition_id()), _slices) as _slice"
        records = binned.selectExpr(named, "_rows", "_slices", place, *bins, "_y", "_id", test)
    else:
        drawn = [_uniform("_id", params.seed + i).alias(f"_u{i}") for i in range(samples)]
        weights = [f"if(_train, {draws.sql(f'_u{i}')}, 0)" for i in range(samples)]
        binned = binned.select(*binned.columns, *drawn)
        sums = (
            f"{value} as {name}{i}"
            for i, w in enumerate(weights)
            for name, value in (("_n", f"sum(double({w}))"), ("_y", f"sum({w} * _y)"), ("_yy", f"sum({w} * _y * _y)"))
        )
        tests = (
            "double(count_if(not _train)) as _tn",
            "sum(if(_train, 0D, _y)) as _ty",
            "sum(if(_train, 0D, _y * _y)) as _tyy",
        )
        cells = binned.groupBy(key, "_rows", "_slices", *bins).agg(*(F.expr(e) for e in (*sums, *tests)))
        records = cells.withColumn("_slice", F.expr(f"pmod(xxhash64({', '.join(bins)}), _slices)"))
    fields = [name for name in records.columns if name not in (key, "_rows", "_slices", "_slice")]
    slices, (most,) = scratch.write_counted(
        records.repartition(partitions_for(df.sparkSession, train_rows), key, "_slice")
        .groupBy(key, "_slice", "_rows", "_slices")
        .agg(F.collect_list(F.struct(*fields)).alias("_records"))
        .withColumn("_hash", F.xxhash64(key)),
        F.max("_slices"),
    )
    return _Data(key, len(features), per_key.select(key), count, slices, is_rows, draws, (most or 0) > 1, scratch)


def _midpoints(name: str, max_bins: int) -> Column:
    """Places between all values of a feature that has at most ``max_bins`` of them, however rare; else null.

    The aggregate that lists the values counts exactly while it has room for all, so it has room
    for many more than the estimate of their number lets pass.
    """
    listed = f"transform(approx_top_k({name}, {max_bins + 1}, {8 * max_bins + 8}), v -> v.item)"
    middle = "transform(slice(v, 1, size(v) - 1), (a, j) -> a + (v[j + 1] - a) / 2)"
    return F.expr(
        f"if(approx_count_distinct({name}) <= {2 * max_bins}, "
        f"element_at(transform(array(array_sort({listed})), v -> if(size(v) <= {max_bins}, {middle}, null)), 1), null)"
    )


def _uniform(id: str, seed: int) -> Column:
    """A number from 0 to below 1 that a row's id and the seed decide, whatever the file layout."""
    return F.expr(f"shiftrightunsigned(xxhash64({id}, {seed}L), 11) * {2.0**-53!r}D")


def _present(name: str) -> Column:
    message = F.lit(f"null in {name!r}; drop such rows first")
    return F.coalesce(F.col(name).cast("double"), F.raise_error(message).cast("double"))


def _with_bins(rows: DataFrame, x: Sequence[str], max_bins: int) -> DataFrame:
    """Add ``_b0``, ``_b1`` ..., for each feature the number of its cuts below the row's value.

    The cuts ascend, so a few halving steps place a value, all within generated code.
    """
    rows = rows.selectExpr("*", *(f"0 as _b{i}" for i in range(len(x))))
    step = 1 << (max_bins - 1).bit_length()
    while step:
        rows = rows.withColumns(
            {
                f"_b{i}": F.expr(
                    f"_b{i} + if(get(get(_cuts, {i}), _b{i} + {step - 1}) < {name}, {step}, 0)"
                )
                for i, name in enumerate(x)
            }
        )
        step //= 2
    return rows


@dataclass(frozen=True)
class _Draws:
    """How often the samples draw a row, by the hash of its id: a Poisson count, or 0/1."""

    rate: float
    poisson: bool
    seed: int

    def steps(self) -> list[float]:
        """A uniform number above the first n of these is drawn n times at least."""
        if not self.poisson:
            return []
        found, below, term = [], 0.0, math.exp(-self.rate)
        while below + term > below and below < _LARGEST:  # until a double tells no further count apart
            below += term
            found.append(below)
            term *= self.rate / len(found)
        return found

    def sql(self, u: str) -> str:
        """The count from a column of uniform numbers."""
        if self.poisson:
            return "(" + " + ".join(f"int({u} > {step!r}D)" for step in self.steps()) + ")"
        return "1" if self.rate >= 1 else f"int({u} < {self.rate}D)"

    def counts(self, ids: np.ndarray, sample: int) -> np.ndarray:
        """The counts of one sample from hashes of ids, as ``sql`` has them from ``_uniform``."""
        if not self.poisson and self.rate >= 1:
            return np.ones(len(ids))
        u = (_hash_long(self.seed + sample, _hash_long(ids, _HASH_SEED)) >> np.uint64(11)) * 2.0**-53
        if self.poisson:
            return np.searchsorted(np.array(self.steps()), u).astype(float)
        return (u < self.rate).astype(float)


# fixed values: the primes and the seed of the 64-bit hash
_PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in _PRIMES)
_HASH_SEED = 42


def _hash_long(values, seed) -> np.ndarray:
    """The SQL function xxhash64 of 64-bit numbers, from a seed or the hash of a column before."""
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    x, h = (np.atleast_1d(np.asarray(v, np.int64 if np.asarray(v).dtype != np.uint64 else None)).astype(np.uint64) for v in (values, seed))
    h = h + _P5 + np.uint64(8)
    h = turned(h ^ (turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
    for shift, prime in ((33, _P2), (29, _P3)):
        h = (h ^ (h >> np.uint64(shift))) * prime
    return h ^ (h >> np.uint64(32))


# --- growing --------------------------------------------------------------------------------


@dataclass
class _Before:
    """Weights of the trees so far, whose sum the next tree corrects, and the loss."""

    weights: list[float]
    loss: str


@dataclass
class _Turn:
    """Trees ``[(tree, sample)]`` that grow together, the seed of their features, and what they correct."""

    trees: list[tuple[int, int]]
    seed: int
    before: _Before | None = None


def _fitted(data: _Data, turns: list[_Turn], subset: int, params, weights: Sequence[float]) -> DataFrame:
    """Test metrics of every key after all turns."""
    nodes = sum(len(turn.trees) for turn in turns) * (2**params.max_depth - 1)
    data.apart = not is_small(data.count * nodes, len(_MODEL))
    errors = [_whole_errors(data, turns, subset, params, weights)] if data.apart else []
    if data.many_slices or not data.apart:
        for turn in turns:
            _grow(data, turn, subset, params)
        errors.append(_joined_errors(data, weights))
    return _test_metrics(data, reduce(DataFrame.unionByName, errors))


def _job(data: _Data, depth: int, turn: _Turn, subset: int, params) -> _Job:
    draws = data.draws if data.is_rows else None
    return _Job(data.features, params.max_bins, draws, depth, turn.trees, subset, turn.seed, turn.before, _Rule.of(params))


def _drawn_fields(data: _Data, samples: Sequence[int]) -> list[str]:
    """Fields of the records that growing trees reads."""
    bins = [f"_b{i}" for i in range(data.features)]
    if data.is_rows:
        return [*bins, "_y", "_id", "_tn"]
    return [*bins, *(f"{name}{i}" for i in samples for name in ("_n", "_y", "_yy"))]


def _grow(data: _Data, turn: _Turn, subset: int, params) -> None:
    """Grow the trees of a turn of all keys that are not apart together, one pass per depth."""
    for depth in range(params.max_depth):
        splits = _next_level(data, _job(data, depth, turn, subset, params))
        if splits == 0:
            break


def _next_level(data: _Data, job: _Job) -> int:
    """Add the nodes of one depth to the levels; the number of those that split."""
    key, kind = data.key, data.slices.schema[data.key].dataType.simpleString()
    node = f"{_quoted(key)} {kind}, tree int, node long"
    best = "value double, f int, bin int, left double, right double"
    sums = "_rows long, place array<int>, n array<double>, y array<double>, yy array<double>"
    found = data.with_trees(_drawn_fields(data, sorted({sample for _, sample in job.trees}))).mapInArrow(_histograms(job), f"{node}, {best}, {sums}")
    if data.many_slices:
        found = data.scratch.write(found)
        added = (
            found.filter("place is not null")
            .select(key, "tree", "node", "_rows", "place", "n", "y", "yy")
            .repartition(key, "tree", "node")
            .sortWithinPartitions(key, "tree", "node")
            .mapInArrow(_add_up(job), f"{node}, {best}")
        )
        found = found.filter("place is null").select(*added.columns).unionByName(added)
    else:
        found = found.select(key, "tree", "node", "value", "f", "bin", "left", "right")
    level, (total, splits) = data.scratch.write_counted(found, F.count("node"), F.count("f"))
    data.levels.append(level)
    data.nodes += total if job.depth == 0 else splits
    return splits


@dataclass
class _Rule:
    """When a node may split."""

    instances: float
    fraction: float
    gain: float

    @classmethod
    def of(cls, params) -> _Rule:
        return cls(float(params.min_instances_per_node), params.min_weight_fraction_per_node, params.min_info_gain)


@dataclass
class _Job:
    """What a pass over the slices needs to know."""

    features: int
    max_bins: int
    draws: _Draws | None  # of rows; the sums of cells have them
    depth: int
    trees: list[tuple[int, int]]
    subset: int
    seed: int
    before: _Before | None
    rule: _Rule

    @property
    def width(self) -> int:
        return self.features * self.max_bins


class _Slice:
    """One row of a batch: the lists of its fields as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.lists = {}
        for name, column in zip(batch.schema.names, batch.columns):
            if pa.types.is_list(column.type):
                self.lists[name] = (column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False))

    def at(self, row: int, name: str) -> np.ndarray:
        offsets, values = self.lists[name]
        return values[offsets[row] : offsets[row + 1]]


class _Trees:
    """The trees of one key: splits sorted by tree and node, with the places of their children."""

    def __init__(self, tree, node, value, f, bin, left, right):
        tree, node = np.asarray(tree, np.int64), np.asarray(node, np.int64)
        order = np.lexsort((node, tree))
        f = np.asarray(f, float)  # null, NaN, for a leaf
        self.code = ((tree << _NODE_BITS) | node)[order]
        self.tree, self.node = tree[order], node[order]
        self.f = np.where(np.isnan(f), -1, f).astype(np.int64)[order]
        self.bin = np.nan_to_num(np.asarray(bin, float)).astype(np.int64)[order]
        self.value, self.left, self.right = (np.asarray(x, float)[order] for x in (value, left, right))
        self.children = np.stack([self._find((self.tree << _NODE_BITS) | (2 * self.node + side)) for side in (1, 2)])

    @classmethod
    def of(cls, lists: _Slice, row: int) -> _Trees:
        return cls(*(lists.at(row, f"_m_{name}") for name, _ in _MODEL))

    def _find(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, at, -1)

    def with_nodes(self, *more: np.ndarray) -> _Trees:
        """These trees with further nodes, given as ``_MODEL`` has them."""
        f = np.where(self.f < 0, np.nan, self.f)
        mine = (self.tree, self.node, self.value, f, self.bin, self.left, self.right)
        return _Trees(*(np.concatenate(pair) for pair in zip(mine, more)))

    def walk(self, bins: np.ndarray, trees: Sequence[int], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree, the node of each record after so many splits, -1 if it met a leaf, and the mean there."""
        shape = (len(trees), bins.shape[1])
        if not len(self.code):
            return np.full(shape, -1 if steps else 0), np.zeros(shape)
        at = np.repeat(self._find(np.asarray(trees, np.int64) << _NODE_BITS)[:, None], shape[1], axis=1)
        value, node = np.where(at >= 0, self.value[at], 0.0), np.zeros(shape, np.int64)
        everyone = np.arange(shape[1])[None, :]
        for _ in range(steps):
            inside = (at >= 0) & (self.f[at] >= 0)
            if not inside.any():
                return np.full(shape, -1), value
            right = bins[self.f[at], everyone] > self.bin[at]
            value = np.where(inside, np.where(right, self.right[at], self.left[at]), value)
            node = np.where(inside, 2 * node + 1 + right, -1)
            at = np.where(inside, self.children[right.astype(np.int8), at], -1)
        return node, value

    def sum_of(self, bins: np.ndarray, weights: Sequence[float]) -> np.ndarray:
        """The weighted sum of the trees' means for each record."""
        total = np.zeros(bins.shape[1])
        together = max(1, _WALKED // max(1, bins.shape[1]))
        for k in range(0, len(weights), together):
            some = range(k, min(k + together, len(weights)))
            total += np.asarray(weights[k : k + together]) @ self.walk(bins, some, _NODE_BITS)[1]
        return total


def _sums(job: _Job, lists: _Slice, row: int, sample: int, score: np.ndarray | None):
    """Weight and sums of the labels, or of the negative gradient of the loss at the score."""
    if job.draws:
        label = lists.at(row, "_y")
        n = np.where(lists.at(row, "_tn") > 0, 0.0, job.draws.counts(lists.at(row, "_id"), sample))
        y, yy = n * label, n * label * label
    else:
        n, y, yy = (lists.at(row, f"{name}{sample}") for name in ("_n", "_y", "_yy"))
    if score is not None:
        if job.before.loss == "absolute":
            y, yy = n * np.where(label < score, -1.0, 1.0), n
        else:
            y, yy = 2 * (y - n * score), 4 * (yy - 2 * score * y + n * score * score)
    return n, y, yy


def _scatter(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers so that every bit depends on every other."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _drawn_features(job: _Job, hashed: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether each feature is among the ``subset`` of lowest hashes at each node."""
    salt = _scatter(np.array([hashed & (2**64 - 1), job.seed & (2**64 - 1)], np.uint64))
    at = _scatter(((tree.astype(np.uint64) << np.uint64(_NODE_BITS)) | node.astype(np.uint64)) + salt[0] + salt[1])
    chance = _scatter(at[:, None] + np.arange(1, job.features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return chance.argsort(axis=1, kind="stable").argsort(axis=1) < job.subset


def _histograms(job: _Job):
    """Per slice, tree and growing node: its split if the slice is all of its key, else its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kept = _Slice(batch), []
            hashes, rows, slices = (batch.column(k).to_pylist() for k in (1, 2, 3))
            size = 0
            for row in range(batch.num_rows):
                for found in _slice_histograms(job, lists, row, hashes[row], _Trees.of(lists, row)):
                    kept.append((row, rows[row], slices[row] == 1, found))
                    size += len(found.place)
                if size > _JUDGED:
                    yield _answer(job, batch, kept)
                    kept, size = [], 0
            if kept:
                yield _answer(job, batch, kept)

    return run


@dataclass
class _Found:
    """Histograms of some nodes of one key: (node, place, sums) sorted by node and place.

    A place is a bin of a feature: feature * max_bins + bin.
    """

    tree: np.ndarray  # per node
    node: np.ndarray
    owner: np.ndarray  # per place, which of the nodes
    place: np.ndarray
    sums: np.ndarray  # weight, labels and squares by place


def _slice_histograms(job: _Job, lists: _Slice, row: int, hashed: int, grown: _Trees) -> Iterator[_Found]:
    bins = np.stack([lists.at(row, f"_b{i}") for i in range(job.features)]).astype(np.int64)
    score = grown.sum_of(bins, job.before.weights) if job.before and job.before.weights else None
    together = max(1, _WALKED // max(1, bins.shape[1]))
    for k in range(0, len(job.trees), together):
        some = job.trees[k : k + together]
        sums = np.stack([_sums(job, lists, row, sample, score) for _, sample in some])
        nodes = grown.walk(bins, [tree for tree, _ in some], job.depth)[0]
        which, record = np.nonzero((nodes >= 0) & (sums[:, 0] > 0))
        tree = np.array([tree for tree, _ in some], np.int64)[which]
        yield from _histogram(job, hashed, bins, tree, nodes[which, record], record, sums[which, :, record].T)


def _histogram(job: _Job, hashed: int, bins, tree, node, record, sums) -> Iterator[_Found]:
    if not len(node):
        return
    code, group = np.unique((tree << _NODE_BITS) | node, return_inverse=True)
    tree, node = code >> _NODE_BITS, code & ((1 << _NODE_BITS) - 1)
    chosen = _drawn_features(job, hashed, tree, node) if job.subset < job.features else None
    at, which = [], []
    for f in range(job.features):
        here = np.arange(len(group)) if chosen is None else np.flatnonzero(chosen[group, f])
        at.append(group[here] * job.width + f * job.max_bins + bins[f, record[here]])
        which.append(here)
    at, which = np.concatenate(at), np.concatenate(which)
    if len(code) * job.width <= 4 * len(at):
        totals = np.stack([np.bincount(at, weights=s[which], minlength=len(code) * job.width) for s in sums])
        full = np.flatnonzero(totals[0] > 0)
    else:
        full, at = np.unique(at, return_inverse=True)
        totals = np.stack([np.bincount(at, weights=s[which]) for s in sums])
        yield _Found(tree, node, full // job.width, full % job.width, totals)
        return
    yield _Found(tree, node, full // job.width, full % job.width, totals[:, full])


def _answer(job: _Job, batch: pa.RecordBatch, kept: list) -> pa.RecordBatch:
    """Rows of nodes: the split of those that are whole, the histogram of the others."""
    of_row, rows, whole, tree, node, counts = [], [], [], [], [], []
    for row, train_rows, is_whole, found in kept:
        n = len(found.node)
        of_row.append(np.full(n, row))
        rows.append(np.full(n, train_rows, np.int64))
        whole.append(np.full(n, is_whole))
        tree.append(found.tree)
        node.append(found.node)
        counts.append(np.bincount(found.owner, minlength=n))
    of_row, rows, whole, tree, node, counts = map(np.concatenate, (of_row, rows, whole, tree, node, counts))
    place = np.concatenate([found.place for *_, found in kept])
    sums = np.concatenate([found.sums for *_, found in kept], axis=1)
    owner = np.repeat(np.arange(len(node)), counts)
    best = {name: np.full(len(node), np.nan) for name in ("value", "f", "bin", "left", "right")}
    done = whole[owner]
    judged = _best_splits(job, np.cumsum(whole)[owner[done]] - 1, place[done], sums[:, done], rows[whole])
    for name, values in zip(best, judged):
        best[name][whole] = values
    lists = pa.array(np.concatenate(([0], np.cumsum(np.where(whole, 0, counts)))), pa.int32(), mask=np.append(whole, False))
    left = ~done
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(of_row)), pa.array(tree, pa.int32()), pa.array(node, pa.int64()),
            *_best_columns(best), pa.array(rows),
            pa.ListArray.from_arrays(lists, pa.array(place[left], pa.int32())),
            *(pa.ListArray.from_arrays(lists, pa.array(s[left])) for s in sums),
        ],
        names=[batch.schema.names[0], "tree", "node", *best, "_rows", "place", "n", "y", "yy"],
    )


def _best_columns(best: dict[str, np.ndarray]) -> list[pa.Array]:
    """The found values; NaN becomes null."""
    kinds = {"f": pa.int32(), "bin": pa.int32()}
    return [
        pa.array(values, from_pandas=True).cast(kinds.get(name, pa.float64())) for name, values in best.items()
    ]


def _best_splits(job: _Job, owner: np.ndarray, place: np.ndarray, sums: np.ndarray, rows: np.ndarray):
    """Mean, feature, bin and the children's means of the best allowed split of each node.

    ``owner`` says which of the ``len(rows)`` nodes a place belongs to, ascending; feature and
    bin are NaN where no split is allowed.  Among equal gains the first feature and bin are taken.
    """
    answers = [np.full(len(rows), np.nan) for _ in range(5)]
    step = max(1, _JUDGED // job.width)
    edges = np.searchsorted(owner, np.arange(0, len(rows) + step, step))
    for k, start in enumerate(range(0, len(rows), step)):
        part = slice(edges[k], edges[k + 1])
        n = min(step, len(rows) - start)
        dense = np.zeros((3, n * job.width))
        np.add.at(dense, (slice(None), (owner[part] - start) * job.width + place[part]), sums[:, part])
        found = _judge(job.rule, dense.reshape(3, n, job.features, job.max_bins), rows[start : start + n])
        for answer, values in zip(answers, found):
            answer[start : start + n] = values
    return answers


def _spread(n: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Sum of squared distances from the mean; 0 for no rows."""
    return np.maximum(yy - np.divide(y * y, n, out=np.zeros_like(y), where=n > 0), 0.0)


def _judge(rule: _Rule, dense: np.ndarray, rows: np.ndarray):
    below = dense.cumsum(axis=3)
    total = below[..., -1:]
    above = total - below
    n = total[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = (_spread(*total) - _spread(*below) - _spread(*above)) / n
        least = np.maximum(rule.instances, rule.fraction * rows)[:, None, None]
        # a gain that is only rounding does not split
        allowed = (
            (n > below[0]) & (below[0] >= least) & (above[0] >= least)
            & (gain > 1e-12 * total[2] / n) & (gain >= rule.gain)
        )
        value = np.nanmax(np.where(n > 0, total[1] / n, np.nan)[..., 0], axis=1, initial=-np.inf)
        flat = np.where(allowed, gain, -np.inf).reshape(len(rows), -1)
        best = flat.argmax(axis=1)
        one = np.arange(len(rows))
        some = flat[one, best] > -np.inf
        f, at = np.divmod(best, dense.shape[3])
        left = below[1][one, f, at] / below[0][one, f, at]
        right = above[1][one, f, at] / above[0][one, f, at]
    none = lambda values: np.where(some, values, np.nan)
    return value, none(f), none(at), none(left), none(right)


def _add_up(job: _Job):
    """Splits of the nodes whose histograms come in parts, sorted by key, tree and node."""

    def merged(held: list) -> list:
        """One histogram in place of several of one node."""
        place = np.concatenate([h[0] for h in held])
        sums = np.concatenate([h[1] for h in held], axis=1)
        places, at = np.unique(place, return_inverse=True)
        return [(places, np.stack([np.bincount(at, weights=s) for s in sums]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_rows, held = None, 0, []
        names = kinds = None

        def rows_of(ready: list) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(ready)), [len(place) for _, _, place, _ in ready])
            place = np.concatenate([place for _, _, place, _ in ready])
            sums = np.concatenate([s for *_, s in ready], axis=1)
            best = _best_splits(job, owner, place, sums, np.array([n for _, n, _, _ in ready]))
            columns = dict(zip(("value", "f", "bin", "left", "right"), best))
            ids = [pa.array([node[k] for node, *_ in ready], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*ids, *_best_columns(columns)], names=[*names, *columns])

        ready: list = []
        for batch in batches:
            names, kinds = batch.schema.names[:3], [batch.column(k).type for k in range(3)]
            lists = _Slice(batch)
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            rows = batch.column(3).to_pylist()
            for row, node in enumerate(ids):
                if node != last and held:
                    ready.append((last, last_rows, *merged(held)[0]))
                    held = []
                    if len(ready) * job.width > _JUDGED:
                        yield rows_of(ready)
                        ready = []
                last, last_rows = node, rows[row]
                held.append((lists.at(row, "place"), np.stack([lists.at(row, name) for name in ("n", "y", "yy")])))
                if len(held) >= 64:
                    held = merged(held)
        if held:
            ready.append((last, last_rows, *merged(held)[0]))
        if ready:
            yield rows_of(ready)

    return run


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# --- predicting -----------------------------------------------------------------------------


_ERRORS = ("n", "y", "yy", "sse")


def _error_fields(data: _Data) -> list[str]:
    """Fields of the records that testing trees reads."""
    return [*(f"_b{i}" for i in range(data.features)), "_tn", *(["_y"] if data.is_rows else ["_ty", "_tyy"])]


def _errors_of(lists: _Slice, row: int, grown: _Trees, features: int, is_rows: bool, weights: Sequence[float]) -> list:
    """Sums over the test records of a slice: number, labels, squares and squared errors."""
    n = lists.at(row, "_tn").astype(float)
    test = np.flatnonzero(n > 0)
    bins = np.stack([lists.at(row, f"_b{i}") for i in range(features)])[:, test].astype(np.int64)
    f, n = grown.sum_of(bins, weights), n[test]
    if is_rows:
        y = lists.at(row, "_y")[test]
        yy = y * y
    else:
        y, yy = (lists.at(row, name)[test] for name in ("_ty", "_tyy"))
    return [n.sum(), y.sum(), yy.sum(), (yy - 2 * f * y + n * f * f).sum()]


def _error_batch(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    sums = np.array(found, float).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums.copy())], names=[batch.schema.names[0], *_ERRORS])


def _test_errors(features: int, is_rows: bool, weights: Sequence[float]):
    """The errors of each slice, whose trees come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _Slice(batch)
            of = lambda row: _errors_of(lists, row, _Trees.of(lists, row), features, is_rows, weights)  # noqa: B023, E731
            yield _error_batch(batch, [of(row) for row in range(batch.num_rows)])

    return run


def _fit_whole(jobs: list[list[_Job]], is_rows: bool, weights: Sequence[float]):
    """The errors of each slice that is all of its key, after growing all trees: the jobs of each turn by depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _Slice(batch)
            hashes, rows = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            grown = [_Trees(*[[]] * len(_MODEL)) for _ in hashes]
            for k, turn in enumerate(jobs):
                # a key whose first samples drew nothing has no trees and no errors
                growing = [row for row in range(batch.num_rows) if not k or len(grown[row].code)]
                for job in turn:
                    growing = _grow_whole(job, lists, hashes, rows, grown, growing)
            fitted = [row for row in range(batch.num_rows) if len(grown[row].code)]
            errors = [_errors_of(lists, row, grown[row], jobs[0][0].features, is_rows, weights) for row in fitted]
            yield _error_batch(batch.take(pa.array(fitted, pa.int32())), errors)

    return run


def _grow_whole(job: _Job, lists: _Slice, hashes: list, rows: np.ndarray, grown: list, growing: Sequence[int]) -> list[int]:
    """Add the nodes of one depth to the trees of the slices; those of which a node split."""
    split, kept, size = [], [], 0

    def judge() -> None:
        counts = [len(found.node) for _, found in kept]
        owner = np.concatenate([found.owner + start for (_, found), start in zip(kept, np.cumsum([0, *counts]))])
        place = np.concatenate([found.place for _, found in kept])
        sums = np.concatenate([found.sums for _, found in kept], axis=1)
        best = _best_splits(job, owner, place, sums, np.repeat(rows[[row for row, _ in kept]], counts))
        tree, node = (np.concatenate([getattr(found, name) for _, found in kept]) for name in ("tree", "node"))
        of_row, kept_nodes = np.repeat([row for row, _ in kept], counts), (node == 0) | ~np.isnan(best[1])
        model = [x[kept_nodes] for x in (tree, node, *best)]
        of_row = of_row[kept_nodes]
        starts = np.flatnonzero(np.diff(of_row, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(of_row)]):
            row, new = of_row[start], [x[start:end] for x in model]
            grown[row] = grown[row].with_nodes(*new)
            if not np.isnan(new[3]).all():
                split.append(row)

    for row in growing:
        found = list(_slice_histograms(job, lists, row, hashes[row], grown[row]))
        kept += [(row, part) for part in found]
        size += sum(len(part.place) for part in found)
        if size > _JUDGED:
            judge()
            kept, size = [], 0
    if kept:
        judge()
    return split


def _whole_errors(data: _Data, turns: list[_Turn], subset: int, params, weights: Sequence[float]) -> DataFrame:
    """Test errors of the keys of one slice, whose trees grow and are tested in one pass."""
    samples = sorted({sample for turn in turns for _, sample in turn.trees})
    fields = list(dict.fromkeys([*_drawn_fields(data, samples), *_error_fields(data)]))
    named, kind = _quoted(data.key), data.slices.schema[data.key].dataType.simpleString()
    read = data.slices.filter("_slices = 1").selectExpr(named, "_hash", "_rows", *(f"_records.{name} as {name}" for name in fields))
    jobs = [[_job(data, depth, turn, subset, params) for depth in range(params.max_depth)] for turn in turns]
    return read.mapInArrow(_fit_whole(jobs, data.is_rows, list(weights)), f"{named} {kind}, {', '.join(f'{e} double' for e in _ERRORS)}")


def _joined_errors(data: _Data, weights: Sequence[float]) -> DataFrame:
    """Test errors of the slices that their trees are joined with."""
    kind = data.slices.schema[data.key].dataType.simpleString()
    return data.with_trees(_error_fields(data)).mapInArrow(
        _test_errors(data.features, data.is_rows, list(weights)),
        f"{_quoted(data.key)} {kind}, {', '.join(f'{e} double' for e in _ERRORS)}",
    )


def _test_metrics(data: _Data, errors: DataFrame) -> DataFrame:
    """Test rmse and r2 of every key, from the errors of its slices."""
    sums = errors.groupBy(data.key).agg(*(F.sum(name).alias(name) for name in _ERRORS))
    sums = data.keys.join(sums, data.key, "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    n, y, yy = F.col("n"), F.col("y"), F.col("yy")
    sse = F.greatest(F.col("sse"), F.lit(0.0))
    sst = yy - y * y / F.nullif(n, F.lit(0.0))
    # labels that differ by rounding only do not vary
    sst = F.when(sst > 1e-12 * yy, sst).otherwise(0.0)
    return sums.select(
        data.key,
        F.when(n > 0, F.sqrt(sse / F.nullif(n, F.lit(0.0)))).alias("rmse"),
        F.when(n > 1, r2_column(sse, sst)).alias("r2"),
    )
