"""Whitening of embeddings by an exact covariance from bit planes.

Entries become whole numbers.  Within a batch of rows each dimension is shifted to start at 0, and
every bit of it, across the rows, is packed into words.  The sum of the products of two dimensions
is the sum over their bit planes of 2 ** (a + b) times the ones of the AND of both planes.  Such
sums are whole numbers: batches, tasks and the table add up exactly, in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import require_columns

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows that are packed and multiplied at once.
BLOCK_ROWS = 8192
#: Sums travel as limbs of so many bits, so that partial sums add up as longs without overflow.
LIMB_BITS, LIMBS = 40, 6
#: Entries beyond this in size have no whole number in a long.
LARGEST = 2.0**55


class Whitening(NamedTuple):
    """The fit: exact sums, and projections of x - sums / n onto whitened components.

    ``transform`` has a column per component; columns of components without variance are NaN.
    """

    n: int
    sums: list[int]
    transform: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers relative to ``OFFSET``."""
    return np.floor(values * SCALE).astype(np.int64)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of rows of whole numbers: words, dimension and bit of each plane, and the shifts."""
    shift = x.min(axis=0)
    y = (x - shift).astype(np.uint64).T.copy()
    bits = [int(top).bit_length() for top in y.max(axis=1)]
    rows = -(-len(x) // 64) * 64
    words = np.zeros((sum(bits), rows // 8), np.uint8)
    k = 0
    for d, count in enumerate(bits):
        for b in range(count):
            packed = np.packbits(((y[d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            words[k, : len(packed)] = packed
            k += 1
    dimension = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(count) for count in bits]) if bits else np.empty(0, np.int64)
    return words.view(np.uint64), dimension, bit, shift


def scatter(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Sums per dimension and sums of products per pair of dimensions (i <= j), as exact integers."""
    n, d = x.shape
    words, dimension, bit, shift = planes(x)
    shifts = [int(s) for s in shift]
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    inner = [0] * d  # sums of the shifted numbers
    for k in range(len(words)):
        inner[dimension[k]] += int(ones[k]) << int(bit[k])
    top = int(bit.max(initial=-1)) + 1
    # ones of all ANDs by pair of dimensions and by the sum of both bits
    counts = np.zeros((d, d, max(1, 2 * top - 1)), np.int64)
    for k in range(len(words)):
        i = int(dimension[k])
        first = int(np.searchsorted(dimension, i))
        both = np.bitwise_count(words[first:] & words[k]).sum(axis=1, dtype=np.int64)
        np.add.at(counts[i], (dimension[first:], bit[first:] + bit[k]), both)
    weights = [1 << s for s in range(counts.shape[2])]
    products = {}
    for i in range(d):
        for j in range(i, d):
            y = sum(c * w for c, w in zip(counts[i, j].tolist(), weights) if c)
            products[i, j] = y + shifts[i] * inner[j] + shifts[j] * inner[i] + n * shifts[i] * shifts[j]
    return [inner[i] + n * shifts[i] for i in range(d)], products


def _limbs(value: int) -> list[int]:
    """Limbs of a whole number, all of its sign."""
    size, sign = abs(value), -1 if value < 0 else 1
    return [sign * (size >> (LIMB_BITS * k) & ((1 << LIMB_BITS) - 1)) for k in range(LIMBS)]


def _valid(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vectors are not null and hold only finite entries, their lengths, and all entries."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten() if not vectors.null_count else vectors.values.slice(
        vectors.offsets[0].as_py(), vectors.offsets[len(vectors)].as_py() - vectors.offsets[0].as_py()
    )
    entries = values.to_numpy(zero_copy_only=False)  # nulls become NaN
    good = np.asarray(vectors.is_valid()) & (lengths > 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good[owner[~(np.abs(entries) < LARGEST)]] = False
    return good, lengths, entries


def _blocks(vectors: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the valid rows of each length, and their whole numbers, a block of rows at a time."""
    good, lengths, entries = _valid(vectors)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[good]).tolist():
        if length in (None, size):
            rows = np.flatnonzero(good & (lengths == size))
            for k in range(0, len(rows), BLOCK_ROWS):
                part = rows[k : k + BLOCK_ROWS]
                yield part, whole(entries[starts[part][:, None] + np.arange(size)])


def _scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors and pair of dimensions of a task's rows, the limbs of the sums.

    Pair (-1, -1) counts rows, pair (-1, i) sums dimension i.
    """
    totals: dict[int, list] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def add(size: int, x: np.ndarray) -> None:
        sums, products = scatter(x)
        n, old_sums, old = totals.get(size, (0, [0] * size, {}))
        totals[size] = [
            n + len(x), [a + b for a, b in zip(old_sums, sums)], {k: v + old.get(k, 0) for k, v in products.items()}
        ]

    for batch in batches:
        for _, x in _blocks(batch.column(0)):
            held = waiting.setdefault(x.shape[1], [])
            held.append(x)
            if sum(map(len, held)) >= BLOCK_ROWS:
                add(x.shape[1], np.concatenate(held))
                held.clear()
    for size, held in waiting.items():
        if held:
            add(size, np.concatenate(held))
    for size, (n, sums, products) in totals.items():
        found = {(-1, -1): n, **{(-1, i): s for i, s in enumerate(sums)}, **products}
        limbs = np.array([_limbs(v) for v in found.values()], np.int64)
        pairs = np.array(list(found), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * len(found), pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *map(pa.array, limbs.T.copy())],
            names=["size", "i", "j", *[f"l{k}" for k in range(LIMBS)]],
        )


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all valid vectors of the length that most of them have (ties: the longest).

    Tasks send one row per pair of dimensions; Spark adds them up, and the driver gets a table
    whose size depends on the dimensions alone.  The covariance is centred in whole numbers and
    rounded once, to doubles, before ``eigh``.  None where no vector is valid.
    """
    require_columns(vectors, vector_col)
    limbs = [f"l{k}" for k in range(LIMBS)]
    partial = vectors.select(F.col(vector_col).alias("v")).mapInArrow(
        _scatter_rows, "size int, i int, j int, " + ", ".join(f"{name} long" for name in limbs)
    )
    summed = partial.groupBy("size", "i", "j").agg(*[F.sum(name).alias(name) for name in limbs]).collect()
    values = {(r.size, r.i, r.j): sum(r[name] << (LIMB_BITS * k) for k, name in enumerate(limbs)) for r in summed}
    counts = [(n, size) for (size, i, j), n in values.items() if (i, j) == (-1, -1)]
    if not counts:
        return None
    n, d = max(counts)
    sums = [values[d, -1, i] for i in range(d)]
    centred = [[n * values[d, min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return _solve(n, [s + n * OFFSET for s in sums], centred, components)


def _solve(n: int, sums: list[int], centred: list[list[int]], components: int) -> Whitening:
    """``centred`` is n ** 2 times the covariance, exactly."""
    d, squared = len(sums), n * n
    covariance = np.array([[value / squared for value in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    vectors = vectors * signs  # the largest entry is positive
    trace = math.fsum(covariance[i, i] for i in range(d))
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps
    transform = np.full((d, len(order)), np.nan)
    transform[:, real] = vectors[:, real] / np.sqrt(values[real])
    spread = transform[:, real].T @ covariance @ transform[:, real]
    error = float(np.abs(spread - np.eye(len(spread))).max(initial=0.0))
    return Whitening(n, sums, transform, values / trace if trace else np.zeros(len(order)), error)


def _deviations(x: np.ndarray, fitted: Whitening) -> list[int]:
    """Exact sums over dimensions of (n * x - S) ** 2."""
    sums = [s - fitted.n * OFFSET for s in fitted.sums]  # x without its offset
    bound = max(int(np.abs(x).max(initial=0)) * fitted.n + abs(s) for s in sums)
    if bound * bound * len(sums) < 2**63:
        apart = fitted.n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    return [sum((fitted.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def whiten(
    vectors: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per valid vector and component: its whitened coordinate and the fit's figures.

    Columns: ``vec_id``; ``component`` from 1 by falling variance; ``n`` fitted vectors;
    ``deviation``, the exact sum of (n * x - S) ** 2 as decimal, null beyond 38 digits;
    ``whitened``; ``explained``; ``identity_error``.  Vectors that are null, empty, of another
    length than the fit's, or that hold null, non-finite or (beyond 2 ** 55) too large entries are
    left out.  Equal vectors have equal rows; rows are judged one by one, so repeated and null ids
    stay.  A component without variance has null coordinates.  Without a fit there are no rows.
    """
    require_columns(vectors, id_col, vector_col)
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = named.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, c = fitted.transform.shape
    mean = [s - fitted.n * OFFSET for s in fitted.sums]
    centre = np.array([s // fitted.n for s in mean], np.int64)
    rest = np.array([(s - fitted.n * k.item()) / fitted.n for s, k in zip(mean, centre)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = pa.decimal128(38, 0)
        for batch in batches:
            for rows, x in _blocks(batch.column(1), d):
                whitened = ((x - centre) - rest) @ fitted.transform
                deviations = [v if v < 10**38 else None for v in _deviations(x, fitted)]
                owner = np.repeat(np.arange(len(rows)), c)
                m = len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[owner])),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(m, fitted.n)),
                        pa.array(deviations, digits).take(pa.array(owner)),
                        pa.array(whitened.ravel(), from_pandas=True),
                        pa.array(np.tile(fitted.explained, len(rows))),
                        pa.array(np.full(m, fitted.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return named.mapInArrow(run, schema)
