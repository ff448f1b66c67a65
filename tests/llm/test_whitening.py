"""Exact covariances and whitened coordinates against plain arithmetic."""

import random
from fractions import Fraction

import numpy as np
import pytest

from areastats.llm import queries, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows, top", [(1, 5), (63, 40), (64, 40), (65, 1), (300, 2**30), (7, 2**60)])
def test_sums_of_products(rows, top):
    rng = random.Random(rows)
    x = np.array([[rng.randint(-top, top) for _ in range(5)] for _ in range(rows)], np.int64)
    x[:, 2] = -3
    sums, products = whitening.scatter(x)
    plain = x.astype(object)
    assert sums == plain.sum(axis=0).tolist()
    assert products == {(i, j): (plain[:, i] * plain[:, j]).sum() for i in range(5) for j in range(i, 5)}


def brute(rows, components):
    """Rows of (id, deviation, whitened) by fractions and a full eigenvalue problem."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    apart = np.array([[float(a - m) for a, m in zip(r, mean)] for r in x])
    return (
        [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x],
        apart @ vectors / np.sqrt(values),
        values / np.trace(v),
    )


def test_query_against_brute_force(spark):
    found = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    deviation, whitened, explained = brute(rows, 32)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == 32 * len(rows) and set(by_id) == {i for i, _ in rows}
    mine = np.array([[by_id[i][c].whitened for c in range(1, 33)] for i, _ in rows])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened * signs).max() < 1e-8
    assert [by_id[i][1].deviation for i, _ in rows] == deviation
    assert np.allclose([by_id[rows[0][0]][c].explained for c in range(1, 33)], explained, rtol=1e-9)
    assert {r.n for r in found} == {len(rows)} and {r.identity_error for r in found} == {found[0].identity_error}
    real = np.abs(mine.T @ mine / len(rows) - np.eye(32)).max()
    assert real < 1e-4 and found[0].identity_error < 1e-4


SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def test_edges(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) for _ in range(4)] + [0.5]) for i in range(20)]
    good += [good[0], (None, good[1][1])]
    bad = [
        (90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [1.0, float("nan"), 0.0, 0.0, 0.0]),
        (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e30, 0.0, 0.0, 0.0, 0.0]),
    ]
    table = spark.createDataFrame([(*r, 7, "x") for r in good + bad], SCHEMA)
    fitted = whitening.fit(table)
    assert fitted.n == 22 and len(fitted.sums) == 5
    got = whitening.whiten(table, fitted).collect()
    assert len(got) == 22 * 5 and sum(r.vec_id is None for r in got) == 5
    assert all((r.whitened is None) == (r.component == 5) for r in got)
    twice = [r.whitened for r in got if r.vec_id == 0 and r.component == 1]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "x")], SCHEMA)
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert [(r.whitened, int(r.deviation)) for r in got] == [(None, 0)] * 2


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 3)), float(i)], 1, "x") for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(table, whitening.fit(table)).collect()}
    assert got == {i: v for (i, *_), v in zip(rows, brute([(i, v) for i, v, *_ in rows], 2)[0])}
