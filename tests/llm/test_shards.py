"""Shards of given number and of given capacity against plain packing and the rows themselves."""

import random
import zlib
from collections import defaultdict

import pytest

from areastats.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def documents(spark, seed, rows):
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 400) + str(rng.randrange(5)) for _ in range(rows // 2)] + [None, ""]
    found = [(i, rng.choice(texts)) for i in range(rows)]
    return found, spark.createDataFrame([(*r, 9, "y") for r in found], "doc_id long, text string, shard int, key string").repartition(3)


def check_rows(rows, texts):
    """Sizes, checksums, whole groups, and slots in order of the ids; the bytes of each shard."""
    text_of = dict(texts)
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(text_of)
    shards, group = defaultdict(list), {}
    for r in rows:
        text = text_of[r["doc_id"]]
        raw = (text or "").encode()
        assert r["size"] == len(raw) + 1
        assert r["text_crc32"] == (None if text is None else zlib.crc32(raw))
        assert group.setdefault(text or "", r["shard"]) == r["shard"] or text in (None, "")
        shards[r["shard"]].append(r)
    for mine in shards.values():
        mine.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert [r["doc_id"] for r in mine] == sorted(r["doc_id"] for r in mine)
    return {s: sum(r["size"] for r in mine) for s, mine in shards.items()}


def group_sizes(texts):
    sizes = defaultdict(int)
    for _, text in texts:
        sizes[text] += len((text or "").encode()) + 1
    return sizes


def test_query_against_its_rows(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op1_sharding"](spark, SF).collect()
    filled = check_rows(rows, texts)
    sizes = group_sizes(texts)
    assert set(filled) <= set(range(16)) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    full = [filled.get(s, 0) for s in range(16)]
    assert max(full) - min(full) <= max(sizes.values())


@pytest.mark.parametrize("cell", [10, 50_000])
def test_spread_of_bytes_over_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    texts, docs = documents(spark, 1, 600)
    filled = check_rows(sharding.shard_by_bytes(docs, shards=4).collect(), texts)
    largest = max(group_sizes(texts).values())
    cells = max(1, -(-len(group_sizes(texts)) // cell))
    assert max(filled.values()) - min(filled.values()) <= largest * cells


@pytest.mark.parametrize("cell", [15, 50_000])
def test_shards_of_a_capacity(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    texts, docs = documents(spark, 2, 600)
    sizes = group_sizes(texts)
    capacity = 3000
    filled = check_rows(sharding.shard_by_capacity(docs, capacity).collect(), texts)
    assert sorted(filled) == list(range(len(filled)))
    assert all(b <= capacity or b in sizes.values() for b in filled.values())
    least = -(-sum(sizes.values()) // capacity)
    assert least <= len(filled) <= least * 1.25 + 2
    if cell > len(sizes):  # one cell: as many as the plain packing has, at most
        assert len(filled) <= len(sharding.best_fit_decreasing([(n, str(k)) for k, n in sizes.items()], capacity=capacity)[1])


def test_a_group_above_the_capacity(spark):
    texts = [(i, "same text" if i < 50 else f"text {i}") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    filled = check_rows(sharding.shard_by_capacity(docs, 100).collect(), texts)
    assert sorted(filled.values())[-1] == 500 and sorted(filled.values())[-2] <= 100


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_by_capacity(empty, 10).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_capacity(empty, 0)
