"""Texts reach Python in batches of bounded size, whatever their number and length."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from areastats import scale
from areastats.llm import decontaminate, ngram_join
from areastats.llm.segments import Threshold

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def watched(monkeypatch, module, name, path):
    """Write down the bytes of every batch that the function made by ``module.name`` is given."""
    made = getattr(module, name)

    def watch(run):
        def seen(batches):
            for batch in batches:
                with open(path, "a") as out:
                    out.write(f"{batch.nbytes}\n")
                yield batch

        return lambda batches: run(seen(batches))

    mapper = watch(made) if name == "_extend" else lambda *given: watch(made(*given))
    monkeypatch.setattr(module, name, mapper)


def long_texts(n=300, words=6000):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n // 2)]
    return list(enumerate([*texts, *(text + " end" for text in texts)]))


def test_join_hands_over_small_batches(spark, monkeypatch, tmp_path):
    for name in ("_count_places", "_sign", "_compare"):
        watched(monkeypatch, ngram_join, name, tmp_path / name)
    texts = long_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.shingle_components(docs).collect()}
    assert found == {i: i % 150 for i, _ in texts}
    for name in ("_count_places", "_sign", "_compare"):
        sizes = [int(line) for line in (tmp_path / name).read_text().split()]
        assert sum(sizes) > 4 * scale.TEXT_BATCH and max(sizes) < 1.5 * scale.TEXT_BATCH, name
    assert spark.conf.get(LIMIT, None) is None


def test_decontamination_hands_over_small_batches(spark, monkeypatch, tmp_path):
    for name in ("_text_prints", "_extend"):
        watched(monkeypatch, decontaminate, name, tmp_path / name)
    texts = long_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, " ".join(text.split()[7:27])) for i, text in texts[:150]], "item_id long, text string")
    hits = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert hits == {i: (20, 1) for i, _ in texts}
    for name in ("_text_prints", "_extend"):
        sizes = [int(line) for line in (tmp_path / name).read_text().split()]
        assert sum(sizes) > 4 * scale.TEXT_BATCH and max(sizes) < 1.5 * scale.TEXT_BATCH, name


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(LIMIT, "1m")
    try:
        with scale.text_batches(spark):
            assert spark.conf.get(LIMIT) == "1m"
        assert spark.conf.get(LIMIT) == "1m"
    finally:
        spark.conf.unset(LIMIT)
    with pytest.raises(ValueError), scale.text_batches(spark):
        assert int(spark.conf.get(LIMIT)) == scale.TEXT_BATCH
        raise ValueError
    assert spark.conf.get(LIMIT, None) is None


@pytest.mark.parametrize("texts, signatures, blocks", [(10_000, 1 << 20, 1), (2, 1 << 20, 2), (10_000, 1, 4)])
def test_blocks_span_batches(monkeypatch, texts, signatures, blocks):
    """Equal texts of a block sign once, also where they come in several batches."""
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(ngram_join, "BLOCK_SIGNATURES", signatures)
    words = " ".join(f"w{k}" for k in range(40))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([words])], names=["doc_id", "text"]) for i in range(4)]
    run = ngram_join._sign(5, Threshold(80), np.packbits(np.zeros(ngram_join.PLACES, bool)))
    out = list(run(iter(batches)))
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == [0, 1, 2, 3]
    assert len(out) == blocks and len({p for b in out for p in b.column("part").to_pylist()}) == blocks
    assert sum(len(signs) > 0 for b in out for signs in b.column("signs").to_pylist()) == blocks
