"""Rows without an id take no link from the equal rows beside them."""

import random

from areastats.llm import ngram_join


def test_null_id_before_an_equal_text_and_its_near_copy(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(10_000)}" for _ in range(100))
    rows = [(None, base), (1, base), (2, base + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.shingle_components(docs, length=3, percent=90).collect()}
    assert found[2] == found[1] == 1


def test_hot_signatures_beside_rows_without_id(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    rows = [(None if i < 70 else i, " ".join([*base, f"x{i}"])) for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["component_id"] for r in ngram_join.shingle_components(docs, length=3, percent=90).collect() if r["doc_id"]}
    assert found == {70}
