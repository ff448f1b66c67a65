"""Repeated three-word windows, also where hashes collide or a text has more words than places."""

import random
from collections import Counter

import pytest

from areastats.llm import quality


def plain(text):
    words = (text or "").split()
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {
        i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1
    }
    return len(inside)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    made = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (3, 4, 5, 9, 30, 90)]
    made += [" ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n)) for n in (40, 63, 64, 65, 300)]
    return [*made, None, "", "a", "a a", "a a a", "a a a a", "a b c a b c"]


# 62 bits of place leave two bits of hash: nearly all windows collide; 6 bits are fewer places than words
@pytest.mark.parametrize("bits", [quality.PLACE_BITS, 62, 6])
def test_repeats_equal_a_plain_count(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(docs).collect()}
    assert got == {i: plain(text) for i, text in enumerate(texts)}
