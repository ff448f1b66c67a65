"""The whole mixture against its exact target weights."""

import math
import random
import tracemalloc
from collections import Counter
from fractions import Fraction

import pytest

from areastats.llm import mixing

SCHEMA = "doc_id long, source string"


def table(spark, sizes):
    rows = [(name, i) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, name) for k, (name, _) in enumerate(rows)], SCHEMA)


def check(rows, sizes, weights, block_rows):
    """Every row once at least, whole slots of one block, and less than a block off at any slot."""
    slots = {}
    for r in rows:
        assert slots.setdefault(r["slot"], (r["source"], r["block"], r["epoch"])) == (r["source"], r["block"], r["epoch"])
    assert sorted(slots) == list(range(len(slots)))
    assert Counter(r["source"] for r in rows if r["epoch"] == 0) == Counter(sizes)
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    common = math.lcm(*(Fraction(weight).denominator for weight in weights.values()))
    weights = {name: int(weight * common) for name, weight in weights.items()}
    total, had = sum(weights.values()), Counter()
    for t in range(len(slots)):
        source, block, epoch = slots[t]
        assert (epoch, block) == divmod(had[source], -(-sizes[source] // block_rows))
        had[source] += 1
        for name, weight in weights.items():
            assert abs(had[name] * total - weight * (t + 1)) < total, (name, t)


def test_deviation_stays_under_one_block_of_the_exact_target(spark):
    sizes = {"a": 5000, "b": 611, "c": 97, "d": 8, "e": 1, "f": 1}
    weights = {name: Fraction(float(n) ** mixing.TEMPERATURE) for name, n in sizes.items()}
    rows = mixing.mix_sources(table(spark, sizes), block_rows=2).collect()
    check(rows, sizes, weights, 2)
    # a source of one document is no reason to repeat it, or all others, many times
    assert Counter(r["source"] for r in rows)["e"] == 1 and max(r["slot"] for r in rows) < 5000


def test_targets_are_exact_and_must_name_every_source(spark):
    sizes = {"a": 900, "b": 900, "c": 900}
    targets = {"a": 0.0004, "b": 0.3301, "c": 0.6695}
    docs = table(spark, sizes)
    rows = mixing.mix_sources(docs, block_rows=100, targets=targets).collect()
    check(rows, sizes, {name: Fraction(w) for name, w in targets.items()}, 100)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, targets={"a": 1.0, "b": 1.0})


def test_more_sources_than_any_period(spark):
    sizes = {f"s{i}": 1 + i % 5 for i in range(1200)}
    weights = {name: Fraction(float(n) ** mixing.TEMPERATURE) for name, n in sizes.items()}
    spans = mixing.schedule([1] * 3 + [5], [1, 1, 1, 5], lambda picks: picks)
    assert Counter(s for picks in spans for s in picks) == {0: 1, 1: 1, 2: 1, 3: 5}
    check(mixing.mix_sources(table(spark, sizes), block_rows=1).collect(), sizes, weights, 1)


def plain_schedule(weights, blocks):
    """Slot by slot, the released block that is due first, by looking at every source."""
    total = sum(weights)
    for end in mixing.ends(weights, blocks):
        had, picks = [0] * len(weights), []
        for t in range(end):
            due = []
            for s, w in enumerate(weights):
                if had[s] * total // w <= t:
                    last = -(-(had[s] + 1) * total // w)
                    due.append((min(last, end) if had[s] < blocks[s] else last, -w, s))
            before, _, s = min(due)
            if before <= t:
                break
            picks.append(s)
            had[s] += 1
        else:
            if all(n >= max(b, w * end // total) for n, b, w in zip(had, blocks, weights)):
                return picks


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_slots_equal_a_plain_schedule(monkeypatch, span):
    monkeypatch.setattr(mixing, "SPAN_SLOTS", span)
    rng = random.Random(span)
    for _ in range(60):
        weights = [rng.randint(1, 40) for _ in range(rng.randint(1, 6))]
        blocks = [rng.randint(1, 30) for _ in weights]
        kept = mixing.schedule(weights, blocks, lambda picks: picks)
        assert [s for picks in kept if picks is not None for s in picks] == plain_schedule(weights, blocks)


@pytest.mark.parametrize("span", [3, 50])
def test_spans_make_one_mixture(spark, monkeypatch, span):
    sizes = {"a": 300, "b": 41, "c": 9, None: 5}
    docs = table(spark, sizes)
    whole = {tuple(r) for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "SPAN_SLOTS", span)
    assert {tuple(r) for r in mixing.mix_sources(docs).collect()} == whole


def test_driver_holds_one_span(monkeypatch):
    """Two million slots pass through a span of ten thousand."""
    monkeypatch.setattr(mixing, "SPAN_SLOTS", 10_000)
    weights, blocks = [7, 5, 3, 1], [875_000, 625_000, 375_000, 125_000]
    tracemalloc.start()
    counts = Counter()
    spans = mixing.schedule(weights, blocks, lambda picks: counts.update(picks))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 200 and counts == dict(enumerate(blocks))
    assert peak < 2_000_000


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 10)
    sizes = {"a": 500, "b": 100}
    rows = mixing.mix_sources(table(spark, sizes)).collect()
    weights = {name: Fraction(float(n) ** mixing.TEMPERATURE) for name, n in sizes.items()}
    check(rows, sizes, weights, 60)
