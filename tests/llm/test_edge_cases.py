"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import itertools
import random
from collections import Counter

import pytest

from areastats.llm import (
    chat,
    decontaminate,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    sharding,
    token_counts,
    toxicity,
)
from areastats.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, `key` string, slot int"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(80, 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " more", None, None),
        (4, None, "en", "b"),
        (5, "", "en", "b"),
        (6, words(20_000, 2), "en", "b"),
        (None, base, "en", None),
        (7, words(70, 3) + "\n" + "a line long enough to be compared\n" * 2 + "a line long enough to be compares", "en", "c"),
    ]
    return spark.createDataFrame([(*row, None, 9, "x", 3) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, words(80, 1)[:200]), (2, "two words"), (3, None), (4, "")], "item_id long, text string"
    )


def test_shards(docs, empty):
    rows = sharding.shard_by_bytes(docs, shards=3).collect()
    assert len(rows) == 9 and sharding.shard_by_bytes(empty).count() == 0
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2, None)}) == 1
    assert next(r for r in rows if r["doc_id"] == 4)["size"] == 1


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [(rng.randint(1, 60), i) for i in range(rng.randint(0, 80))]
        free, expected = [], {}
        for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
            fits = [(space, b) for b, space in enumerate(free) if space >= size]
            b = min(fits)[1] if fits else len(free)
            free += [] if fits else [100]
            free[b] -= size
            expected[name] = b
        assert sharding.best_fit_decreasing(sizes, capacity=100) == ([expected[name] for _, name in sizes], free)


def test_quality(docs, empty):
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert rows[4]["n_words"] == rows[5]["n_words"] == 0 and not rows[4]["kept"]
    assert rows[6]["n_words"] == 20_000
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty).count() == 0


def test_groups(docs, empty):
    rows = ngram_join.shingle_components(docs, length=3, percent=90).collect()
    found = {(r["doc_id"], r["component_id"]) for r in rows}
    assert len(rows) == 9 and {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (None, None)} >= found - {(None, 1)}
    assert ngram_join.shingle_components(empty).count() == 0
    kept = ngram_join.one_per_group(docs, length=3, percent=90)
    assert kept.columns == docs.columns and {1, 4, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()}


def test_contamination(docs, empty, bench):
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[1]["contaminated"] and rows[1]["n_items"] == 1 and not rows[6]["contaminated"]
    assert rows[4]["n_words"] == 0 and not rows[4]["contaminated"]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_mixture(docs, empty):
    rows = mixing.mix_sources(docs, block_rows=1, period=12).collect()
    counts = Counter(r["doc_id"] for r in rows if r["epoch"] == 0)
    assert counts == Counter([1, 2, 2, 3, 4, 5, 6, None, 7])
    slots = {r["slot"]: r["source"] for r in rows}
    assert sorted(slots) == list(range(len(slots)))
    assert mixing.mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, period=2)


def test_personal(spark, docs, empty):
    text = "a b@c.de 1.2.3.4 4111 1111 1111 1111 and +1 (017) 555-7713 end 1.2.3.999"
    more = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find_personal(more).collect()}
    base = [x for x in rows[1] if x[0] in ("email", "ip", "card", "phone")]
    assert ("email", "b@c.de") in base and ("ip", "1.2.3.4") in base and ("phone", "+1 (017) 555-7713") in base
    assert rows[2] == rows[3] == [] and pii.find_personal(empty).count() == 0


def test_lines(docs, empty):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (rows[7]["n_lines"], rows[7]["n_equal"], rows[7]["n_near"]) == (4, 1, 1)
    assert rows[4]["text"] is None and rows[5]["text"] == "" and line_dedup.dedup_lines(empty).count() == 0


def test_tokens_after_edits_equal_a_full_encoding(spark, docs, empty):
    ranks = open(VOCABULARY, "rb").read()
    encode = token_counts.encoder(ranks).encode_ordinary
    rng = random.Random(8)
    text = words(3000, 5)
    tree_text = token_counts.leaves_of(text)
    tree = token_counts.CountTree(text, [len(x) for x in tree_text], [len(encode(x)) for x in tree_text])
    for _ in range(300):
        start = rng.randrange(len(text) + 5)
        end = start + rng.choice([0, 0, 1, 5, 700])
        new = rng.choice(["", " ", "  ", "x", " some words", "\n", "it's", "é" * 3])
        tree.edit(start, end, new, encode)
        start = min(start, len(text))
        text = text[:start] + new + text[max(end, start) :]
        assert tree.text == text
    assert tree.total == len(encode(text))
    edits = spark.createDataFrame([(5, 1, 0, 0, "new"), (99, 1, 0, 0, "x")], "doc_id long, seq long, start long, end long, replacement string")
    rows = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.build_index(docs, ranks), edits, ranks).collect()}
    assert rows[5]["n_tokens"] == 0 and rows[5]["text"] == "new" and rows[4]["text"] is None
    assert token_counts.build_index(empty, ranks).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    texts = [(i, words(40, i) + (" vile scum" * 2 if i % 3 == 0 else "")) for i in range(300)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).collect()
    held = [r for r in rows if r["doc_id"] >= 200]
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in held)
    assert {texts[9][1][s["start"] : s["end"]] for s in rows[9]["spans"]} == {"vile", "scum"}
    assert toxicity.score(docs, model).count() == 9 and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(table, none).collect()} == {0.5}
    del rng


def test_chain_marginals_equal_all_paths():
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    model = toxicity.Model({}, rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), np.zeros(4))
    classes = [0, 0, 0, 2, 0, 0, 0, 0, 4, 1, 0, 0]
    reading = toxicity.Reading(12, [3, 8, 9], [2, 4, 1], [])
    weight, total = Counter(), 0.0
    for path in itertools.product((0, 1), repeat=12):
        score = sum(model.transition[a, b] for a, b in zip(path, path[1:]))
        for t, tag in enumerate(path):
            if tag:
                near = (classes[t], classes[t - 1] if t else 0, classes[t + 1] if t < 11 else 0)
                score += sum(model.emission[k, c] for k, c in enumerate(near))
        total += math.exp(score)
        for t, tag in enumerate(path):
            weight[t] += tag * math.exp(score)
    for t, p in toxicity.marginals(reading, model).items():
        assert p == pytest.approx(weight[t] / total)


def test_chat(spark):
    turns = [("a", 0, "assistant", "x"), ("a", 1, "user", "q"), ("a", 2, "user", "r"), ("a", 3, "bot", None),
             ("b", 0, "system", "s"), ("b", 1, "user", "q"), (None, None, None, "t")]
    table = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    rows = chat.repair(table).collect()
    assert len(rows) == 7
    a = sorted((r for r in rows if r["conv_id"] == "a"), key=lambda r: r["position"])
    assert [r["repaired_role"] for r in a][1:] == ["user", "user", "assistant"] and a[2]["merged"]
    b = sorted((r for r in rows if r["conv_id"] == "b"), key=lambda r: r["position"])
    assert "".join(r["rendered"] for r in b) == "<|system|>\ns\n<|end|>\n<|user|>\nq\n<|end|>"
    assert chat.repair(table.limit(0)).count() == 0


def test_chat_blocks(spark, monkeypatch):
    """The same repair in one block and in many, and no cheaper one among all paths."""
    rng = random.Random(5)
    names = ["system", "user", "assistant", "other", None]
    turns = [(f"c{c}", t, rng.choice(names), f"{c}.{t}") for c in range(12) for t in range(rng.randint(1, 9))]
    table = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    key = lambda row: (row["conv_id"], row["position"])
    whole = sorted(chat.repair(table).collect(), key=key)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    assert sorted(chat.repair(table).collect(), key=key) == whole
    for conv in {turn[0] for turn in turns}:
        roles = [chat.ROLES.index(role) + 1 if role in chat.ROLES else 0 for c, _, role, _ in turns if c == conv]
        mine = [chat.ROLES.index(row["repaired_role"]) + 1 for row in whole if row["conv_id"] == conv]
        cost = lambda path: sum(
            chat.turn_costs(role, chat.Costs())[a, b] for role, a, b in zip(roles, [chat.START, *path], path)
        )
        if len(roles) <= 7:
            assert cost(mine) == min(map(cost, itertools.product(range(1, chat.STATES), repeat=len(roles))))
        assert cost(mine) < float("inf")


def _within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[at:] == b[at + 1 :]


def test_lines_equal_a_comparison_of_all(spark):
    """Lengths on both sides of every band and cut, edits anywhere, characters of several bytes."""
    rng, texts = random.Random(3), []
    for n in [*range(14, 50), 200]:
        base = "".join(rng.choice("abcdé ") for _ in range(n - 1)) + "x"
        near = [base, base[1:], base[:-1], "q" + base, base + "q"]
        for _ in range(8):
            p, new = rng.randrange(n + 1), rng.choice("abcdé")
            near.append(rng.choice([base[:p] + new + base[p:], base[:p] + new + base[p + 1 :], base[:p] + base[p + 1 :]]))
        rng.shuffle(near)
        texts += ["\n".join(near[k : k + 3]) for k in range(0, len(near), 3)]
    rng.shuffle(texts)
    firsts, want = [], {}
    for i, text in enumerate(texts):
        kept, equal, close = [], 0, 0
        for line in text.split("\n"):
            if line in firsts:
                equal += 1
                continue
            if len(line) >= line_dedup.LEAST_CHARS and any(
                len(x) >= line_dedup.LEAST_CHARS and _within_one_edit(x, line) for x in firsts
            ):
                close += 1
            else:
                kept.append(line)
            firsts.append(line)
        want[i] = (equal, close, "\n".join(kept))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_equal"], r["n_near"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 200


def test_leaves_are_split_after_a_long_insertion():
    """A later edit inside a long insertion encodes its surroundings only."""
    ranks = open(VOCABULARY, "rb").read()
    encode = token_counts.encoder(ranks).encode_ordinary
    text, long = words(200, 1), words(20_000, 2)
    pieces = token_counts.leaves_of(text)
    tree = token_counts.CountTree(text, [len(p) for p in pieces], [len(encode(p)) for p in pieces])
    tree.edit(300, 300, long, encode)
    text = text[:300] + long + text[300:]
    before = tree.encoded
    for start, end, new in ((50_000, 50_003, "xyz"), (70_000, 70_500, ""), (0, 0, "start ")):
        tree.edit(start, end, new, encode)
        text = text[:start] + new + text[end:]
    assert tree.encoded - before < 10 * token_counts.LEAF_CHARS
    assert tree.text == text and tree.total == len(encode(text))
