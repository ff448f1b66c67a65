"""Repairs of every kind against all sequences of repairs, inserted turns among them."""

import itertools
import random

import pytest

from areastats.llm import chat

AFTER = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def legal(roles):
    return all(role in AFTER[before] for before, role in zip([None, *roles], roles))


def cheapest(roles, costs):
    """Least cost over all ways to merge, keep or rename each turn, with or without an empty turn before it."""
    best = float("inf")
    for new in itertools.product(chat.ROLES, repeat=len(roles)):
        renamed = sum(costs.relabel for a, b in zip(roles, new) if a in chat.ROLES and a != b)
        for how in itertools.product(["keep", "merge", *chat.ROLES], repeat=len(roles)):
            result, cost = [], renamed
            for role, what in zip(new, how):
                if what == "merge":
                    if not result or result[-1] != role:
                        break
                    cost += costs.merge
                    continue
                if what != "keep":
                    result.append(what)
                    cost += costs.insert
                result.append(role)
            else:
                if cost < best and legal(result):
                    best = cost
    return best


def repaired(spark, chats, costs=chat.Costs()):
    turns = [(c, t, role, f"{c}.{t}") for c, roles in enumerate(chats) for t, role in enumerate(roles)]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    found = {}
    for r in sorted(chat.repair(table, costs=costs).collect(), key=lambda r: (r["conv_id"], r["position"])):
        found.setdefault(r["conv_id"], []).append(r)
    return [found[c] for c in range(len(chats))]


def cost_of(rows, costs):
    result = []
    for r in rows:
        if r["merged"]:
            assert result[-1] == r["repaired_role"]
            continue
        if r["inserted_role"]:
            result.append(r["inserted_role"])
        result.append(r["repaired_role"])
    assert legal(result)
    return sum(
        costs.merge * r["merged"] + costs.relabel * r["relabelled"] + costs.insert * (r["inserted_role"] is not None) for r in rows
    )


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(3.0, 1.0, 2.0), chat.Costs(2.0, 4.0, 0.5), chat.Costs(1.0, 1.0, 9.0)])
def test_no_cheaper_repair(spark, costs):
    names = [*chat.ROLES, "other"]
    chats = [c for n in (1, 2, 3) for c in itertools.product(names, repeat=n)]
    rng = random.Random(2)
    chats += [tuple(rng.choice(names) for _ in range(4)) for _ in range(12)]
    for roles, rows in zip(chats, repaired(spark, chats, costs)):
        assert cost_of(rows, costs) == pytest.approx(cheapest(roles, costs)), roles


def test_each_kind_is_the_cheapest_somewhere(spark):
    done = lambda rows: [(r["merged"], r["relabelled"], r["inserted_role"]) for r in rows]
    none = (False, False, None)
    chats = [("user", "user", "assistant"), ("user", "system", "user"), ("assistant", "user", "assistant"), ("system", "assistant")]
    merge, relabel, insert, between = map(done, repaired(spark, chats))
    assert merge == [none, (True, False, None), none]
    assert relabel == [none, (False, True, None), none]
    assert insert == [(False, False, "user"), none, none]
    assert between == [none, (False, False, "user")]


def test_inserted_turns_are_rendered(spark):
    (rows,) = repaired(spark, [("assistant", "user")])
    assert "".join(r["rendered"] for r in rows) == (
        "<|user|>\n<|end|>\n<|assistant|>\n0.0\n<|end|>\n<|user|>\n0.1\n<|end|>"
    )


def test_long_texts_and_repeated_rows(spark):
    long = "x" * 1_000_000
    rows = [("a", 1, "user", long), ("a", 1, "user", long), ("a", 2, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = sorted(chat.repair(table).collect(), key=lambda r: r["position"])
    assert [r["merged"] for r in got] == [False, True, False]
    assert "".join(r["rendered"] for r in got) == f"<|user|>\n{long}\n{long}\n<|end|>\n<|assistant|>\ny\n<|end|>"


def test_costs_must_be_numbers(spark):
    with pytest.raises(ValueError):
        chat.Automaton(chat.Costs(merge=-1.0))
