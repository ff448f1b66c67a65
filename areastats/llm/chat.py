"""Minimum-cost repair of chat roles over a legal-turn automaton, and rendering of the result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Scratch, number_rows, require_columns, small
from .tables import null_key

ROLES = ("system", "user", "assistant")
#: States are the role of the turn before; START is before the first.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Turns a legal chat may have after each state: one system turn at first, then user and assistant
#: in turn.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


class Costs(NamedTuple):
    """What a repair costs: joining a turn to the one before, another role, an empty turn between.

    By default turns of one role in a row are merged, a turn that lacks the one it answers gets an
    empty one, and a role that has no place gives way to another.
    """

    merge: float = 1.0
    relabel: float = 2.5
    insert: float = 2.0


#: Turns of one block; blocks of a conversation are searched apart and joined by their costs.
BLOCK_TURNS = 2_048

OTHER_ROLES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


def ways(costs: Costs) -> list[tuple[int, int, int, int, float]]:
    """Ways from state to state over a turn: (before, after, merged, inserted role or 0, cost).

    The cost is without that of another role.
    """
    if not all(0 <= cost < math.inf for cost in costs):
        raise ValueError("costs must be finite and 0 or more")
    found = []
    for before in range(STATES):
        if before != START:
            found.append((before, before, 1, 0, costs.merge))
        for after in LEGAL[before]:
            found.append((before, after, 0, 0, 0.0))
        for between in LEGAL[before]:
            for after in LEGAL[between]:
                found.append((before, after, 0, between, costs.insert))
    # the cheaper way, then the one listed first, where two join the same states
    best: dict[tuple[int, int], tuple] = {}
    for step in found:
        best.setdefault(step[:2], step)
        if step[4] < best[step[:2]][4]:
            best[step[:2]] = step
    return sorted(best.values())


def turn_costs(role: int, costs: Costs) -> np.ndarray:
    """Cost from each state to each state over a turn of that role (0: a role unknown)."""
    table = np.full((STATES, STATES), np.inf)
    for before, after, _, _, cost in ways(costs):
        table[before, after] = cost + (0.0 if role in (0, after) else costs.relabel)
    return table


class Automaton:
    """Costs from state to state by role, and what was done on the cheapest way."""

    def __init__(self, costs: Costs):
        # the last role, for places after the end of a block, leaves every state as it is
        stay = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
        self.costs = np.stack([*(turn_costs(role, costs) for role in range(STATES)), stay])
        self.merged, self.inserted = np.zeros((STATES, STATES), bool), np.zeros((STATES, STATES), np.int32)
        for before, after, merged, between, _ in ways(costs):
            self.merged[before, after], self.inserted[before, after] = merged, between


PADDING = STATES
#: Blocks that are searched at once.
TOGETHER = 512


def _padded(roles: list[list[int]]) -> np.ndarray:
    width = max(map(len, roles), default=0)
    return np.array([row + [PADDING] * (width - len(row)) for row in roles], np.int8).reshape(-1, width)


def block_costs(roles: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Least cost from each state before a block to each state after it, for padded blocks."""
    total = np.repeat(automaton.costs[PADDING][None], len(roles), axis=0)
    for role in roles.T:
        total = (total[:, :, :, None] + automaton.costs[role][:, None]).min(axis=2)
    return total


def best_paths(roles: np.ndarray, before: np.ndarray, after: np.ndarray, automaton: Automaton) -> np.ndarray:
    """States after each turn on the cheapest way through each padded block; ties go to the lower state."""
    n, width = roles.shape
    costs = np.full((n, STATES), np.inf)
    costs[np.arange(n), before] = 0.0
    back = np.zeros((width, n, STATES), np.int8)
    for t, role in enumerate(roles.T):
        steps = costs[:, :, None] + automaton.costs[role]
        back[t] = steps.argmin(axis=1)
        costs = steps.min(axis=1)
    path, state = np.zeros((n, width), np.int8), np.asarray(after)
    for t in range(width - 1, -1, -1):
        path[:, t] = state
        state = back[t, np.arange(n), state]
    return path


def _block_matrices(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(costs)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                found = block_costs(_padded(batch.column(2).to_pylist()), automaton).reshape(-1, STATES * STATES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found.tolist(), pa.list_(pa.float64()))],
                    names=["conv", "block", "costs"],
                )

    return run


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least total cost per state up to each block, over blocks sorted by conversation and number."""
    last, reached = None, None
    for batch in batches:
        totals = []
        for conv, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if conv != last:
                last, reached = conv, np.where(np.arange(STATES) == START, 0.0, np.inf)
            reached = (reached[:, None] + np.array(costs).reshape(STATES, STATES)).min(axis=0)
            totals.append(reached.tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(totals, pa.list_(pa.float64()))],
            names=["conv", "block", "costs", "reached"],
        )


def _choose_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each block, over blocks sorted from the last to the first."""
    last, after = None, None
    for batch in batches:
        befores, afters = [], []
        rows = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)))
        for conv, costs, reached, earlier in rows:
            if conv != last:
                last, after = conv, int(np.argmin(reached))
            start = np.array(earlier) if earlier is not None else np.where(np.arange(STATES) == START, 0.0, np.inf)
            before = int(np.argmin(start + np.array(costs).reshape(STATES, STATES)[:, after]))
            befores.append(before)
            afters.append(after)
            after = before
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(befores, pa.int32()), pa.array(afters, pa.int32())],
            names=["conv", "block", "before", "after"],
        )


def _walk_blocks(costs: Costs):
    """States after the turns of each block, and what was done at each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(costs)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                roles = batch.column(2).to_pylist()
                before, after = (np.array(batch.column(k).to_pylist(), int) for k in (3, 4))
                paths = best_paths(_padded(roles), before, after, automaton)
                earlier = np.concatenate((before[:, None], paths[:, :-1]), axis=1)
                found = [
                    pa.array([row[: len(mine)] for row, mine in zip(values.tolist(), roles)], pa.list_(kind))
                    for values, kind in (
                        (paths, pa.int32()),
                        (automaton.merged[earlier, paths], pa.bool_()),
                        (automaton.inserted[earlier, paths], pa.int32()),
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *found], names=["conv", "block", "state", "merged", "inserted"]
                )

    return run


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
) -> DataFrame:
    """One row per turn: the repaired role, what was done, and the rendered piece of the chat.

    A legal chat has an optional system turn, then user and assistant turns in alternation from a
    user turn on.  The repair of least total cost merges a turn with the one before, gives it
    another role or puts an empty turn before it, at the given costs; among equals the lower state (system, user,
    assistant) is taken.  Columns: conv_id, turn, ``position`` in the chat, ``repaired_role``,
    ``merged``, ``relabelled``, ``inserted_role`` (an empty turn before this one, or null) and
    ``rendered``: the pieces of a chat in order of position are its text.

    Turns are ordered by turn number (null first), then role and text.  Roles are compared without
    case; an unknown or null role may become any role at no cost.  A null text is empty.  Rows of a
    null conversation are one conversation.  Repeated rows are turns of their own.
    """
    require_columns(turns, conv_col, turn_col, role_col, text_col)
    scratch = Scratch(turns.sparkSession)
    role = F.lower(F.trim(turns[role_col]))
    known = F.coalesce(*[F.when(role == other, name) for other, name in OTHER_ROLES.items()], role)
    role_id = F.coalesce(*[F.when(known == name, i + 1) for i, name in enumerate(ROLES)], F.lit(0))
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        turns[turn_col].alias("turn"),
        role_id.cast("int").alias("role_id"),
        F.coalesce(turns[text_col], F.lit("")).alias("text"),
        turns[role_col].alias("role"),
    ).withColumn("conv", null_key("conv_id"))
    counts = rows.agg(F.countDistinct("conv"), F.count(F.lit(1))).first()
    numbered = number_rows(rows, "conv", ["turn", "role", "text"], max(counts[0], 1), counts[1])
    numbered = scratch.write(numbered.withColumn("block", F.floor(F.col("_pos") / BLOCK_TURNS)))
    # a block has BLOCK_TURNS turns at most
    blocks, (n_blocks,) = scratch.write_counted(
        numbered.groupBy("conv", "block")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "role_id"))).alias("turns"))
        .select("conv", "block", F.col("turns.role_id").alias("roles")),
        F.count(F.lit(1)),
    )
    matrices = blocks.mapInArrow(_block_matrices(costs), "conv string, block long, costs array<double>")
    ahead = scratch.write(
        matrices.repartition("conv")
        .sortWithinPartitions("conv", "block")
        .mapInArrow(_chain_blocks, "conv string, block long, costs array<double>, reached array<double>")
    )
    earlier = Window.partitionBy("conv").orderBy("block")
    ends = (
        ahead.withColumn("earlier", F.lag("reached").over(earlier))
        .sortWithinPartitions("conv", F.desc("block"))
        .mapInArrow(_choose_ends, "conv string, block long, before int, after int")
    )
    ends = scratch.write(ends)
    walked = scratch.write(
        blocks.join(small(ends, n_blocks, 4), ["conv", "block"]).mapInArrow(
            _walk_blocks(costs), "conv string, block long, state array<int>, merged array<boolean>, inserted array<int>"
        )
    )
    # whether the turn after is merged; the one after a block's last turn is the first of the next block
    following = F.lead(F.get("merged", F.lit(0))).over(earlier)
    steps = walked.withColumn("_following", following).select(
        "conv",
        "block",
        F.posexplode(
            F.arrays_zip(
                "state", "merged", "inserted",
                F.concat(F.expr("slice(merged, 2, size(merged))"), F.array("_following")).alias("_next"),
            )
        ).alias("_at", "_step"),
    )
    joined = steps.select("conv", (F.col("block") * BLOCK_TURNS + F.col("_at")).alias("_pos"), "_step.*")
    name = F.array(F.lit(None).cast("string"), *[F.lit(role) for role in ROLES])
    head = F.concat(F.lit("<|"), F.col("repaired_role"), F.lit("|>\n"))
    empty = F.coalesce(F.concat(F.lit("<|"), F.col("inserted_role"), F.lit("|>\n<|end|>\n")), F.lit(""))
    ended = F.when(F.col("_pos") > 0, F.lit("<|end|>\n")).otherwise("")
    piece = F.when(F.col("merged"), F.lit("\n")).otherwise(F.concat(ended, empty, head))
    last = F.when(F.col("_next").isNull(), F.lit("\n<|end|>")).otherwise(
        F.when(F.col("_next"), F.lit("")).otherwise(F.lit("\n"))
    )
    return (
        numbered.join(joined, ["conv", "_pos"])
        .withColumn("repaired_role", F.element_at(name, F.col("state") + 1))
        .withColumn("inserted_role", F.element_at(name, F.col("inserted") + 1))
        .select(
            "conv_id",
            "turn",
            F.col("_pos").alias("position"),
            "repaired_role",
            "merged",
            ((F.col("role_id") != 0) & (F.col("role_id") != F.col("state"))).alias("relabelled"),
            "inserted_role",
            F.concat(piece, "text", last).alias("rendered"),
        )
    )
