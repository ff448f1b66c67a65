"""Mixing sources to target weights: Pfair windows and earliest deadline first over blocks."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, number_rows, small
from .tables import null_key, require_columns

#: Documents of one block, at least.
BLOCK_ROWS = 16
#: Blocks of all documents, at most: larger tables have larger blocks in proportion.  The driver
#: deals a slot in a few microseconds, so this bounds its time at about a minute.
BLOCKS = 20_000_000
#: Slots that are dealt and written at once; the driver holds no more of the schedule.
SPAN_SLOTS = 1_000_000
#: A target weight is the source's share of the documents to this power, brought to a sum of 1.
TEMPERATURE = 0.9


def source_weights(
    sizes: Mapping[str, int],
    period: int | None = None,
    temperature: float = TEMPERATURE,
    targets: Mapping[str, float] | None = None,
) -> dict[str, int]:
    """Weights of the sources (key, rows) as whole numbers in the exact ratio of the targets.

    ``targets`` gives weights per source; without it the weights follow the sizes.  A double is a
    fraction of whole numbers, so nothing is rounded.  A source of no weight could never come and
    is an error.  With a ``period`` the weights are slots of it by largest remainders, 1 at least.
    """
    if targets is None:
        raw = {key: float(n) ** temperature for key, n in sizes.items()}
    else:
        raw = {key: float(targets.get(key[1:], 0.0)) if key.startswith("=") else 0.0 for key in sizes}
    if not all(0 <= weight < math.inf for weight in raw.values()):
        raise ValueError("weights must be finite and 0 or more")
    exact = {key: Fraction(weight) for key, weight in raw.items()}
    if period is None:
        without = sorted(key for key, weight in exact.items() if weight == 0)
        if without:
            raise ValueError(f"sources without a target weight: {without[:10]}")
        common = math.lcm(*(weight.denominator for weight in exact.values()))
        return {key: int(weight * common) for key, weight in exact.items()}
    if len(sizes) > period:
        raise ValueError(f"{len(sizes)} sources need a period of as many slots at least")
    rest, total = period - len(sizes), sum(exact.values())
    shares = {key: weight * rest / total if total else Fraction(0) for key, weight in exact.items()}
    left = rest - sum(math.floor(share) for share in shares.values())
    order = sorted(shares, key=lambda key: (math.floor(shares[key]) - shares[key], key))
    more = set(order[: int(left)])
    return {key: 1 + math.floor(share) + (key in more) for key, share in shares.items()}


class Missed(Exception):
    """Some block would miss its window."""


def earliest_due(weights: Sequence[int], blocks: Sequence[int], end: int) -> Iterator[array]:
    """The source of each slot up to ``end``, a span of slots after the other; or ``Missed``.

    With total W of the weights, block i of a source with weight w is released at slot
    floor(i W / w) and due before slot ceil((i + 1) W / w), and before ``end`` if it is one of
    the first ``blocks``.  Every slot goes to the released block that is due first, ties to the
    heavier source, then to the first.
    """
    total = sum(weights)
    release = lambda s, i: i * total // weights[s]
    due = lambda s, i: min(-(-(i + 1) * total // weights[s]), end if i < blocks[s] else math.inf)
    had = [0] * len(weights)
    ready, waiting = [(due(s, 0), -weights[s], s) for s in range(len(weights))], []
    heapify(ready)
    for start in range(0, end, SPAN_SLOTS):
        picks = array("i")
        for t in range(start, min(end, start + SPAN_SLOTS)):
            while waiting and waiting[0][0] <= t:
                s = heappop(waiting)[1]
                heappush(ready, (due(s, had[s]), -weights[s], s))
            before, _, s = heappop(ready)
            if before <= t:
                raise Missed
            picks.append(s)
            had[s] += 1
            heappush(waiting, (release(s, had[s]), s))
        yield picks
    if not all(n >= max(least, w * end // total) for n, least, w in zip(had, blocks, weights)):
        raise Missed


def ends(weights: Sequence[int], blocks: Sequence[int]) -> Iterator[int]:
    """Numbers of slots to try, by which every block has come; in the last no block misses its window."""
    total = sum(weights)
    last = max(-(-b * total // w) for w, b in zip(weights, blocks))
    end = max((b - 1) * total // w + 1 for w, b in zip(weights, blocks))
    while (need := sum(max(w * end // total, b) for w, b in zip(weights, blocks))) > end:
        end = need
    while end < last:
        yield end
        end += max(1, end // 16)
    yield last


def schedule(weights: Sequence[int], blocks: Sequence[int], keep) -> list:
    """What ``keep`` makes of each span of the mixture's schedule, up to its end.

    Every block lies in its window, so before any slot t each source has had its weight times t
    blocks, give or take less than one.  The end is the first one tried that leaves no source a
    block short; ``keep(None)`` says that the spans before were in vain.
    """
    if not weights:
        return []
    for end in ends(weights, blocks):
        try:
            return [keep(picks) for picks in earliest_due(weights, blocks, end)]
        except Missed:
            keep(None)
    raise AssertionError("a block misses its window in a whole schedule")


class SpanTables:
    """Writes spans of the schedule as rows of (source_key, block, epoch, slot) while they are dealt."""

    def __init__(self, keys: Sequence[str], blocks: Sequence[int], scratch: Scratch):
        self.keys, self.per_epoch, self.scratch = pa.array(keys, pa.string()), np.asarray(blocks, np.int64), scratch
        self._begin()

    def _begin(self) -> None:
        self.had, self.slots, self.written = np.zeros(len(self.keys), np.int64), 0, []

    def __call__(self, picks: array | None) -> DataFrame | None:
        if picks is None:
            self.scratch.drop(*self.written)
            self._begin()
            return None
        which = np.frombuffer(picks, np.int32) if len(picks) else np.empty(0, np.int32)
        counts = np.bincount(which, minlength=len(self.keys))
        turn = np.empty(len(which), np.int64)
        turn[np.argsort(which, kind="stable")] = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        turn += self.had[which]
        table = pa.table(
            {
                "source_key": pa.DictionaryArray.from_arrays(which, self.keys).cast(pa.string()),
                "block": turn % self.per_epoch[which] if len(which) else turn,
                "epoch": turn // self.per_epoch[which] if len(which) else turn,
                "slot": np.arange(self.slots, self.slots + len(which), dtype=np.int64),
            }
        )
        self.had += counts
        self.slots += len(which)
        self.written.append(self.scratch.write(self.scratch.spark.createDataFrame(table)))
        return self.written[-1]


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int | None = None,
    period: int | None = None,
    temperature: float = TEMPERATURE,
    targets: Mapping[str, float] | None = None,
) -> DataFrame:
    """The mixture as rows of (doc_id, source, block, epoch, slot, place).

    A source's rows, in the order of a hash of their ids, form blocks of ``block_rows``; a slot
    of the mixture is one block.  Before any slot t each source has had its weight times t blocks,
    give or take less than one; weights are the exact targets (see ``source_weights``).  The mixture
    ends when the source that lasts longest has had every block; the others start over as epoch
    1, 2 ... to keep their weights, so every row comes once at least.  ``place`` is the row's place
    in its block; a source's last block may be short.  Null is a source of its own, rows without
    id and repeated rows are rows like others, and an empty table gives an empty mixture.

    Without ``block_rows`` a block has ``BLOCK_ROWS`` rows, or as many as make ``BLOCKS`` blocks of
    the table.  The driver deals the slots, one after the other as each depends on those before,
    and holds one row per source and a span of ``SPAN_SLOTS`` slots, which it writes before the
    next.  With a ``period`` weights are whole slots of it, and more sources than slots are an error.
    """
    require_columns(docs, id_col, source_col)
    if (block_rows is not None and block_rows < 1) or (period is not None and period < 1):
        raise ValueError("block_rows and period must be 1 or more")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source")
    ).withColumn("source_key", null_key("source")).withColumn("_draw", F.xxhash64("doc_id"))
    sizes = {row.source_key: row.n for row in rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = source_weights(sizes, period, temperature, targets)
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, -(-sum(sizes.values()) // BLOCKS))
    keys = sorted(sizes)
    blocks_of = [-(-sizes[key] // block_rows) for key in keys]
    spans = SpanTables(keys, blocks_of, scratch)
    parts = schedule([weights[key] for key in keys], blocks_of, spans)
    plan = reduce(DataFrame.unionAll, parts or [spans(array("i"))])
    numbered = number_rows(rows, "source_key", ["_draw", "doc_id"], max(len(sizes), 1), sum(sizes.values()))
    blocks = numbered.withColumn("block", F.floor(F.col("_pos") / block_rows)).withColumn(
        "place", F.col("_pos") % block_rows
    )
    return blocks.join(small(plan, spans.slots, 4), ["source_key", "block"]).select(
        "doc_id", "source", "block", "epoch", "slot", "place"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has epochs of it; see ``mix_sources``.

    Rows that repeat an id come as often as the one that comes most; rows without id come once.
    """
    times, (count,) = Scratch(docs.sparkSession).write_counted(
        mix_sources(docs, id_col, source_col, **settings)
        .filter("doc_id is not null and epoch > 0")
        .groupBy("doc_id")
        .agg(F.max("epoch").alias("_more")),
        F.count(F.lit(1)),
    )
    joined = docs.select(F.struct("*").alias("_row"), docs[id_col].alias("doc_id")).join(
        small(times, count, 2), "doc_id", "left"
    )
    copies = F.explode(F.array_repeat("_row", (F.coalesce("_more", F.lit(0)) + 1).cast("int")))
    return joined.select(copies.alias("_row")).select("_row.*")
