"""Benchmark contamination by winnowing: fingerprints find shared spans, extension proves them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Scratch, small, text_batches
from .hashing import letter_table, run_hashes, word_hashes
from .ngram_join import as_bytes
from .tables import id_and_text

#: A window of a benchmark item, in words; a shorter item is one window.
WINDOW = 13
#: Words of one hashed gram.  A window of w words holds w - GRAM + 1 grams, the least of which is kept.
GRAM = 5
#: Benchmark fingerprints that every task may hold; with more, texts and fingerprints meet by shuffle.
KNOWN_LIMIT = 1_000_000

LETTERS = letter_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def fingerprints(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of every window of that many words, and where it starts.

    Equal windows keep the same gram at the same place (the first of equal ones), so every shared
    span of ``window`` words or more shares a fingerprint.  Fewer words give none.
    """
    gram = min(GRAM, window)
    grams = run_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return grams[places] ^ np.uint64(window), places


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = word_hashes(text.as_py() or b"", LETTERS)
            if len(words):
                window = min(WINDOW, len(words))
                prints, places = fingerprints(words, window)
                rows.append((np.full(len(prints), len(rows)), prints, places, np.full(len(prints), window), item))
        if rows:
            owner, prints, places, windows = (np.concatenate(x) for x in list(zip(*rows))[:4])
            items = pa.array([row[4] for row in rows], batch.column(0).type).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [items, pa.array(prints.view(np.int64)), pa.array(places), pa.array(windows)],
                names=["item_id", "print", "item_at", "window"],
            )


def _text_prints(windows: list[int], known: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, places, kept = [], [], [], []
            for text in as_bytes(batch.column(1)):
                words = word_hashes(text.as_py() or b"", LETTERS)
                found = [fingerprints(words, window) for window in windows]
                mine = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found)])
                at = np.concatenate([np.empty(0, np.int64), *(y for _, y in found)])
                if known is not None and len(known):
                    hit = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                    mine, at = mine[hit], at[hit]
                elif known is not None:
                    mine, at = mine[:0], at[:0]
                sizes.append(len(words))
                prints.append(mine.view(np.int64))
                places.append(at)
                kept.append(len(mine) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int64())),
                    pc.if_else(pa.array(kept, pa.bool_()), batch.column(1), pa.scalar(None, batch.column(1).type)),
                ],
                names=["doc_id", "n_words", "prints", "places", "text"],
            )

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along each alignment of a text with an item, the equal runs of a window's length or more."""
    last: tuple[int, np.ndarray] | None = None
    for batch in batches:
        rows: list[tuple[int, int, int]] = []
        texts, items = as_bytes(batch.column(3)), as_bytes(batch.column(4))
        for i, (row, shift) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if last is None or last[0] != row:
                last = (row, word_hashes(texts[i].as_py(), LETTERS))
            text, item = last[1], word_hashes(items[i].as_py(), LETTERS)
            low, high = max(0, -shift), min(len(item), len(text) - shift)
            equal = np.concatenate(([False], item[low:high] == text[low + shift : high + shift], [False]))
            edges = np.flatnonzero(equal[1:] != equal[:-1])
            for start, end in zip(edges[::2], edges[1::2]):
                if end - start >= min(WINDOW, len(item)):
                    rows.append((i, int(start) + low + shift, int(end) + low + shift))
        index = pa.array([r[0] for r in rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(index),
                batch.column(1).take(index),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["row", "item_id", "start", "end"],
        )


def spans(docs: DataFrame, items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (row, doc_id, n_words) and their hit spans (row, item_id, start, end).

    ``row`` numbers the rows of a written table, so repeated ids stay apart.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    bench = scratch.write(
        items.mapInArrow(_item_prints, f"item_id {item_kind}, print long, item_at long, window long")
    )
    count = bench.count()
    windows = [row.window for row in bench.select("window").distinct().collect()]  # WINDOW values at most
    known = None
    if count <= KNOWN_LIMIT:
        known = np.unique(bench.select("print").toArrow().column(0).to_numpy().view(np.uint64))
    printed = scratch.write(
        docs.mapInArrow(
            _text_prints(sorted(windows), known),
            f"doc_id {kind}, n_words long, prints array<long>, places array<long>, text string",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    hits = (
        printed.filter(F.size("prints") > 0)
        .select("row", F.explode(F.arrays_zip("prints", "places")).alias("hit"))
        .select("row", F.col("hit.prints").alias("print"), F.col("hit.places").alias("at"))
        .join(small(bench, count, 4), "print")
        .select("row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    texts = items.filter("text is not null").select("item_id", F.col("text").alias("item_text"))
    aligned = hits.join(printed.filter("text is not null").select("row", "text"), "row").join(
        small(texts, count, 16), "item_id"
    )
    found = aligned.select("row", "item_id", "shift", "text", "item_text").mapInArrow(
        _extend, f"row long, item_id {item_kind}, start long, end long"
    )
    return printed.select("row", "doc_id", "n_words"), scratch.write(found)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: words, hit words, the items found, and whether it is contaminated.

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lowered.  A window is
    ``WINDOW`` consecutive words of an item, or a shorter item as a whole.  ``n_hit`` counts the
    words inside any occurrence of a window, ``n_items`` the items with such windows,
    ``items_sha256`` hashes their ids, sorted as strings and joined by commas.  A text is
    contaminated when a twentieth of its words is hit.  Null and empty texts have no words and
    are clean; null and empty items have no windows; items of one id count once; rows are judged
    one by one.
    """
    scratch = Scratch(docs.sparkSession)
    items = id_and_text(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    with text_batches(docs.sparkSession):
        rows, found = spans(id_and_text(docs, id_col, text_col), items, scratch)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row")
        .agg(
            F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(covered, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without the ids of contaminated texts; rows without id stay."""
    judged = contamination(docs, benchmark, id_col, text_col)
    gone, (count,) = Scratch(docs.sparkSession).write_counted(
        judged.filter("contaminated and doc_id is not null").select("doc_id").distinct(), F.count(F.lit(1))
    )
    return docs.join(small(gone, count, 1).withColumnRenamed("doc_id", id_col), id_col, "left_anti").select(*docs.columns)
