"""Spelling variants: words one letter apart, found by Gram matrices of letter counts.

One replaced letter moves the vector of a word's letter counts by a squared distance of 2, one
inserted or deleted letter by 1.  Words of equal length and equal counts of a few sets of letters
form a block; an edit leads only to blocks of the same or the next length whose counts differ by
that edit.  Blocks are cut into tiles, and one matrix product gives all squared distances between
two tiles; pairs at distance two or less are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, require_columns
from .tables import id_and_text

#: Maximal runs of these letters are words; A-Z are lowered.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sets of letters that blocks count apart; every other letter is in the last, uncounted set.
SETS = ("aeiou", "lmnr", "bcdpst", "fghvwy")
#: Words of a tile and letters of a tile, at most (a longer word is a tile of its own).
TILE_WORDS, TILE_LETTERS = 1024, 1 << 17
#: Letter count products of a task, at least where there are several tasks.
TASK_PRODUCTS = 2_000_000_000
#: Letters of pairs that are compared at once.
COMPARED_LETTERS = 1 << 19


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``run``, a row for every maximal run of letters of every text, A-Z lowered."""
    named = id_and_text(docs, id_col, text_col)
    found = named.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one letter where the hash of document and run says so, once in ``every``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(words: DataFrame, word_col: str, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``word`` and ``n``, its rows, of the words of enough letters and rows; nulls are no words."""
    require_columns(words, word_col)
    return (
        words.select(F.col(word_col).alias("word"))
        .filter(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_count)
    )


def _key(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(".", length, *counts)


def _blocked(counted: DataFrame) -> DataFrame:
    counts = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in SETS]
    sized = counted.select("word", "n", F.length("word").alias("length"), *[c.alias(f"c{k}") for k, c in enumerate(counts)])
    return sized.withColumn("block", _key(F.col("length"), [F.col(f"c{k}") for k in range(len(SETS))]))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of blocks that one edit can join; a is shorter, or of equal length and least."""
    sets = range(len(SETS) + 1)  # the last set is what the length leaves

    def moved(longer: int, change: dict[int, int]) -> Column:
        return _key(F.col("length") + longer, [F.col(f"c{k}") + change.get(k, 0) for k in range(len(SETS))])

    replaced = [moved(0, {i: -1, j: 1}) for i in sets for j in sets if i != j]
    same = F.array(F.col("block"), *[F.when(key > F.col("block"), key) for key in replaced])
    inserted = F.array(*[moved(1, {i: 1}) for i in sets])
    near = blocks.select(
        F.col("block").alias("a"), F.col("tiles").alias("tiles_a"), F.explode(F.concat(same, inserted)).alias("b")
    )
    other = blocks.select(F.col("block").alias("b"), F.col("tiles").alias("tiles_b"))
    return near.filter("b is not null").join(other, "b")


def _tile_pairs(pairs: DataFrame) -> DataFrame:
    """Every tile of one block with every tile of the other, once."""
    one = pairs.select("a", "b", "tiles_b", F.explode(F.expr("sequence(0, tiles_a - 1)")).alias("tile_a"))
    first = F.expr("if(a = b, tile_a, 0)")
    return one.select("a", "tile_a", "b", F.explode(F.sequence(first, F.col("tiles_b") - 1)).alias("tile_b"))


def _codes(joined: str, words: int) -> np.ndarray:
    """Letters of words of one length that lie one after the other, a row for each."""
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(words, -1 if joined else 0)


def _letter_counts(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    m, length = codes.shape
    letters = np.searchsorted(alphabet, codes)
    letters += np.arange(0, m * len(alphabet), len(alphabet))[:, None]
    flat = np.bincount(letters.ravel(), minlength=m * len(alphabet))
    # all squares of distances are whole numbers that the type holds exactly
    return flat.reshape(m, len(alphabet)).astype(np.float32 if length <= 1000 else np.float64)


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of ``x`` and ``y`` that differ by one edit.

    Words are rows of letters; those of ``y`` are as long or one longer.  ``same`` says that both
    are one table; each pair is then given once.
    """
    alphabet = np.union1d(x, y)
    if not len(alphabet):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, q = _letter_counts(x, alphabet), _letter_counts(y, alphabet)
    squares = p @ q.T
    squares *= -2
    squares += (p * p).sum(axis=1)[:, None]
    squares += (q * q).sum(axis=1)[None, :]
    i, j = np.nonzero(squares <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    length = x.shape[1]
    kept = np.zeros(len(i), bool)
    step = max(1, COMPARED_LETTERS // max(1, length))
    for k in range(0, len(i), step):
        u, v = x[i[k : k + step]], y[j[k : k + step]]
        if v.shape[1] == length:
            kept[k : k + step] = (u != v).sum(axis=1) == 1
        else:
            start = np.logical_and.accumulate(u == v[:, :-1], axis=1).sum(axis=1)  # letters before the inserted one
            kept[k : k + step] = ((u == v[:, 1:]) | (np.arange(length) < start[:, None])).all(axis=1)
    return i[kept], j[kept]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, in both directions, of the pairs of tiles in the batches."""
    for batch in batches:
        sames = batch.column(0).to_pylist()
        texts = [batch.column(k).to_pylist() for k in (1, 3)]
        found: list[list] = [[], [], []]
        for row, same in enumerate(sames):
            counts = [batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (2, 4)]
            codes = [_codes(texts[k][row], len(counts[k])) for k in (0, 1)]
            pairs = near_pairs(*codes, same)
            words = [
                [texts[k][row][at * length : (at + 1) * length] for at in pairs[k].tolist()]
                for k, length in enumerate(c.shape[1] for c in codes)
            ]
            found[0] += words[0] + words[1]
            found[1] += words[1] + words[0]
            found[2] += counts[1][pairs[1]].tolist() + counts[0][pairs[0]].tolist()
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(found, kinds)], names=["word", "near", "near_n"])


def near_words(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``word``, ``near`` and ``near_n`` of every pair of near words, in both directions.

    Only tiles of neighbouring blocks meet, and a task gets a bounded number of products.
    """
    blocked = scratch.write(_blocked(counted))
    sizes = blocked.groupBy("block", "length", *[f"c{k}" for k in range(len(SETS))]).agg(F.count(F.lit(1)).alias("words"))
    room = F.least(F.lit(TILE_WORDS), F.greatest(F.lit(1), F.floor(TILE_LETTERS / F.greatest("length", F.lit(1)))))
    blocks = scratch.write(sizes.withColumn("tiles", F.ceil(F.col("words") / room).cast("int")))
    tiled = blocked.join(blocks.select("block", "tiles"), "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiles = scratch.write(
        tiled.groupBy("block", "tile")
        .agg(F.collect_list(F.struct("word", "n")).alias("words"))
        # words of one length need no marks between them
        .select(
            "block", "tile", F.size("words").cast("long").alias("size"),
            F.array_join("words.word", "").alias("letters"), F.col("words.n").alias("counts"),
        )
    )

    def side(name: str, letters: str) -> DataFrame:
        return tiles.select(
            F.col("block").alias(name), F.col("tile").alias(f"tile_{name}"), F.col("letters").alias(letters),
            F.col("counts").alias(f"n_{letters}"),
        )

    pairs = _tile_pairs(_block_pairs(blocks))
    light = tiles.select("block", "tile", "size")
    weight = pairs.join(light.toDF("a", "tile_a", "size_a"), ["a", "tile_a"]).join(light.toDF("b", "tile_b", "size_b"), ["b", "tile_b"])
    pairs, (products,) = scratch.write_counted(
        weight.select("a", "tile_a", "b", "tile_b", (F.col("size_a") * F.col("size_b")).alias("products")),
        F.sum(F.col("products") * 100 + 1_000_000),  # 100 letters, and what a pair costs at all
    )
    cores = counted.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-(products or 0) // TASK_PRODUCTS))
    joined = (
        pairs.join(side("a", "left"), ["a", "tile_a"])
        .join(side("b", "right"), ["b", "tile_b"])
        .repartition(tasks, "a", "tile_a", "b", "tile_b")
        .select(F.expr("a = b and tile_a = tile_b").alias("same"), "left", "n_left", "right", "n_right")
    )
    found = scratch.write(joined.mapInArrow(_compare, "word string, near string, near_n long"))
    scratch.drop(blocked, blocks, tiles, pairs)
    return found


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word`` and ``root`` of every word that has a form: each round doubles the steps followed."""
    table, left = scratch.write_counted(
        forms.select("word", F.col("form").alias("root")), F.count(F.lit(1))
    )
    while left[0]:
        after = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = table.join(after, "root", "left")
        new, left = scratch.write_counted(
            stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            F.sum(F.col("moved").cast("long")),
        )
        scratch.drop(table)
        table = new
    return table.select("word", "root")


def group_variants(counted: DataFrame, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is
    its near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    twice its own; ``root`` follows forms to the last, which is the word itself where it has none.
    Rows that repeat a word are one word with the sum of their ``n``; a null word is left out, a
    null ``n`` counts 0, which makes no form; an empty table gives an empty one.
    """
    require_columns(counted, word_col, n_col)
    scratch = Scratch(counted.sparkSession)
    words = scratch.write(
        counted.select(F.col(word_col).alias("word"), F.coalesce(F.col(n_col), F.lit(0)).cast("long").alias("n"))
        .filter("word is not null")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    enough = (F.col("best_n") > 0) & (F.col("best_n") >= 2 * F.col("n"))
    judged = scratch.write(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(judged.filter("form is not null"), scratch)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
