"""Exact Jaccard join of texts as sets of word shingles, and the groups that its links form."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Scratch, small, text_batches
from .components import components
from .hashing import letter_table, mix, shingle_set, word_hashes
from .segments import Threshold, matches_of, signatures, sketch
from .tables import id_and_text, only_ids

#: Texts and signatures after which a task writes what it has signed.
BLOCK_TEXTS, BLOCK_SIGNATURES = 10_000, 1 << 20
#: In one block of texts, a signature of so many of them is hot: its rows are dealt by block.
HOT_IN_BLOCK = 64

#: Buckets of the second round with more texts are compared by rare shingles instead of pair by pair.
CROWDED = 64
#: Places that count shingles, which bounds what the driver and tasks hold.
PLACE_BITS = 18
PLACES = 1 << PLACE_BITS
#: Size classes of the partners that a threshold allows a set.
SIZE_CLASSES = 4

#: A place is common if it holds so many shingles more than the middle one: this share of the
#: texts, but never fewer than the least.
COMMON_SHARE, COMMON_LEAST = 4 / 10_000, 4

LETTERS = letter_table(b" \t\n\x0b\x0c\r")


def shingles(text: bytes, length: int) -> np.ndarray:
    """The set of a UTF-8 text: A-Z lowered, words split at ASCII white space."""
    return shingle_set(word_hashes(text, LETTERS), length)


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def place_counts(texts: DataFrame, length: int) -> np.ndarray:
    """How many shingles of all texts (id, text) fall on each of ``PLACES`` places."""
    held = texts.mapInArrow(_count_places(length), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counted, counts = held.toArrow(), np.zeros(PLACES, np.int64)  # a row per place at most
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return counts


def common_places(texts: DataFrame, length: int) -> np.ndarray:
    """Whether each place holds a shingle of many texts, packed into bits; counted over all texts.

    Rare shingles fall evenly on the places, so what a place has beyond the middle one is due to
    shingles that many texts share.
    """
    counts = place_counts(texts, length)
    return np.packbits(counts >= np.median(counts) + max(COMMON_LEAST, COMMON_SHARE * texts.count()))


def _sign(length: int, threshold: Threshold, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rare = TaskContext.get().partitionId() << 24, 1 - np.unpackbits(common)
        ids, sizes, digests, sketches, signed, seen = [], [], [], [], [], set()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            ids.append(batch.column(0).take(np.arange(len(texts))))  # a copy, which does not keep the texts
            has_id = pa.compute.is_valid(batch.column(0)).to_pylist()
            for text, named in zip(texts, has_id):
                items = shingles(text.as_py() or b"", length)
                digest = xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None
                sizes.append(len(items))
                digests.append(digest)
                sketches.append(sketch(items))
                # equal sets of a block need one signer; a row without id has no links
                signs = named and digest not in seen
                signed.append(signatures(items, threshold, rare[_place(items)]) if signs else np.empty(0, np.uint64))
                if named:
                    seen.add(digest)
            if len(signed) >= BLOCK_TEXTS or sum(map(len, signed)) >= BLOCK_SIGNATURES:
                part += 1
                yield _signed_block(ids, sizes, digests, sketches, signed, threshold, part)
                ids, sizes, digests, sketches, signed, seen = [], [], [], [], [], set()
        if signed:
            yield _signed_block(ids, sizes, digests, sketches, signed, threshold, part + 1)

    return run


def _signed_block(
    ids: list, sizes: list, digests: list, sketches: list, signed: list, threshold: Threshold, part: int
) -> pa.RecordBatch:
    flat = np.concatenate([np.empty(0, np.uint64), *signed])
    owner = np.repeat(np.arange(len(signed)), [len(x) for x in signed])
    values, first, which, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    hot = (counts >= HOT_IN_BLOCK)[which]
    plain = ~hot
    plain[first] = True  # one row of a hot signature speaks for the block
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays(ids),
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array([matches_of(n, threshold) for n in sizes], pa.int32()),
            pa.array(sketches, pa.list_(pa.int64())),
            _lists(flat, owner, plain, len(signed)),
            _lists(flat, owner, hot, len(signed)),
            pa.array([part] * len(signed), pa.int64()),
        ],
        names=["doc_id", "n_shingles", "digest", "matches", "sketch", "signs", "hot", "part"],
    )


def _lists(flat: np.ndarray, owner: np.ndarray, chosen: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[chosen], minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[chosen].view(np.int64)))


def _compare(length: int, threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # rows come sorted by their pivot

        def items(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[node] = shingles(text.as_py(), length)
            return known[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts_a, texts_b = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            linked = []
            for i, (x, y) in enumerate(zip(a, b)):
                mine, yours = items(x, texts_a[i]), items(y, texts_b[i])
                common = len(np.intersect1d(mine, yours, assume_unique=True))
                linked.append(threshold.similar(common, len(mine), len(yours)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


@lru_cache(8)
def _class_edges(threshold: Threshold, top: int = 1 << 40) -> np.ndarray:
    """Least size of each class: every size a class of its own, then steps of a share of the threshold."""
    step = (100 / threshold.percent) ** (1 / SIZE_CLASSES)
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, math.floor(edges[-1] * step)))
    return np.array(edges)


def prefix_lengths(n: int, threshold: Threshold) -> tuple[int, int, list[tuple[int, int]]]:
    """Class and prefix of a set of n items as the smaller of a pair, then both per class of smaller partners.

    Order all items in any one way.  Sets of a and b items that are similar have at least
    c = threshold.overlap(a, b) in common, so the first a - c + 1 items of the one and the first
    b - c + 1 of the other have one in common.
    """
    edges = _class_edges(threshold)
    of = lambda size: int(np.searchsorted(edges, size, side="right")) - 1
    least = max(1, threshold.smallest(n))
    larger = []
    for k in range(of(least), of(n) + 1):
        partner = max(least, int(edges[k]))
        larger.append((k, n - threshold.overlap(partner, n) + 1))
    return of(n), n - threshold.overlap(n, n) + 1, larger


def _count_places(length: int):
    """How many shingles of a task's texts fall on each of ``PLACES`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(1)):
                np.add.at(counts, _place(shingles(text.as_py() or b"", length)), 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["place", "n"])

    return run


def _place(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _prefix_keys(length: int, threshold: Threshold, counts: np.ndarray):
    """Keys of the first shingles of each text, the rarest first, as the smaller and the larger of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            smaller, larger = [], []
            for text in as_bytes(batch.column(1)):
                items = shingles(text.as_py(), length)
                items = items[np.lexsort((items, counts[_place(items)]))]
                own, prefix, classes = prefix_lengths(len(items), threshold)
                key = lambda k, n: mix(items[:n] ^ mix(np.array([k + 1], np.uint64)))
                smaller.append(key(own, prefix).view(np.int64))
                larger.append(np.concatenate([key(k, n) for k, n in classes]).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(smaller, kind), pa.array(larger, kind)], names=["rep", "smaller", "larger"]
            )

    return run


class ShingleJoin:
    """The links of one table of texts.

    Pairs of set representatives are found in two rounds.  In the first, every bucket of equal
    signatures compares its least member with each other one.  Where that leaves a bucket in one
    component nothing is left to find there.  The second round compares the rest: pairs whose
    components differ and that share enough buckets, all of which are unsettled.  So no round
    lists all pairs of a group of copies.  Nor does it list all pairs of many unlike texts that
    share a passage and so a bucket: texts of a crowded bucket meet where they share one of their
    rarest shingles.
    """

    def __init__(self, docs: DataFrame, length: int, percent: int):
        self.docs, self.length, self.threshold = docs, length, Threshold(percent)
        self.scratch = Scratch(docs.sparkSession)

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, n_shingles, rep) and components (node, component) of the reps."""
        scratch, kind = self.scratch, self.docs.schema["doc_id"].dataType.simpleString()
        signed = scratch.write(
            self.docs.mapInArrow(
                _sign(self.length, self.threshold, common_places(self.docs, self.length)),
                f"doc_id {kind}, n_shingles long, digest binary, matches int, sketch array<long>, signs array<long>, hot array<long>, part long",
            )
        )
        rep = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        members = scratch.write(
            signed.select("doc_id", "n_shingles", "digest", "matches", "sketch")
            .join(rep, "digest", "left")
            .select("doc_id", "n_shingles", "matches", "sketch", F.coalesce("rep", "doc_id").alias("rep"))
        )
        buckets = scratch.write(self._buckets(signed))
        scratch.drop(signed)
        nodes = members.filter("doc_id is not null").groupBy("doc_id").agg(
            F.min("rep").alias("rep"), F.max(F.struct("n_shingles", "matches", "sketch")).alias("set")
        )
        stars = scratch.write(buckets.groupBy("doc_id", "least").agg(F.count(F.lit(1)).alias("shared")))
        first = self._verify(self._as_pairs(stars, nodes))
        links = first.filter("linked")
        found = components(links, "a", "b", scratch)
        second = self._unsettled(buckets, stars, nodes, found, first)
        if second is not None:
            more = self._verify(second)
            found = components(links.unionByName(more.filter("linked")), "a", "b", scratch)
        scratch.drop(buckets, stars)
        return members, found

    def _buckets(self, signed: DataFrame) -> DataFrame:
        """Rows of signatures with several texts: signature, text and the least text beside it."""
        plain = signed.select("doc_id", F.explode("signs").alias("key"), F.lit(None).cast("long").alias("home"))
        hot = signed.filter(F.size("hot") > 0).select("doc_id", "part", F.explode("hot").alias("home"))
        dealt = hot.select("doc_id", F.xxhash64("home", "part").alias("key"), "home")
        same = Window.partitionBy("key")
        return (
            plain.unionByName(dealt)
            .filter("doc_id is not null")
            .withColumn("least", F.min("doc_id").over(same))
            .withColumn("most", F.max("doc_id").over(same))
            .filter("least < most")
            .select(F.coalesce("home", "key").alias("sign"), "doc_id", "least")
        )

    def _as_pairs(self, stars: DataFrame, nodes: DataFrame) -> DataFrame:
        """Distinct pairs of representatives whose sizes allow a link, the pivot first."""
        sized = stars.join(nodes, "doc_id").withColumnRenamed("rep", "b").withColumnRenamed("set", "set_b")
        pivot = nodes.select(F.col("doc_id").alias("least"), F.col("rep").alias("a"), F.col("set").alias("set_a"))
        # a text may share the rest of its signatures with another pivot; what is left out here is
        # counted in full in the second round
        return self._possible(sized.join(pivot, "least").filter("a <> b"), F.max("shared") * 2)

    def _possible(self, pairs: DataFrame, shared: Column) -> DataFrame:
        """Pairs that size, sketch and the count of shared signatures allow.

        Bits of the sketches that differ are differences the sets have.
        """
        percent = self.threshold.percent
        enough = f"least(set_a.n_shingles, set_b.n_shingles) * 100 >= greatest(set_a.n_shingles, set_b.n_shingles) * {percent}"
        bits = " + ".join(f"bit_count(set_a.sketch[{i}] ^ set_b.sketch[{i}])" for i in range(8))
        near = f"({bits}) * {100 + percent} <= (set_a.n_shingles + set_b.n_shingles) * {100 - percent}"
        need = F.expr("if(set_a.n_shingles <= set_b.n_shingles, set_a.matches, set_b.matches)")
        return (
            pairs.filter(f"{enough} and {near}")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), need.alias("need"), "shared")
            .groupBy("a", "b")
            .agg(F.max("need").alias("need"), shared.alias("shared"))
            .filter("shared >= need")
            .select("a", "b")
        )

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs with ``linked`` by the exact similarity of their shingle sets."""
        pairs, (count,) = self.scratch.write_counted(pairs, F.count(F.lit(1)))
        texts = self._texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * count)
        # the members' texts move first: a pivot of many pairs joins them in a join that splits skew
        joined = (
            pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
        )
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        checked = joined.mapInArrow(_compare(self.length, self.threshold), f"a {kind}, b {kind}, linked boolean")
        checked = self.scratch.write(checked)
        self.scratch.drop(pairs)
        return checked

    def _texts(self, ids: DataFrame, count: int) -> DataFrame:
        """The texts of counted ids; one text where an id is repeated."""
        texts = only_ids(self.docs.filter("doc_id is not null"), ids, count)
        one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        return texts.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")

    def _unsettled(
        self, buckets: DataFrame, stars: DataFrame, nodes: DataFrame, found: DataFrame, checked: DataFrame
    ) -> DataFrame | None:
        """Pairs of buckets that span components, between texts of different components."""
        scratch = self.scratch
        placed = (
            nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "rep", "set", F.coalesce("component", "rep").alias("c"))
        )
        ends = stars.join(placed.select("doc_id", "c"), "doc_id").join(
            placed.select(F.col("doc_id").alias("least"), F.col("c").alias("c_least")), "least"
        )
        apart, (count,) = scratch.write_counted(
            ends.filter("c <> c_least").select("doc_id", "least"), F.count(F.lit(1))
        )
        if not count:
            return None
        # written before the join, which can then split a frequent signature
        signs, (many,) = scratch.write_counted(
            buckets.join(small(apart, count, 2), ["doc_id", "least"]).select("sign").distinct(), F.count(F.lit(1))
        )
        rows = scratch.write(
            buckets.join(small(signs, many, 1), "sign").select("sign", "doc_id").join(placed, "doc_id").select("sign", "rep", "set", "c").distinct()
        )
        crowded, (crowds,) = scratch.write_counted(
            rows.groupBy("sign").count().filter(F.col("count") > CROWDED).select("sign"), F.count(F.lit(1))
        )
        crowded = small(crowded, crowds, 1)
        few = rows.join(crowded, "sign", "left_anti")
        main = few.groupBy("sign", "c").count().groupBy("sign").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
        few = few.join(main, "sign")
        left = few.filter("c <> main").selectExpr("sign", *_side("a"))
        across = left.join(few.selectExpr("sign", "main", *_side("b")), "sign").filter("c_a <> c_b and (a < b or c_b = main)")
        pairs = self._possible(across.withColumn("shared", F.lit(1)), F.sum("shared"))
        if crowds:
            many, (count,) = scratch.write_counted(
                rows.join(crowded, "sign", "left_semi").select("rep", "set", "c").distinct(), F.count(F.lit(1))
            )
            # such a pair shares a rare shingle, whatever signatures it shares
            rare = self._by_rare_shingles(many, count).withColumn("shared", F.lit(None).cast("long"))
            pairs = pairs.unionByName(self._possible(rare, F.max(F.coalesce("shared", F.lit(1 << 40))))).distinct()
        return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")

    def _by_rare_shingles(self, texts: DataFrame, count: int) -> DataFrame:
        """Pairs of texts (rep, set, c) of different components that share a shingle of their prefixes.

        Shingles are ordered by how many fall on their place, the fewest first, so what many texts
        share comes late.  Texts that have enough of their own beside a passage that all share
        have no partner then.  The order is one for all texts, so it loses no pair.
        """
        scratch, kind = self.scratch, self.docs.schema["doc_id"].dataType.simpleString()
        named = scratch.write(self._texts(texts.select(F.col("rep").alias("doc_id")), count))
        counts = place_counts(named, self.length)
        keys = named.mapInArrow(
            _prefix_keys(self.length, self.threshold, counts), f"rep {kind}, smaller array<long>, larger array<long>"
        )
        keyed = scratch.write(keys.join(small(texts, count, 12), "rep"))
        smaller = keyed.select(F.explode("smaller").alias("key"), "rep", "set", "c").selectExpr("key", *_side("a"))
        larger = keyed.select(F.explode("larger").alias("key"), "rep", "set", "c").selectExpr("key", *_side("b"))
        each = smaller.selectExpr("key", "c_a as c").unionByName(larger.selectExpr("key", "c_b as c")).groupBy("key", "c").count()
        keys, (open_keys,) = scratch.write_counted(
            each.groupBy("key")
            .agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .select("key", "main"),
            F.count(F.lit(1)),
        )
        keys = small(keys, open_keys, 2)
        smaller = smaller.join(keys, "key")
        beside = smaller.filter("c_a <> main").join(larger, "key").unionByName(
            smaller.filter("c_a = main").join(larger, "key").filter("c_b <> main")
        )
        return beside.filter("c_a <> c_b and (set_a.n_shingles < set_b.n_shingles or set_a.n_shingles = set_b.n_shingles and a < b)")


def _side(name: str) -> list[str]:
    return [f"rep as {name}", f"set as set_{name}", f"c as c_{name}"]


def shingle_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    A text's set holds its distinct shingles of ``length`` words (A-Z lowered, split at ASCII
    white space); with fewer words the whole sequence is the one shingle.  Two texts link when
    100 * intersection >= percent * union.  ``component_id`` is the least id reachable by links.
    Null and empty texts have 0 shingles, link with nothing and are components of their own.  Rows
    that repeat an id are one document to the links.  A row without id has no component.
    Sets are compared by 64-bit hashes of their shingles.
    """
    with text_batches(docs.sparkSession):
        members, found = ShingleJoin(id_and_text(docs, id_col, text_col), length, percent).run()
    return (
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    )


def one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` without all but the least id of each component; rows without id stay."""
    placed = shingle_components(docs, id_col, text_col, length, percent)
    gone, (count,) = Scratch(docs.sparkSession).write_counted(
        placed.filter("component_id <> doc_id").select("doc_id").distinct(), F.count(F.lit(1))
    )
    return docs.join(small(gone, count, 1).withColumnRenamed("doc_id", id_col), id_col, "left_anti").select(*docs.columns)
