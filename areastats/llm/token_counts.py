"""Token counts that follow edits: a tree of counts over the pre-token leaves of each text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text

#: Characters of a leaf before the next place where it may end.
LEAF_CHARS = 256
#: A leaf may end before a single space between two other characters: every pre-token pattern of
#: the vocabularies at hand starts a pre-token there, so leaves are encoded apart.
CUT = re.compile(r"(?<=\S) (?=\S)")

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(ranks: bytes, pattern: str = PATTERN):
    """The encoder of a table of ranks; each Python worker builds it once."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def leaves_of(text: str) -> list[str]:
    """Consecutive pieces of the text that no pre-token spans."""
    pieces, start = [], 0
    while len(text) - start > LEAF_CHARS:
        cut = CUT.search(text, start + LEAF_CHARS - 1)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


class CountTree:
    """A segment tree over the leaves of one text: characters and tokens, summed upwards.

    Both sums lie in one array of nodes, the root at 1 and the children of node k at 2k and
    2k + 1.  An edit re-encodes the leaves it touches and, where the cut beside them is no longer
    one, the neighbours; the path of each changed leaf to the root is summed anew.  Where a text
    grows by more than its leaves can take, the tree is planted anew from the leaves' counts.
    """

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.encoded = text, 0
        self._plant(chars, tokens)

    def _plant(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.leaves = len(chars)
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _replant(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put more leaves in the places ``first`` to ``last``; the others keep their counts."""
        below, above = self.size + first, self.size + last + 1
        end = self.size + self.leaves
        leaves = list(zip(self.chars[self.size : below], self.tokens[self.size : below]))
        leaves += zip(chars, tokens)
        leaves += zip(self.chars[above:end], self.tokens[above:end])
        kept = [leaf for leaf in leaves if leaf[0]] or leaves[:1]
        self._plant([c for c, _ in kept], [t for _, t in kept])

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, the last at the end, and its start."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if place >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def edit(self, start: int, end: int, new: str, encode) -> None:
        """Replace the characters from ``start`` to before ``end``; places beyond the text are its end."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        first, begin = self.find(start)
        last, last_begin = self.find(end)
        stop = last_begin + self.chars[last + self.size]
        self.text = self.text[:start] + new + self.text[end:]
        moved = len(new) - (end - start)

        def is_cut(place: int) -> bool:
            return place <= 0 or place >= len(self.text) or CUT.match(self.text, place) is not None

        # boundary context: neighbours join while the cut between has gone
        while begin > 0 and not is_cut(begin):
            first, begin = self.find(begin - 1)
        while stop + moved < len(self.text) and not is_cut(stop + moved):
            last, _ = self.find(stop)
            stop += self.chars[last + self.size]
        region = self.text[begin : stop + moved]
        pieces = leaves_of(region)
        slots = [k for k in range(first, last + 1)]
        if len(pieces) > len(slots):
            rest = "".join(pieces[len(slots) - 1 :])
            if len(rest) > 2 * LEAF_CHARS:
                self._replant(first, last, [len(p) for p in pieces], [len(encode(p)) for p in pieces])
                self.encoded += len(region)
                return
            pieces = pieces[: len(slots) - 1] + [rest]
        for slot, piece in zip(slots, pieces + [""] * (len(slots) - len(pieces))):
            self.set_leaf(slot, len(piece), len(encode(piece)) if piece else 0)
            self.encoded += len(piece)


SCHEMA = "text string, chars array<int>, tokens array<int>"


def _build(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encode_ordinary
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1).to_pylist():
                pieces = leaves_of(text or "")
                chars.append([len(piece) for piece in pieces])
                tokens.append([len(encode(piece)) for piece in pieces])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                names=["doc_id", "text", "chars", "tokens"],
            )

    return run


def build_index(
    docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN
) -> DataFrame:
    """``doc_id``, ``text`` and the characters and tokens of every leaf, to be kept as a table.

    ``ranks`` are the lines of a vocabulary file.  A null or empty text has one leaf of 0 tokens;
    special tokens in a text are ordinary text; repeated rows are counted one by one.
    """
    mine = id_and_text(docs, id_col, text_col)
    kind = mine.schema["doc_id"].dataType.simpleString()
    return mine.mapInArrow(_build(ranks, pattern), f"doc_id {kind}, {SCHEMA}")


def _apply(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encode_ordinary
        # rows of one id stand together: its texts first, then its edits in order
        trees: list[tuple[CountTree, int, bool]] = []
        last, after_edit, out = None, False, []

        def answer():
            for tree, before, is_null in trees:
                text = None if is_null and not tree.text else tree.text
                out.append((last, before, tree.total, tree.encoded, text, tree.chars[tree.size :][: tree.leaves], tree.tokens[tree.size :][: tree.leaves]))

        def table():
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_encoded", "text", "chars", "tokens"]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            id_type = batch.column(0).type
            for doc, seq, text, chars, tokens, start, end, new in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if doc != last:
                    answer()
                    last, trees = doc, []
                if seq is None:
                    tree = CountTree(text or "", chars, tokens)
                    trees.append((tree, tree.total, text is None))
                else:
                    for tree, _, _ in trees:
                        tree.edit(start, end, new or "", encode)
            yield table()
        if trees:
            answer()
            yield table()

    return run


def apply_edits(index: DataFrame, edits: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """The index after ``edits`` (doc_id, seq, start, end, replacement), with counts before and after.

    Edits of a text apply in order of ``seq``; ``start`` and ``end`` are characters of the text as
    the edits before left it, and places beyond its end are its end.  Only what an edit touches is
    encoded again (``n_chars_encoded``).  Edits of unknown ids or without id, place or order do
    nothing.  Rows are sorted within partitions and read as a stream, so a text with very many
    edits fills no memory.
    """
    rows = index.select(
        "doc_id",
        F.lit(None).cast("long").alias("seq"),
        "text",
        "chars",
        "tokens",
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("start", "long"), ("end", "long"), ("new", "string"))],
    )
    changes = edits.filter(
        "doc_id is not null and seq is not null and start is not null and end is not null"
    ).select(
        "doc_id",
        F.col("seq").cast("long").alias("seq"),
        F.lit(None).cast("string").alias("text"),
        *[F.lit(None).cast("array<int>").alias(name) for name in ("chars", "tokens")],
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.col("replacement").alias("new"),
    )
    # rows without an id have no edits and need no partner
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    together = rows.unionByName(changes).repartition(F.col("doc_id"), spread).sortWithinPartitions(
        "doc_id", F.col("seq").asc_nulls_first(), "start", "end", "new"
    )
    kind = index.schema["doc_id"].dataType.simpleString()
    return together.mapInArrow(
        _apply(ranks, pattern),
        f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_chars_encoded long, {SCHEMA}",
    )
