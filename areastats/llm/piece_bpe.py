"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut wherever no piece of the vocabulary holds both neighbouring characters; what lies
between two cuts, a word, merges by itself.  The distinct words of many texts lie side by side as
symbols in one flat numpy array.  A round finds the least rank of a pair in each word, merges its
leftmost occurrences in all words at once, and drops the words that have no pair left.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .hashing import mix
from .tables import id_and_text

SPACE = "▁"
#: Characters of texts that are cut into words at once; a longer text is taken whole.
CHUNK_CHARS = 1 << 19
#: Letters and ids of known words that a Python worker keeps; beyond them it starts anew.
KNOWN_SYMBOLS = 1 << 22
#: Lists of ids that are spelled at once.
DECODED_ROWS = 64
NO_PAIR = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Factors of places in a word.
_PLACE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)

# The kinds of pieces and the model kind of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127)     <<     shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            if kind == 2:
                size, at = number(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces, pair ranks and cuts of a BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.kinds = kinds
        plain = trainer.get(3, 1) == BPE and trainer.get(35, 0) and not trainer.get(24, 0)
        if not plain or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE models with byte fallback that leave texts as they are")
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("user-defined and unused pieces are not known here")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.end = trainer.get(42, 2)
        named = [i for i, kind in enumerate(kinds) if kind == BYTE]
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_ids[[int(self.pieces[i][1:-1], 16) for i in named]] = named

        normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
        symbols = {self.pieces[i]: i for i in normal}
        letters = sorted({c for i in normal for c in self.pieces[i]})
        for c in letters:
            symbols.setdefault(c, len(self.pieces) + len(symbols))  # a letter that is no piece itself
        self._letter_symbols(letters, symbols, normal)
        self._pairs(symbols, normal, np.array(scores))
        self._space_run(scores, symbols)
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in range(len(self.pieces)):
            if kinds[i] == BYTE:
                self.bytes_of[i] = bytes([int(self.pieces[i][1:-1], 16)])
            elif kinds[i] == CONTROL:
                self.bytes_of[i] = b""
            elif kinds[i] == UNKNOWN:
                self.bytes_of[i] = self.unknown_surface
        self._tables(kinds)
        self.salt = 0
        self._forget()

    def _tables(self, kinds: list[int]) -> None:
        """What ids spell, as one run of bytes; ids that a text may end with but not hold; first letters."""
        self.width_of = np.array([len(b) for b in self.bytes_of])
        self.place_of = np.cumsum(self.width_of) - self.width_of
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.is_control = np.array(kinds) == CONTROL
        self.spaced = np.array([self.dummy_prefix and k == NORMAL and p[0] == SPACE for k, p in zip(kinds, self.pieces)])

    def _letter_symbols(self, letters: list[str], symbols: dict, normal: list[int]) -> None:
        """Symbol of every code point, -1 where no piece has it, and which letters may follow which."""
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.letter_of = np.zeros(0x110000, np.int32)
        number = {}
        for k, c in enumerate(letters, 1):
            self.symbol_of[ord(c)], self.letter_of[ord(c)], number[c] = symbols[c], k, k
        self.width = len(letters) + 1
        self.follows = np.zeros(self.width * self.width, bool)
        self.follows[[number[a] * self.width + number[b] for i in normal for a, b in zip(self.pieces[i], self.pieces[i][1:])]] = True

    def _pairs(self, symbols: dict, normal: list[int], scores: np.ndarray) -> None:
        """A hash table of the pairs that make a piece, the piece and its rank; equal scores rank equal."""
        self.radix = len(self.pieces) + len(symbols) + 1
        rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        made = {}
        for i in normal:
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    made[left * self.radix + right] = i
        self.bits = max(4, (4 * len(made)).bit_length())
        self.keys = np.full(1     <<     self.bits, -1, np.int64)
        self.merged = np.full(1     <<     self.bits, -1, np.int32)
        self.ranks = np.full(1     <<     self.bits, NO_PAIR, np.int32)
        keys = np.array(sorted(made), np.int64)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1     <<     self.bits) - 1)
            self.keys[slot], self.merged[slot], self.ranks[slot] = key, made[key], rank_of[made[key]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _space_run(self, scores: list[float], symbols: dict) -> None:
        """The longest run of spaces that is a piece, if longer runs fall into such from the left.

        That is tried out: runs rank last and alike, so that letters merge before them, and two
        more of the longest before any run leave its pieces as they are.
        """
        runs = [len(p) for p in symbols if len(p) > 1 and set(p) == {SPACE}]
        self.space_run = max(runs, default=0)
        if {scores[symbols[SPACE * n]] for n in runs} != {min(scores)}:
            self.space_run = 0
        for rest in range(1, self.space_run + 1):
            symbol, counts = self._merge([SPACE * rest, SPACE * (2 * self.space_run + rest)])
            short, long = symbol[: counts[0]].tolist(), symbol[counts[0] :].tolist()
            if long != 2 * [symbols[SPACE * self.space_run]] + short:
                self.space_run = 0
                break

    def _forget(self) -> None:
        """Known words: their number by hash, letters and ids one after the other, and where they lie."""
        self.known: dict[int, int] = {}
        self.letters, self.flat = np.empty(0, np.uint32), np.empty(0, np.int32)
        # starts and counts of letters, then of ids
        self.lies = np.empty((4, 0), np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; ``NO_PAIR`` where it makes no piece."""
        key = np.where((left >= 0) & (right >= 0), left * np.int64(self.radix) + right, -1)
        slot = self._slot(key)
        slot[key < 0] = 0
        search = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(search):  # slots that another pair has taken
            slot[search] = (slot[search] + 1) & ((1     <<     self.bits) - 1)
            held = self.keys[slot[search]]
            search = search[(held != key[search]) & (held >= 0)]
        hit = (self.keys[slot] == key) & (key >= 0)
        return np.where(hit, self.merged[slot], -1), np.where(hit, self.ranks[slot], NO_PAIR)

    def _ranked(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each symbol with the next one of its word."""
        piece, rank = np.full(len(symbol), -1, np.int32), np.full(len(symbol), NO_PAIR, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        piece[inside], rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        return piece, rank

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Last symbols of all words in order, and how many each word has.

        Letters that no piece has are -1 - code point.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        symbol = self.symbol_of[points]
        symbol = np.where(symbol < 0, -1 - points, symbol)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        piece, rank = self._ranked(symbol, word)
        done = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            goes_on = np.repeat(least < NO_PAIR, sizes)
            if not goes_on.all():
                done.append((word[~goes_on], symbol[~goes_on]))
                symbol, word, piece, rank = symbol[goes_on], word[goes_on], piece[goes_on], rank[goes_on]
                sizes, least = sizes[least < NO_PAIR], least[least < NO_PAIR]
            if len(symbol):
                symbol, word, piece, rank = self._round(symbol, word, piece, rank, sizes, least)
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(words))

    def _round(self, symbol, word, piece, rank, sizes, least):
        """Merge the pairs of least rank of every word, from the left, unless a merge makes a better pair.

        One after the other, a pair that a merge makes would go before the rest if it ranked no
        worse; a word where that happens merges its first pair only.
        """
        n = len(symbol)
        place = np.arange(n)
        bound = np.repeat(least, sizes)
        fits = rank == bound
        start = fits & ~np.concatenate(([False], fits[:-1]))
        run = np.maximum.accumulate(np.where(start, place, 0))
        take = fits & ((place - run) % 2 == 0)
        group = np.repeat(np.arange(len(sizes)), sizes)
        many = (np.bincount(group[take], minlength=len(sizes)) > 1)[group]

        at = np.flatnonzero(take & many)
        at = at[at + 2 < n]
        at = at[group[at] == group[at + 2]]
        bad = np.zeros(len(sizes), bool)
        bad[group[at[self._rank(piece[at], symbol[at + 2])[1] <= bound[at]]]] = True
        for _ in range(2):
            if bad.any():
                firsts = np.flatnonzero(take)
                firsts = firsts[np.concatenate(([True], group[firsts][1:] != group[firsts][:-1]))]
                one = np.zeros(n, bool)
                one[firsts] = True
                take &= one | ~bad[group]
            stays = ~np.concatenate(([False], take[:-1]))
            new, new_word = np.where(take, piece, symbol)[stays], word[stays]
            new_piece, new_rank = self._ranked(new, new_word)
            worse = (new_rank <= bound[stays]) & many[stays] & ~bad[group[stays]]
            if not worse.any():
                break
            bad[group[stays][worse]] = True
        return new, new_word, new_piece, new_rank

    def _ids(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: a letter that is no piece becomes the ids of its bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        if not len(odd):
            return symbol, counts
        letters = {int(self.symbol_of[p]): p for p in np.flatnonzero(self.symbol_of >= len(self.pieces)).tolist()}
        spelled = [chr(letters[s] if s >= 0 else -1 - s).encode() for s in symbol[odd].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[odd] = [len(s) for s in spelled]
        ids = np.repeat(symbol, width)
        ends = np.cumsum(width)
        places = np.repeat(ends[odd] - width[odd], width[odd])
        within = np.arange(len(places)) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
        ids[places + within] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        owner = np.repeat(np.arange(len(counts)), counts)
        return ids, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def _cuts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where words start: at the given edges and wherever no piece holds both neighbours."""
        letter = self.letter_of[points]
        starts = np.ones(len(points), bool)
        starts[1:] = ~self.follows[letter[:-1] * self.width + letter[1:]]
        starts[edges[edges < len(points)]] = True
        if self.space_run:
            space = points == ord(SPACE)
            place = np.arange(len(points))
            run = np.maximum.accumulate(np.where(~space | starts, place, 0))
            starts |= space & (place > run) & ((place - run) % self.space_run == 0)
        return np.flatnonzero(starts)

    def _learn(self, hashes: list[int], words: list[str], points: np.ndarray) -> None:
        symbol, counts = self._merge(words)
        ids, counts = self._ids(symbol, counts)
        for h in hashes:
            self.known[h] = len(self.known)
        sizes = np.array([len(w) for w in words], np.int64)
        lies = [len(self.letters) + np.cumsum(sizes) - sizes, sizes, len(self.flat) + np.cumsum(counts) - counts, counts]
        self.letters, self.flat = np.append(self.letters, points), np.append(self.flat, ids.astype(np.int32))
        self.lies = np.concatenate((self.lies, lies), axis=1)

    def _hashes(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place = (np.arange(len(points)) - np.repeat(starts, sizes)) & 255
        scattered = mix(points.astype(np.uint64) + np.uint64(self.salt) * _ODD) * _PLACE[place]
        return mix(np.add.reduceat(scattered, starts) + sizes.astype(np.uint64))

    def _numbers(self, joined: str, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word among the known ones, which all of them are then.

        Words are told apart by a hash and compared letter by letter with the known one; where
        two words share a hash, all is begun anew with another salt.
        """
        if len(self.flat) + len(self.letters) > KNOWN_SYMBOLS:
            self._forget()
        while True:
            hashes, first, which = np.unique(self._hashes(points, starts, sizes), return_index=True, return_inverse=True)
            hashes = hashes.tolist()
            fresh = [k for k, h in enumerate(hashes) if h not in self.known]
            if fresh:
                at, n = starts[first[fresh]], sizes[first[fresh]]
                words = [joined[a:b] for a, b in zip(at.tolist(), (at + n).tolist())]
                self._learn([hashes[k] for k in fresh], words, points[_ranges(at, n)])
            numbers = np.fromiter(map(self.known.__getitem__, hashes), np.int64, len(hashes))[which]
            if (self.lies[1][numbers] == sizes).all():
                if (self.letters[_ranges(self.lies[0][numbers], sizes)] == points).all():
                    return numbers
            self.salt += 1
            self._forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, without an end id, and how many each text has."""
        prefix = SPACE if self.dummy_prefix else ""
        texts = [prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        edges = np.cumsum([0] + [len(t) for t in texts])
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = self._cuts(points, edges)
        numbers = self._numbers(joined, points, starts, np.diff(np.append(starts, len(points))))
        counts = self.lies[3][numbers]
        ids = self.flat[_ranges(self.lies[2][numbers], counts)]
        text_of = np.searchsorted(edges, starts, side="right") - 1
        return ids, np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one after the other."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            raise ValueError(f"ids {ids.min()} to {ids.max()} in a vocabulary of {len(self.pieces)}")
        ends = np.cumsum(counts)
        starts = ends - counts
        inside = self.is_control[ids]
        inside[ends[counts > 0] - 1] = False  # the end id says nothing more
        held = np.concatenate(([0], np.cumsum(inside)))
        plain = held[ends] == held[starts]
        widths = self.width_of[ids]
        raw = self.spelled[_ranges(self.place_of[ids], widths)].tobytes()
        at = np.concatenate(([0], np.cumsum(widths)))
        cut = [bool(n and self.spaced[ids[k]]) for k, n in zip(starts.tolist(), counts.tolist())]
        texts = []
        for k, (a, b) in enumerate(zip(at[starts].tolist(), at[ends].tolist())):
            if plain[k]:
                texts.append(_decode_bytes(raw[a + cut[k] : b]))
            else:
                texts.append(self.decode(ids[starts[k] : ends[k]].tolist()))
        return texts

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become one replacement character each."""
        if ids and not 0 <= min(ids) <= max(ids) < len(self.pieces):
            raise ValueError(f"ids {min(ids)} to {max(ids)} in a vocabulary of {len(self.pieces)}")
        said = [i for i in ids if self.kinds[i] != CONTROL]
        strip = bool(self.dummy_prefix and said and self.kinds[said[0]] == NORMAL and self.pieces[said[0]][0] == SPACE)
        if len(said) + 1 < len(ids) or (ids and len(said) < len(ids) and self.kinds[ids[-1]] != CONTROL):
            # a control id inside the list ends a character that was spelt in bytes
            marks = [k for k, i in enumerate(ids) if self.kinds[i] == CONTROL]
            parts = [ids[a + 1 : b] for a, b in zip([-1, *marks], [*marks, len(ids)])]
        else:
            parts = [said]
        text = "".join(_decode_bytes(b"".join(map(self.bytes_of.__getitem__, part))) for part in parts)
        return text[1:] if strip else text


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("areastats_one_by_one", _one_by_one)


def _decode_bytes(raw: bytes) -> str:
    return raw.decode(errors="areastats_one_by_one")


@lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file; each Python worker builds it once."""
    return Vocabulary(model)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for text in texts:
        if chunk and chars + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
        chunk.append(text)
        chars += len(text)
    if chunk:
        yield chunk


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the ids of the whole text and the end id, of every row.

    A null or empty text has the end id only.  Rows are encoded one by one: repeated and null ids
    stay as they are, other columns are not read, and an empty table gives an empty one.
    """
    named = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            at = 0
            for chunk in _chunks([text or "" for text in batch.column(1).to_pylist()]):
                ids, counts = words.encode(chunk)
                ids = np.insert(ids, np.cumsum(counts), words.end)
                offsets = np.concatenate(([0], np.cumsum(counts + 1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(chunk)), lists], names=["doc_id", "ids"])
                at += len(chunk)

    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and ``text``, what the ids spell, of every row.

    The prefix that encoding put before the text is dropped, control ids spell nothing, bytes that
    are no UTF-8 become replacement characters.  A null list spells an empty text, a null id nothing;
    an id that the vocabulary lacks is an error.
    """
    named = id_and_text(encoded, id_col, ids_col).withColumnRenamed("text", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            for row in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(row, DECODED_ROWS)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                if flat.null_count:
                    owner = np.repeat(np.arange(len(sizes)), sizes)[np.asarray(flat.is_valid())]
                    flat, sizes = flat.drop_null(), np.bincount(owner, minlength=len(sizes))
                texts = words.decode_all(flat.to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
