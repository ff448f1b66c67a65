"""64-bit hashes of words and word runs, vectorised over the words of one text."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


# Random 64-bit factors of byte values and of places in a word.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = mix(np.arange(1, 257, dtype=np.uint64) * _A) | np.uint64(1)


def word_hashes(text: bytes, letters: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text, all bytes at once.

    ``letters`` maps a byte to the byte it counts as, or to 0 where it separates words.  A word's
    hash is the sum over its bytes of a random factor of the byte times one of its place; words
    longer than the table of places are hashed one by one.
    """
    mapped = letters[np.frombuffer(text, np.uint8)]
    inside = np.concatenate(([False], mapped != 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    gone = np.cumsum(np.concatenate(([starts[0]], starts[1:] - ends[:-1])))  # separators before each word
    chars = mapped[mapped != 0]
    first = starts - gone
    place = (np.arange(len(chars)) - np.repeat(first, lengths)) & 255
    hashes = mix(np.add.reduceat(_BYTE[chars] * _PLACE[place], first) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > 256):
        hashes[i] = xxh3_64_intdigest(mapped[starts[i] : ends[i]].tobytes())
    return hashes


def letter_table(separators: bytes) -> np.ndarray:
    """A-Z as a-z, separators as 0, every other byte as itself; a zero byte that is none as 255."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 255  # no byte of UTF-8
    table[list(separators)] = 0
    return table


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words; none if there are fewer words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), int(_ODD)
    for k in range(length):
        total += hashes[k : k + n] * np.uint64(factor)
        factor = (factor * int(_ODD) + 2 * length) % (1 << 64)
    return mix(total + np.uint64(length))


def shingle_set(hashes: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than one shingle count as one as a whole."""
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(length, len(hashes))))
