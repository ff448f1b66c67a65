"""Signatures of shingle sets: universe partition, segment subsets and one-deletion neighbourhoods.

Two sets of sizes a and b with Jaccard at least t differ in at most
H = (1 - t) / (1 + t) * (a + b) items.  The universe of hashes is cut into segments; H differences
cannot spoil them all:

* an *exact* segment is spoilt by one difference: equal parts share a signature;
* a *deletion* segment is spoilt by two: parts that differ in one item at most share the signature
  of the part or of the part without one item.

The sizes are cut into bands, and a set signs for its own band and for the band below if a similar
smaller set can lie there, so both sides of a pair use the same segments.  ``allocate`` weighs for
each band how many segments of either kind to use.  A band has more exact segments than needed:
each set signs only the most telling ones: those with the most ``rare`` items, then
the fullest.  That keeps every pair, as the order is the same for all sets: if q segments of a pair
are equal, a set that leaves out at most q - 1 segments, the last ones in that order, still signs
the first of the equal ones.  Any choice of rare items keeps every pair; a good one saves partners.

Sets with many segments sign some more of them than one equal segment needs.  By the same count
every pair then shares at least ``matches`` signatures, and partners with fewer are not compared.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .hashing import mix

_SEGMENT, _BAND, _COUNT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Signatures that a spurious partner, to be compared and refused, is worth.
PARTNER_COST = 50.0
#: One more signature is signed and asked of a partner for so many that are needed.
MATCH_SHARE = 10


class Threshold(NamedTuple):
    """Similar: 100 * intersection >= percent * union."""

    percent: int

    def differences(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, n: int) -> int:
        return n * 100 // self.percent

    def smallest(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def overlap(self, a: int, b: int) -> int:
        """What similar sets of these sizes have in common at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def similar(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


class Band(NamedTuple):
    low: int
    high: int  # exclusive
    exact: int
    deletion: int
    number: int
    matches: int  # signatures that a pair shares at least, its smaller set being of this band

    @property
    def segments(self) -> int:
        return self.exact + self.deletion


def weak(tokens: float, least: int) -> float:
    """Chance that a segment of ``tokens`` expected items has no more than ``least``."""
    return math.exp(-tokens) * sum(tokens**k / math.factorial(k) for k in range(least + 1))


@lru_cache(4096)
def allocate(number: int, low: int, high: int, threshold: Threshold) -> Band:
    """The cheapest numbers of exact and deletion segments for the sets of one band.

    Cost is the signatures a set of middle size writes, plus what its signatures of one item or
    none cost in spurious partners.  Every candidate keeps all pairs.
    """
    need = threshold.differences(high - 1, threshold.largest(high - 1)) + 1
    size = (low + high) / 2
    best = None
    for deletion in {0, 1, *(need * k // 8 for k in range(1, 5))}:
        # a neighbourhood hides how many segments are equal, which larger bands count
        if 2 * deletion > need + 1 or (deletion and need >= 2 * MATCH_SHARE):
            continue
        matches = 1 if deletion else 1 + need // MATCH_SHARE
        must = max(0, need - 2 * deletion) + matches - 1
        for spare in {0, *(-(-must * k // 4) for k in (1, 2))} if must else {0}:
            unit = size / (must + spare + 2 * deletion)
            cost = must + deletion * (1 + 2 * unit)
            # of the spare segments the emptiest are not signed
            cost += PARTNER_COST * (max(0.0, (must + spare) * weak(unit, 1) - spare) + deletion * weak(2 * unit, 2))
            if best is None or (cost, deletion, spare) < best[0]:
                best = ((cost, deletion, spare), Band(low, high, must + spare, deletion, number, matches))
    return best[1]


@lru_cache(64)
def band_edges(threshold: Threshold, top: int = 1 << 40) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2, threshold.largest(edges[-1])))
    return tuple(edges)


def bands_of(n: int, threshold: Threshold) -> list[tuple[Band, int]]:
    """The bands a set of n items signs for, each with the largest partner to expect there."""
    edges = band_edges(threshold)
    at = int(np.searchsorted(edges, n, side="right")) - 1
    found = [(allocate(at, edges[at], edges[at + 1], threshold), threshold.largest(n))]
    below = at - 1
    while below >= 0 and edges[below + 1] - 1 >= threshold.smallest(n):
        found.append((allocate(below, edges[below], edges[below + 1], threshold), edges[below + 1] - 1))
        below -= 1
    return found


def matches_of(n: int, threshold: Threshold) -> int:
    """Signatures that a set of n items shares at least with a similar set that is not smaller."""
    return bands_of(n, threshold)[0][0].matches if n else 0


SKETCH_BITS = 512


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the items per hash value: two sets differ in as many items as bits at least."""
    counts = np.bincount((items >> np.uint64(64 - 9)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(items: np.ndarray, threshold: Threshold, rare: np.ndarray) -> np.ndarray:
    """Distinct signatures of a sorted set of hashes; similar sets share one at least.

    ``rare`` is 0 for items to be expected in many sets, else 1; an item has the same in all sets.
    """
    n = len(items)
    if not n:
        return np.empty(0, np.uint64)
    scattered = mix(items + _COUNT)
    rare = rare.astype(np.int64)
    found = [
        _band_signatures(items, scattered, rare, band, threshold.differences(n, partner))
        for band, partner in bands_of(n, threshold)
    ]
    return np.unique(np.concatenate(found))


def _band_signatures(
    items: np.ndarray, scattered: np.ndarray, rare: np.ndarray, band: Band, differences: int
) -> np.ndarray:
    # items are sorted hashes: equal ranges of the high bits are the segments, a deletion segment has two
    width = band.exact + 2 * band.deletion
    unit = ((items >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
    segment = np.where(unit < 2 * band.deletion, unit >> np.uint64(1), unit - np.uint64(band.deletion))
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sums = np.add.reduceat(scattered, starts)
    counts = np.diff(np.append(starts, len(items)))
    present = segment[starts]
    salt = mix(np.arange(band.segments, dtype=np.uint64) * _SEGMENT + np.uint64((band.number + 1) * int(_BAND) % (1 << 64)))
    found = []
    if band.deletion:
        whole = np.zeros(band.deletion, np.uint64)
        inside = present < band.deletion
        whole[present[inside].astype(np.int64)] = sums[inside]
        found.append(mix(whole ^ salt[: band.deletion]))
        mine = segment < band.deletion
        which = segment[mine].astype(np.int64)
        found.append(mix((whole[which] - scattered[mine]) ^ salt[which]))
    wanted = min(band.exact, max(0, differences - 2 * band.deletion + band.matches))
    if wanted:
        exact = present >= band.deletion
        signed = mix((sums[exact] ^ salt[present[exact].astype(np.int64)]) + counts[exact].astype(np.uint64) * _COUNT)
        if wanted < len(signed):
            telling = np.add.reduceat(rare, starts)[exact]
            signed = signed[np.lexsort((signed, -counts[exact], -telling))[:wanted]]
        elif wanted > len(signed):  # empty segments come last in the order
            empty = np.ones(band.segments, bool)
            empty[: band.deletion] = False
            empty[present[exact].astype(np.int64)] = False
            signed = np.concatenate((signed, np.sort(mix(salt[empty] + _SEGMENT))[: wanted - len(signed)]))
        found.append(signed)
    return np.concatenate(found)
