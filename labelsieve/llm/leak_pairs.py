"""The exact way to near occurrences: pairs of unchanged grams.

An item is cut into blocks and a block into pieces, so that a near occurrence of the item
has a block with two pieces more than edits. Two of its pieces then occur unchanged, and
each piece between them has exactly one edit, which bounds their distance. Such pairs of
grams are looked up at every position of a text, and the blocks compared with the text
around by their edit distance. Nothing is lost; :mod:`leaks` is measured against it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from labelsieve.llm.texts import codepoints, salts

# The longest piece, classes of characters that blocks are compared by, characters of the
# longest block, positions whose pairs are looked up at a time, and pairs compared at a time.
LONGEST_PIECE = 8
CLASSES = 64
WORD = 64
POSITIONS_AT_ONCE = 131_072
PAIRS_AT_ONCE = 16_384

_SALTS = (salts(LONGEST_PIECE + 1, 61) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _spread(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place."""
    padded = np.concatenate([codes, np.zeros(size, codes.dtype)]).astype(np.uint32)
    out = np.zeros(len(codes), np.uint32)
    for k in range(size):
        out += padded[k : k + len(codes)] * _SALTS[k]
    return _spread(out)


def _classes(codes: np.ndarray) -> np.ndarray:
    """Characters by class; 0 is kept for what lies beyond a text."""
    return ((codes % np.uint32(CLASSES - 1) + np.uint32(1)) * (codes > 0)).astype(np.uint8)


def _cut(length: int, most: int) -> tuple[int, list[int]]:
    """Characters of a piece, and for each block of an item the edits that it may have.

    A block of ``e`` edits has ``e + 2`` pieces. The edits that the blocks may have, one
    more each, exceed ``most``, so some block has no more than its own.
    """
    for size in range(LONGEST_PIECE, 0, -1):
        blocks = min(length // size - most - 1, most + 1)
        if blocks >= 1:
            more, rest = divmod(most + 1, blocks)
            return size, [more - 1 + (b < rest) for b in range(blocks)]
    return 1, []


@dataclass(frozen=True)
class Pairs:
    """Hashes of pairs of grams of ``size`` characters, ``apart`` characters from each other.

    ``keys`` are sorted; rows of ``Items.block`` and ``Items.within`` begin at ``first``.
    ``bitmap`` has the first bits of the keys.
    """

    size: int
    apart: int
    keys: np.ndarray
    first: int
    shift: int
    bitmap: np.ndarray


@dataclass(frozen=True)
class Blocks:
    """Blocks of normalised texts, and the pairs of grams that lead to them.

    ``item``, ``start`` (in the text), ``place`` (in ``classes``), ``length`` and
    ``edits`` are by block. ``block`` and ``within`` (the place of the first gram in its
    block) are by pair.
    """

    sizes: np.ndarray
    most: np.ndarray
    classes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    place: np.ndarray
    length: np.ndarray
    edits: np.ndarray
    pairs: list[Pairs]
    block: np.ndarray
    within: np.ndarray


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * np.uint32(0x9E3779B1) + second


def blocks_of(texts: list[str], most: list[int]) -> Blocks:
    """Blocks of normalised texts, which may occur with so many edits."""
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    for k, (text, edits_of_text) in enumerate(zip(texts, most)):
        size, blocks = _cut(len(text), edits_of_text)
        start = 0
        for edits in blocks:
            rows.append((k, start, base + start, size, edits))
            start += size * (edits + 2)
        base += len(text)
    flat = codepoints("".join(texts))
    item, start, place, size, edits = np.array(rows, np.int64).reshape(-1, 5).T
    found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for q in np.unique(size).tolist():
        grams = _grams(flat, q)
        for e in np.unique(edits[size == q]).tolist():
            those = np.flatnonzero((size == q) & (edits == e))
            for i in range(e + 1):
                for j in range(i + 1, e + 2):
                    keys = _joined(grams[place[those] + q * i], grams[place[those] + q * j])
                    for moved in range(i + 1 - j, j - i):
                        many = found.setdefault((q, q * (j - i) + moved), [])
                        many.append((keys, those, np.full(len(those), q * i)))
    pairs, block, within, first = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)], 0
    for (q, apart), many in sorted(found.items()):
        keys, those, at = (np.concatenate(x) for x in zip(*many))
        order = np.argsort(keys, kind="stable")
        bits = min(22, max(16, math.ceil(math.log2(64 * len(keys)))))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[keys >> np.uint32(32 - bits)] = True
        pairs.append(Pairs(q, apart, keys[order], first, 32 - bits, bitmap))
        block.append(those[order].astype(np.int32))
        within.append(at[order].astype(np.int16))
        first += len(keys)
    return Blocks(
        np.array([len(t) for t in texts], np.int64),
        np.array(most, np.int64),
        _classes(flat),
        item,
        start,
        place,
        size * (edits + 2),
        edits,
        pairs,
        np.concatenate(block),
        np.concatenate(within),
    )


def _near_blocks(items: Blocks, classes: np.ndarray, at: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether each block occurs nearly in the text around, where its beginning is ``at``.

    A bit-parallel search, for many blocks side by side. Characters
    of a class count as equal, so the distance is never too large. ``classes`` begin
    with ``2 * WORD`` places that lie before the text.
    """
    length, edits = items.length[block], items.edits[block]
    least = np.where(length > WORD, np.int8(0), np.int8(127))
    own, row = np.unique(block, return_inverse=True)
    here, sizes = items.place[own], np.minimum(items.length[own], WORD)
    masks = np.zeros(len(own) * CLASSES, np.uint64)
    for k in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > k)
        masks[on * CLASSES + items.classes[here[on] + k]] |= np.uint64(1 << k)
    one, top = np.uint64(1), (np.minimum(length, WORD) - 1).astype(np.uint64)
    plus = np.full(len(block), ~np.uint64(0))
    minus = np.zeros(len(block), np.uint64)
    score = np.minimum(length, WORD).astype(np.int8)
    row = row.reshape(-1) * CLASSES
    place = at - edits + 2 * WORD
    for _ in range(int((np.minimum(length, WORD) + 2 * edits).max(initial=0))):
        match = masks.take(row + classes.take(place, mode="clip"))
        place += 1
        vertical = match | minus
        match = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(match | plus)
        down = plus & match
        score += ((up >> top) & one).astype(np.int8)
        score -= ((down >> top) & one).astype(np.int8)
        np.minimum(least, score, out=least)
        up <<= one
        down <<= one
        plus = down | ~(vertical | up)
        minus = up & vertical
    return least <= edits


def begins(items: Blocks, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, and the first and last place where it may begin; texts of one character are left out."""
    classes = np.concatenate([np.zeros(2 * WORD, np.uint8), _classes(codes), np.zeros(1, np.uint8)])
    grams = {q: _grams(codes, q) for q in {p.size for p in items.pairs}}
    found = [np.zeros(0, np.int64)]
    # A place may lie before the text.
    left = int(items.sizes.max(initial=0))
    wide = len(codes) + left + 1
    for low in range(0, len(codes), POSITIONS_AT_ONCE):
        places, first, many = [], [], []
        leading = {q: g[low : low + POSITIONS_AT_ONCE] * np.uint32(0x9E3779B1) for q, g in grams.items()}
        for p in items.pairs:
            second = grams[p.size][low + p.apart : low + p.apart + POSITIONS_AT_ONCE]
            key = leading[p.size][: len(second)] + second
            near = np.flatnonzero(p.bitmap.take(key >> np.uint32(p.shift)))
            key = key[near]
            begin = np.searchsorted(p.keys, key, side="left")
            count = np.searchsorted(p.keys, key, side="right") - begin
            held = np.flatnonzero(count)
            places.append(near[held] + low)
            first.append(begin[held] + p.first)
            many.append(count[held])
        if not places:
            break
        place, row, ends = np.concatenate(places), np.concatenate(first), np.cumsum(np.concatenate(many))
        for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
            flat = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(ends[-1])))
            met = np.searchsorted(ends, flat, side="right")
            pair = row[met] + flat - np.where(met > 0, ends[met - 1], 0)
            block = items.block[pair].astype(np.int64)
            at = place[met] - items.within[pair]
            near = _near_blocks(items, classes, at, block)
            block, at = block[near], at[near]
            doc = np.searchsorted(starts, place[met[near]], side="right") - 1
            at += left - items.start[block] - starts[doc]
            found.append(np.unique((doc * len(items.sizes) + items.item[block]) * wide + at))
    both, at = np.divmod(np.unique(np.concatenate(found)), wide)
    doc, item = np.divmod(both, len(items.sizes))
    # Places near each other are compared at a time.
    new = np.ones(len(at), bool)
    new[1:] = (both[1:] != both[:-1]) | (np.diff(at) > items.most[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    yield from zip(doc[first].tolist(), item[first].tolist(), (at[first] - left).tolist(), (at[last] - left).tolist())
