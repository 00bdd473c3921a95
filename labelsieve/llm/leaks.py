"""Benchmark decontamination: near occurrences of benchmark items inside documents.

A random walk over characters turns edits into differences at a few steps. As a walk may
stay out of step after an edit, it starts anew at every character: an item, and every
window of a document that is as long as the item, is a row of short walks. Bands sample
some steps of a walk. Where enough bands of an item meet those of a document on about one
diagonal (place in the document less place in the item), the window is a candidate, and
the edit distance decides. Steps, samples, repeats and the bands that must meet depend on
the item's length, so that the target recall is reached at the most edits allowed.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.llm import leak_pairs
from labelsieve.llm.texts import chunks, codepoints, plain, salts

# An item occurs where the edit distance is at most 1 - SIMILARITY of its length.
SIMILARITY = 0.8
# Letters by which a place may cut the words at its ends: so many for each character that
# the item has beyond WHOLE_WORDS. Up to that length an item occurs as whole words only.
WHOLE_WORDS = 20
CUT_LETTERS = 4
# Share of the occurrences with the most edits that the walks' settings are chosen for.
RECALL = 0.95
# Bands of a walk.
BANDS = 2
# Characters of a gram, for a bound that no near occurrence misses.
GRAM = 4
# Classes of characters that share the walks' random bits.
CLASSES = 64
# Bands that meet at neighbouring places tell the same thing: places up to GAP apart are a
# run, and a run counts once for each SPAN places.
GAP = 8
SPAN = 12
# Characters of a document chunk that is searched at a time, places that are walked from at
# a time, and characters and number of the items that are broadcast at a time; a larger
# benchmark is searched in several rounds.
AT_ONCE = 1_000_000
PLACES_AT_ONCE = 16_384
ITEM_CHARS = 4_000_000
ITEMS = 20_000
# Scripts whose words are not set apart by spaces.
UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA980, 0xA9DF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
)


def _lower_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


class Normal:
    """Texts in lower case with single spaces, end to end, and where each character came from."""

    _table: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if Normal._table is None:
            Normal._table = _lower_table()
        codes = codepoints("\0".join(texts))
        low = Normal._table.take(codes, mode="clip")
        high = np.flatnonzero(codes > 0xFFFF)
        low[high] = codes[high]
        keep = low != 32
        keep[1:] |= keep[:-1]
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.origin = np.flatnonzero(keep)
        self.codes = low[self.origin]
        self.starts = np.searchsorted(self.origin, self.begins)

    def text(self, i: int) -> str:
        """A text without its white space at the ends and without the mark after it."""
        codes = self.codes[self.starts[i] : self.starts[i + 1]]
        codes = codes[:-1] if i + 2 < len(self.starts) else codes
        return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _word_table() -> np.ndarray:
    table = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x10000)])
    for first, last in UNSPACED:
        table[first : last + 1] = False
    return table


_in_words: np.ndarray | None = None


def _bounds(codes: np.ndarray) -> np.ndarray:
    """Whether a word may begin or end before each character, and after the last one.

    Not between two letters, marks or digits. Scripts without spaces, and characters
    beyond 16 bits, end words everywhere.
    """
    global _in_words
    if _in_words is None:
        _in_words = _word_table()
    word = np.zeros(len(codes) + 2, bool)
    word[1:-1] = _in_words.take(codes, mode="clip") & (codes < 0x10000)
    return ~(word[:-1] & word[1:])


@dataclass(frozen=True)
class Grade:
    """How items from ``least`` characters on are searched.

    Walks of ``steps`` steps see at most ``reach`` characters, for each of ``seeds`` walks.
    A band samples every ``stride``-th of a walk's steps, from a step of its own on (the
    first two steps have bands); ``votes`` bands must meet. ``edges``: walks start at both
    ends of the item only, and run inwards.
    """

    least: int
    steps: int
    reach: int
    stride: int
    seeds: int
    votes: int
    # Share of the item's characters at which a short walk meets one of the item.
    meet: float = 0.0
    edges: bool = False

    @property
    def bands(self) -> int:
        return min(BANDS, self.stride)


# By falling length. The recall at a fifth of edits, measured on items of each grade, is in
# the README.
GRADES = (
    Grade(160, 28, 20, 2, 1, 2, 0.22),
    Grade(120, 28, 20, 2, 1, 1, 0.18),
    Grade(80, 28, 20, 2, 1, 1, 0.15),
    Grade(56, 24, 18, 2, 2, 1, 0.1),
    Grade(32, 16, 14, 2, 2, 1, 0.06),
    Grade(WHOLE_WORDS, 10, 9, 2, 2, 1),
    Grade(12, 12, 12, 3, 4, 1, edges=True),
    Grade(8, 8, 8, 2, 4, 1, edges=True),
    Grade(5, 5, 5, 2, 4, 1, edges=True),
    Grade(1, 1, 1, 1, 1, 1, edges=True),
)
# Before the edit distance is taken, short walks about a candidate must meet those of the
# item, a share of its characters (the grade's ``meet``) that all but about one in a hundred
# occurrences with a fifth of edits have. Items have bits for the keys of their short walks.
SHORT = Grade(32, 10, 9, 1, 1, 1)
SHORT_BITS = 14
# Bits of a band's key and of a step; those of a walk share a 64-bit number.
_KEY_BITS, _STEP_BITS = 28, 6
_STEP_MASK = (1 << _STEP_BITS) - 1


@lru_cache(maxsize=64)
def _walk_table(grade: Grade, seed: int) -> np.ndarray:
    """By class and step: how many steps the walk stays, and what that adds to each band.

    The random bits are the same for all texts. A band's share of a stay is the sum, over
    the sampled steps in it, of a random number that the step and the class have.
    """
    steps = grade.steps
    bits = salts(CLASSES * steps, 1000 + seed).reshape(CLASSES, steps)
    moves = ((bits >> np.uint64(27)) & np.uint64(1)).astype(bool)
    moves[:, -1] = True
    table = np.zeros((CLASSES, steps + 1), np.int64)
    stay = np.zeros((CLASSES, steps + 1), np.int64)
    for s in range(steps - 1, -1, -1):
        stay[:, s] = np.where(moves[:, s], 1, stay[:, s + 1] + 1)
    table += stay
    for band in range(grade.bands):
        worth = salts(CLASSES * steps, 3000 + BANDS * seed + band).reshape(CLASSES, steps) >> np.uint64(40)
        for t in range(band, steps, grade.stride):
            for s in range(t + 1):
                table[:, s] += ((s + stay[:, s] > t) * worth[:, t].astype(np.int64)) << (_STEP_BITS + _KEY_BITS * band)
    return table.ravel()


class Walks:
    """The walks of one grade and seed."""

    def __init__(self, grade: Grade, seed: int):
        self.grade = grade
        self.table = _walk_table(grade, seed)
        # Classes by the row of the table that they have.
        self.width = grade.steps + 1

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Table rows of characters; so many more that a walk from the last one ends."""
        ends = np.zeros(self.grade.reach, np.int64)
        return np.concatenate([(codes % np.uint32(CLASSES)).astype(np.int64) * self.width, ends])

    def written(self, rows: np.ndarray, places: slice | np.ndarray) -> np.ndarray:
        """What walks from some places write: their steps and the keys of their bands."""
        n = places.stop - places.start if isinstance(places, slice) else len(places)
        walk, step, gain = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        for k in range(self.grade.reach):
            here = rows[places.start + k : places.stop + k] if isinstance(places, slice) else rows.take(places + k)
            np.bitwise_and(walk, _STEP_MASK, out=step)
            np.add(step, here, out=step)
            np.take(self.table, step, out=gain, mode="clip")
            np.add(walk, gain, out=walk)
        return walk

    def seen(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Characters that the walks from the first ``n`` places see."""
        step, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(self.grade.reach):
            seen += step < self.grade.steps
            step += self.table.take(rows[k : n + k] + step) & _STEP_MASK
        return seen


@dataclass(frozen=True)
class Band:
    """Sorted keys of the items' walks in one band, the item and the place in it of each.

    ``backwards``: the walk ran from the end of the item, and places count from there.
    """

    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    backwards: bool


@dataclass(frozen=True)
class Items:
    """Normalised items, their most edits, and the bands of each grade and seed."""

    ids: list
    texts: list[str]
    sizes: np.ndarray
    most: np.ndarray
    votes: np.ndarray
    meet: np.ndarray
    bands: dict[tuple[Grade, int], list[list[Band]]]
    # By item and key of a short walk, a bit.
    short: np.ndarray
    similarity: float


def _most(length: int, similarity: float) -> int:
    """Edits that an occurrence may have."""
    return int((1.0 - similarity) * length + 1e-9)


def _grade(length: int) -> int:
    return next(g for g, grade in enumerate(GRADES) if length >= grade.least)


def _key(walk: np.ndarray, band: int) -> np.ndarray:
    return (walk >> (_STEP_BITS + _KEY_BITS * band)) & ((1 << _KEY_BITS) - 1)


def _band(keys: np.ndarray, item: np.ndarray, place: np.ndarray, backwards: bool) -> Band:
    order = np.argsort(keys, kind="stable")
    bits = min(22, max(14, math.ceil(math.log2(32 * max(1, len(keys))))))
    # The last bits of a sum of random numbers are even.
    bitmap = np.zeros(1 << bits, bool)
    bitmap[keys & ((1 << bits) - 1)] = True
    return Band(keys[order].astype(np.uint32), item[order].astype(np.int32), place[order].astype(np.int32), bitmap, backwards)


def index(items: list[tuple], similarity: float = SIMILARITY) -> Items:
    """Index (id, text) pairs; null and empty texts are left out."""
    ids, texts = [], []
    for i, text in items:
        whole = Normal([plain(text)]).text(0).strip(" ")
        if whole:
            ids.append(i)
            texts.append(whole)
    sizes = np.array([len(t) for t in texts], np.int64)
    grades = np.array([_grade(len(t)) for t in texts], np.int64)
    bands: dict[tuple[Grade, int], list[list[Band]]] = {}
    # Grades with the same walks share them, whatever votes they ask for.
    walked = {g: replace(GRADES[g], least=0, votes=0, meet=0.0) for g in np.unique(grades).tolist()}
    for grade in dict.fromkeys(walked.values()):
        mine = np.flatnonzero([walked[g] == grade for g in grades.tolist()])
        flat = codepoints("".join(texts[k] for k in mine))
        lengths = sizes[mine]
        ends = np.cumsum(lengths)
        item = np.repeat(mine, lengths)
        place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        for seed in range(grade.seeds):
            walks = Walks(grade, seed)
            sides = []
            for backwards in (False, True) if grade.edges else (False,):
                rows = walks.rows(flat[::-1] if backwards else flat)
                if grade.edges:
                    # Reversed texts begin where the texts end, the last one first.
                    held = len(flat) - ends[::-1] if backwards else ends - lengths
                    whose, at = mine[::-1] if backwards else mine, np.zeros(len(mine), np.int64)
                else:
                    # Only walks that the item's own characters last for.
                    held = np.flatnonzero(place + walks.seen(rows, len(flat)) <= np.repeat(lengths, lengths))
                    whose, at = item[held], place[held]
                walk = walks.written(rows, slice(0, len(flat)))[held]
                sides.append([_band(_key(walk, b), whose, at, backwards) for b in range(grade.bands)])
            bands[grade, seed] = sides
    short = np.zeros((len(texts), (1 << SHORT_BITS) >> 3), np.uint8)
    long = np.flatnonzero(sizes >= SHORT.least)
    flat = codepoints("".join(texts[k] for k in long))
    keys, owner = _short_keys(flat), np.repeat(long, sizes[long])
    np.bitwise_or.at(short, (owner, keys >> 3), np.uint8(1) << (keys & 7).astype(np.uint8))
    return Items(
        ids,
        texts,
        sizes,
        np.array([_most(len(t), similarity) for t in texts], np.int64),
        np.array([GRADES[g].votes for g in grades], np.int64),
        np.array([GRADES[g].meet for g in grades], np.float64),
        bands,
        short,
        similarity,
    )


def _short_keys(codes: np.ndarray) -> np.ndarray:
    """A few bits of the short walk from each place."""
    walks = Walks(SHORT, 0)
    rows = walks.rows(codes)
    parts = [
        walks.written(rows, slice(low, min(low + PLACES_AT_ONCE, len(codes))))
        for low in range(0, len(codes), PLACES_AT_ONCE)
    ]
    walk = np.concatenate(parts or [np.zeros(0, np.int64)])
    return (_key(walk, 0) & ((1 << SHORT_BITS) - 1)).astype(np.int32)


def _alike(items: Items, shorts: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether enough short walks between two places are those of the item."""
    flags = items.short.ravel()
    many = np.zeros(len(item), np.int64)
    for part in chunks(item, (high - low).tolist(), AT_ONCE):
        size = high[part] - low[part]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(low[part] - (ends - size), size)
        key = shorts.take(at)
        met = flags.take(np.repeat(item[part] * items.short.shape[1], size) + (key >> 3)) >> (key & 7).astype(np.uint8)
        total = np.concatenate([[0], np.cumsum(met & 1)])
        many[part] = total[ends] - total[ends - size]
    return many >= items.meet[item] * items.sizes[item]


def _met(band: Band, walk: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which walks a band has met: their number, the item and the place in it, a row for each meeting."""
    last = (walk >> (_STEP_BITS + _KEY_BITS * number)) & (len(band.bitmap) - 1)
    near = np.flatnonzero(band.bitmap.take(last))
    keys = _key(walk[near], number).astype(np.uint32)
    first = np.searchsorted(band.keys, keys, side="left")
    many = np.searchsorted(band.keys, keys, side="right") - first
    held = np.flatnonzero(many)
    ends = np.cumsum(many[held])
    row = np.arange(int(ends[-1]) if len(ends) else 0)
    row += np.repeat(first[held] - (ends - many[held]), many[held])
    return np.repeat(near[held], many[held]), band.item[row].astype(np.int64), band.place[row].astype(np.int64)


def _candidates(items: Items, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, and the first and last place where it may begin."""
    left = int(items.sizes.max(initial=0))
    wide = len(codes) + left + 1
    many = len(items.sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bounds = None

    def add(here: np.ndarray, item: np.ndarray, begin: np.ndarray, place: np.ndarray) -> None:
        doc = np.searchsorted(starts, here, side="right") - 1
        found.append(((doc * many + item) * wide + begin - starts[doc] + left, place))

    for (grade, seed), sides in items.bands.items():
        walks = Walks(grade, seed)
        for side in sides:
            backwards = side[0].backwards
            rows = walks.rows(codes[::-1] if backwards else codes)
            places: np.ndarray | None = None
            if grade.edges:
                if bounds is None:
                    bounds = _bounds(codes)
                # Where a word may begin, and the last characters of words.
                inside = (codes != 32) & (codes != 0)
                places = np.flatnonzero((bounds[1:] if backwards else bounds[:-1]) & inside)
                places = np.sort(len(codes) - 1 - places) if backwards else places
            for low in range(0, len(codes) if places is None else len(places), PLACES_AT_ONCE):
                if places is None:
                    part: slice | np.ndarray = slice(low, min(low + PLACES_AT_ONCE, len(codes)))
                else:
                    part = places[low : low + PLACES_AT_ONCE]
                walk = walks.written(rows, part)
                for number, band in enumerate(side):
                    at, item, place = _met(band, walk, number)
                    here = at + low if places is None else part[at]
                    if backwards:
                        here = len(codes) - 1 - here
                        add(here, item, here + 1 - items.sizes[item], place)
                    else:
                        add(here, item, here - place, place)
    if not found:
        return
    key, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] - place[:-1] > GAP)
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    counted = (place - place[run]) // SPAN
    new[1:] |= counted[1:] != counted[:-1]
    both, at = np.divmod(key[new], wide)
    item = both % many
    shorts: np.ndarray | None = None
    # As many places as the item needs votes, all within its most edits.
    for votes in np.unique(items.votes[item]).tolist():
        mine = np.flatnonzero(items.votes[item] == votes)
        if votes > 1 and len(mine):
            ahead = mine[votes - 1 :]
            first = mine[: len(ahead)]
            near = (both[ahead] == both[first]) & (at[ahead] - at[first] <= items.most[item[first]])
            kept = np.zeros(len(mine), bool)
            for k in range(votes):
                kept[k : k + len(near)] |= near
            mine = mine[kept]
        key = np.unique(both[mine] * wide + at[mine])
        pair, begin = np.divmod(key, wide)
        doc, which = np.divmod(pair, many)
        # Places near each other are compared at a time.
        new = np.ones(len(begin), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (np.diff(begin) > items.most[which[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(begin))[: len(first)] - 1
        doc, which, begin, end = doc[first], which[first], begin[first] - left, begin[last] - left
        if not len(doc):
            continue
        if shorts is None and (items.sizes >= SHORT.least).any():
            shorts = _short_keys(codes)
        if shorts is not None:
            # Drops and additions mostly even out.
            drift = items.most[which] // 3
            low = starts[doc] + np.maximum(begin - drift, 0)
            high = np.minimum(starts[doc + 1], starts[doc] + end + items.sizes[which] + drift)
            kept = np.flatnonzero(_alike(items, shorts, low, np.maximum(low, high), which))
            doc, which, begin, end = doc[kept], which[kept], begin[kept], end[kept]
        yield from zip(doc.tolist(), which.tolist(), begin.tolist(), end.tolist())


def nearest(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a part of ``text``, and the end of the first such part.

    Bit-parallel: a column of differences is one integer with a bit for each
    character of the item.
    """
    m = len(item)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << k)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        match = where.get(c, 0)
        vertical = match | minus
        match |= (((match & plus) + plus) ^ plus) | minus
        up = minus | (full & ~(match | plus))
        down = plus & match
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _in_part(bounds: np.ndarray, begin: int, end: int) -> int:
    """Letters of the words at both ends that a place cuts off."""
    before, after = begin, end
    while not bounds[before]:
        before -= 1
    while not bounds[after]:
        after += 1
    return begin - before + after - end


def _allowed(items: Items, k: int, bounds: np.ndarray, begin: int, end: int) -> bool:
    """Whether the place cuts no more of the words at its ends than the item may."""
    spare = max(0, CUT_LETTERS * (len(items.texts[k]) - WHOLE_WORDS))
    reach = slice(max(0, begin - spare), begin + 1), slice(end, end + spare + 1)
    return bool(bounds[reach[0]].any() and bounds[reach[1]].any()) and _in_part(bounds, begin, end) <= spare


def _ends(item: str, region: str) -> list[tuple[int, int]]:
    """(distance, end) for each end of a part of ``region``, by falling likeness to ``item``."""
    m = len(item)
    last = list(range(m + 1))
    out = []
    for j, c in enumerate(region, 1):
        row = [0] * (m + 1)
        for i in range(1, m + 1):
            row[i] = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (item[i - 1] != c))
        last = row
        out.append((row[m], j))
    return sorted(out)


def _begins_of(item: str, region: str) -> list[tuple[int, int]]:
    """(distance, length) of each part of ``region`` that ends at its end, whole ``item`` compared."""
    m = len(item)
    last = list(range(m + 1))
    out = []
    for j, c in enumerate(reversed(region), 1):
        row = [j] + [0] * m
        for i in range(1, m + 1):
            row[i] = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (item[m - i] != c))
        last = row
        out.append((row[m], j))
    return sorted(out)


def _whole_words(items: Items, k: int, region: str, bounds: np.ndarray, low: int) -> tuple[int, int, int] | None:
    """The nearest place in a region that is allowed to begin and end there, for short items."""
    item, most = items.texts[k], int(items.most[k])
    best: tuple[int, int, int] | None = None
    for distance, end in _ends(item, region):
        if distance > most or (best and distance > best[0]):
            break
        part = region[max(0, end - len(item) - most) : end]
        for whole, length in _begins_of(item, part):
            if whole > most or (best and whole > best[0]):
                break
            place = whole, low + end - length, low + end
            if _allowed(items, k, bounds, place[1], place[2]) and (best is None or place < best):
                best = place
    return best


def _verify(
    items: Items, k: int, text: str, bounds: Callable[[], np.ndarray], first: int, last: int
) -> tuple[int, int, int] | None:
    """Distance, begin and end if the item begins about ``first`` to ``last`` of a normalised text."""
    item, most = items.texts[k], int(items.most[k])
    low = max(0, first - most)
    region = text[low : last + len(item) + most]
    at = region.find(item)
    while at >= 0:
        if _allowed(items, k, bounds(), low + at, low + at + len(item)):
            return 0, low + at, low + at + len(item)
        at = region.find(item, at + 1)
    if not most:
        return None
    # Each edit spoils at most GRAM grams of the item; the others occur in the region.
    there = {region[i : i + GRAM] for i in range(len(region) - GRAM + 1)}
    grams = len(item) - GRAM + 1
    if sum(item[i : i + GRAM] in there for i in range(grams)) < grams - GRAM * most:
        return None
    distance, end = nearest(item, region)
    if distance > most:
        return None
    # The shortest part that ends there: the same search from the other side.
    _, length = nearest(item[::-1], region[:end][::-1])
    if _allowed(items, k, bounds(), low + end - length, low + end):
        return distance, low + end - length, low + end
    # Another place may be as near, or near enough, and lie between ends of words.
    return _whole_words(items, k, region, bounds(), low) if len(item) <= 2 * WHOLE_WORDS else None


def search(items: Items, texts: list[str], exhaustive: bool = False) -> list[list[tuple[int, int, int, int]]]:
    """For each text: (item, distance, begin, end), the nearest place of each item that occurs.

    Places are code points of the given text. Of equally near places the first counts.
    ``exhaustive`` looks up pairs of unchanged grams instead of bands, which no occurrence
    escapes (of items of two characters and more): a measure for tests, and slower.
    """
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not items.ids:
        return found
    blocks = leak_pairs.blocks_of(items.texts, items.most.tolist()) if exhaustive else None
    for part in chunks(texts, [len(t) for t in texts], AT_ONCE):
        normal = Normal(texts[part])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        words: dict[int, str] = {}
        ends: dict[int, np.ndarray] = {}
        if blocks is None:
            places = _candidates(items, normal.codes, normal.starts)
        else:
            places = leak_pairs.begins(blocks, normal.codes, normal.starts)
        for d, item, first, last in places:
            if d not in words:
                words[d] = normal.text(d)

            def bounds(d: int = d) -> np.ndarray:
                if d not in ends:
                    ends[d] = _bounds(codepoints(words[d]))
                return ends[d]

            hit = _verify(items, item, words[d], bounds, first, last)
            if hit and ((d, item) not in best or hit < best[d, item]):
                best[d, item] = hit
        for (d, item), (distance, b, e) in sorted(best.items()):
            origin = normal.origin[normal.starts[d] :] - normal.begins[d]
            found[part.start + d].append((item, distance, int(origin[b]), int(origin[e - 1]) + 1))
    return found


def _rounds(items: DataFrame, text: str, similarity: float) -> Iterator[Items]:
    """Indexes of the distinct item texts, a bounded part of them at a time."""
    known = items.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    size = known.agg(F.sum(F.length("t")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    rounds = max(1, math.ceil((size["chars"] or 0) / ITEM_CHARS), math.ceil(size["n"] / ITEMS))
    for k in range(rounds):
        part = known.where(F.pmod(F.xxhash64("t"), F.lit(rounds)) == k) if rounds > 1 else known
        texts = sorted(r["t"] for r in part.collect())
        yield index([(t, t) for t in texts], similarity)


def _locator(shared: Broadcast) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def locate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in batches:
            rows = search(index, [plain(t) for t in batch])
            yield pd.Series(
                [[(index.ids[k], d, 1.0 - d / len(index.texts[k]), a, b) for k, d, a, b in row] for row in rows],
                dtype=object,
            )

    return locate


def _acquitter(shared: Broadcast) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([not row for row in search(shared.value, [plain(t) for t in batch])], dtype=bool)

    return free


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """A row for each document and item that occurs in it, exactly or nearly.

    ``doc_id``, ``item_id``, ``distance`` (edits, of lower-case text with single
    spaces), ``similarity`` (1 - distance / length of the item), ``begin`` and ``end``
    (code points of the text). Null texts and ids: a null text has no occurrence, a
    null id stays null. The same share of edits holds at every length; a place may cut
    words at its ends only as ``CUT_LETTERS`` says, and empty items are left out. Repeated
    documents and items give repeated rows; other columns are not read, whatever their
    names. Distinct item texts are broadcast, at most ``ITEM_CHARS`` characters at a time;
    an item text is searched once however often it is there.
    """
    result = None
    for part in _rounds(items, item_text, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        hit = "array<struct<item: string, distance: int, similarity: double, begin: int, end: int>>"
        found = docs.select(
            F.col(doc_id).alias("doc_id"), F.explode(F.pandas_udf(_locator(shared), hit)(F.col(text))).alias("hit")
        ).select("doc_id", "hit.*")
        result = found if result is None else result.unionByName(found)
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item"))
    return result.join(asked, "item").select("doc_id", "item_id", "distance", "similarity", "begin", "end")


def is_clean(items: DataFrame, text: Column, item_text: str = "text") -> Column:
    """True where no item occurs in the text; see :func:`find_leaks`."""
    clean = F.lit(True)
    for part in _rounds(items, item_text, SIMILARITY):
        shared = SparkSession.active().sparkContext.broadcast(part)
        clean = clean & F.pandas_udf(_acquitter(shared), "boolean")(text)
    return clean
