"""Small helpers on texts inside tasks: code points, blocks of equal length, word hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

# Texts that are walked side by side, and how many still make that worth while.
BLOCK_TEXTS = 512
FEW_TEXTS = 24


def plain(text) -> str:
    """A text, or an empty one for null."""
    return text if isinstance(text, str) else ""


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(lengths: Sequence[int], most: int = BLOCK_TEXTS) -> Iterator[np.ndarray]:
    """Positions of the texts, longest first, in blocks of similar length."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    for start in range(0, len(order), most):
        yield order[start : start + most]


def chunks(values: Sequence, sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to ``most`` or to one value."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(values):
        yield slice(start, len(values))


def still_running(lengths: np.ndarray) -> np.ndarray:
    """For descending ``lengths``: how many texts have a character at each position."""
    longest = int(lengths[0]) if len(lengths) else 0
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(steps + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of each text, in order, and where each text begins.

    ``hashes`` holds the words of all texts, ``starts`` where each text begins and the
    end. A text of fewer than ``n`` words has one shingle of all of them, a text
    without words has none.
    """
    counts = np.diff(starts)
    width = salts(n, 5)
    with np.errstate(over="ignore"):
        total = len(hashes)
        joined = np.zeros(total, np.uint64)
        for k in range(n):
            part = hashes[k:] * width[k]
            joined[: len(part)] += part
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), sizes)
        at = np.arange(begins[-1]) - begins[owner] + starts[:-1][owner]
        out = joined[at]
        for t in np.flatnonzero((counts > 0) & (counts < n)):
            words = hashes[starts[t] : starts[t + 1]]
            out[begins[t]] = (words * width[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix(out), begins
