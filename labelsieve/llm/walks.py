"""Randomised embedding of edit distance into Hamming distance.

A walk reads a text from left to right. At every step it writes the character under
it; a random bit that depends on the step and the character, the same for all texts,
says whether it moves on. Two texts that differ by an edit soon fall into step again,
so what they write agrees in most steps.

The walk is stored by character: ``at[i]`` is the step at which character i is first
written, and it is written until step ``at[i + 1]``.
"""

from __future__ import annotations

import numpy as np

from labelsieve.llm.texts import FEW_TEXTS, blocks, salts, still_running

# The random bits repeat after so many steps, and characters share them by so many
# classes. A character is written at most so often in a row.
PERIOD = 2048
CLASSES = 256
LONGEST_STAY = 16


def _stays(seed: int) -> np.ndarray:
    """Steps that a walk stays on a character, by class and step: 1 and on, halving."""
    bits = salts(CLASSES * PERIOD, seed) >> np.uint64(20)
    move = ((bits >> np.uint64(7)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    stay = np.full((CLASSES, PERIOD), LONGEST_STAY, np.int64)
    for k in range(LONGEST_STAY - 1, 0, -1):
        stay[np.roll(move, -(k - 1), axis=1)] = k
    return stay


class Walks:
    """Walks with the random bits of one seed."""

    def __init__(self, seed: int = 1):
        self.stay = _stays(seed).ravel()
        self._stay_list = self.stay.astype(np.uint8).tobytes()

    def steps(self, texts: list[np.ndarray], begin: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """For texts of code points: the step at which each character is first written.

        ``begin`` holds the first step of each text (0 by default). Also returned: the
        step after the last one. The texts of a block are walked side by side, the few
        longest of them one by one.
        """
        first = np.zeros(len(texts), np.int64) if begin is None else np.asarray(begin, np.int64)
        at: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        end = first.copy()
        mask = PERIOD - 1
        for block in blocks([len(t) for t in texts]):
            lengths = np.array([len(texts[i]) for i in block], np.int64)
            starts = np.cumsum(lengths) - lengths
            flat = (np.concatenate([texts[i] for i in block]).astype(np.int64) % CLASSES) * PERIOD
            written = np.empty(len(flat), np.int64)
            step = first[block]
            running = still_running(lengths)
            together = int(np.searchsorted(-running, -FEW_TEXTS, side="right"))
            for i in range(together):
                n = running[i]
                here = starts[:n] + i
                now = step[:n]
                written[here] = now
                step[:n] = now + self.stay.take(flat.take(here) + (now & mask))
            for k in range(int(running[together]) if together < len(running) else 0):
                now, stay = int(step[k]), self._stay_list
                for i in range(starts[k] + together, starts[k] + lengths[k]):
                    written[i] = now
                    now += stay[flat[i] + (now & mask)]
                step[k] = now
            for k, i in enumerate(block):
                at[i] = written[starts[k] : starts[k] + lengths[k]]
            end[block] = step
        return at, end
