"""Word shingles as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Characters of the words whose hashes a Python worker keeps between tasks, at most, and of the longest of them.
WORDS_CHARS, LONGEST = 5_000_000, 64


class _Known(dict):
    held = 0

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if self.held > WORDS_CHARS:
                self.clear()
                self.held = 0
            self[word] = h
            self.held += len(word) + 8
        return h


_known = _Known()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` lower-cased words; of fewer words, the one of all.

    Words are runs of letters, digits and underscores. No words, no shingles.
    """
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = _mix(total + h[i : i + n])
    return np.unique(total)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(977)
    return r.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, count, dtype=np.uint32)


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The least of each permutation's values over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), chunk):
            np.minimum(least, (x[at : at + chunk, None] * mul + add).min(0), out=least)
    return least
