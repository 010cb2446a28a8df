"""Words and hashed word shingles of texts, in whole Arrow batches.

A word is a longest run of letters and digits, case ignored. A text's shingles are its distinct runs of
``size`` consecutive words, each a 64-bit hash that is the same on every machine.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """Hash of a word, remembered; emptied when it has grown to ``most`` entries, so memory stays bounded."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    found = words(text) if text else []
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(29))
    values = values * _MULTIPLIERS[1]
    return values ^ (values >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty if the text has fewer than ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n] * _MULTIPLIERS[0]
    for i in range(1, size):
        total = total + hashes[i : i + n] * _MULTIPLIERS[i % 5] * np.uint64(2 * (i // 5) + 1)
    return np.unique(mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both of two sorted distinct arrays."""
    return len(np.intersect1d(a, b, assume_unique=True))
