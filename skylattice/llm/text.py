"""Words and shingles of UTF-8 texts, on bytes. Only A-Z are lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries after which a word table starts anew, so that a worker's memory stays bounded.
CACHE_WORDS = 500_000
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed public finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingles of ``size`` words; fewer words make one shingle, none makes none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _MULTIPLIERS[0] + h[k:k + n] + _MULTIPLIERS[1])
    return np.unique(out)
