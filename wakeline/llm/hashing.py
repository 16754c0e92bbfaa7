"""64-bit hashing of words and word shingles for whole batches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

KEPT = 100_000  # words whose hashes a worker keeps


class WordHash(dict):
    """Hash of each word, kept for the most part."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEPT:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another independent hash of each value for another seed."""
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


def word_hashes(words: list[str], seen: WordHash) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words; a shorter text has one shingle, an empty one none."""
    size = min(n, len(words))
    if size == 0:
        return words
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + words[k : k + len(out)] + np.uint64(k + 1))
    return out


def slices(sizes: list[int], most: int):
    """(start, end) of runs of items whose sizes add up to ``most`` at most, or single larger items."""
    start = 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (end == start or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield start, end
        start = end
