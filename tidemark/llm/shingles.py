"""Word shingles as sorted 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 400_000  # word hashes that a worker keeps
_rng = np.random.Generator(np.random.PCG64(20240229))
PLACE = _rng.integers(1, 1 << 63, 5, np.uint64) * np.uint64(2) + np.uint64(1)
M1, M2, M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
S33, S29 = np.uint64(33), np.uint64(29)


class WordHashes(dict):
    def __init__(self, most: int = WORDS):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S29)) * M2
    return x ^ (x >> S33)


def shingle_hashes(body: bytes) -> np.ndarray:
    """Sorted hashes of the distinct 5-word shingles of a UTF-8 text, A-Z in lower case; words stand between ASCII white
    space. With fewer words the whole sequence is one shingle; without words there is none."""
    words = body.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < 5:
        return scrambled((h * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * M3)
    x = h[: n - 4] * PLACE[0]
    for i in range(1, 5):
        x += h[i : n - 4 + i] * PLACE[i]
    return np.unique(scrambled(x))


class MinHash:
    def __init__(self, size: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(1, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of 32-bit minima for each set; sets must not be empty."""
        flat = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets[:-1])])
        out, x = np.empty((len(sets), len(self.a)), np.uint32), np.empty_like(flat)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(flat, a, out=x)
            np.add(x, b, out=x)
            out[:, i] = np.minimum.reduceat(x, at) >> np.uint64(32)
        return out
