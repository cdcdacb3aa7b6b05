"""Words and shingle hashes in numpy, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def pair_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the two-word shingles, A-Z lower-cased; one of a single word; none without words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: only A-Z and ASCII blanks
    if len(h) < 2:
        return mix(h + _A) if len(h) else h
    with np.errstate(over="ignore"):
        return np.unique(mix(h[:-1] * _A + mix(h[1:])))


_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, from the words' hashes, by differences of one running polynomial sum."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, dtype=np.uint64))))
        inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - k, _BASE_INVERSE, dtype=np.uint64))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(h * power)))
        return mix((total[k:] - total[:-k]) * inverse)
