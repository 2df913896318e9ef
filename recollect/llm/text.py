"""Words and shingles, shared by the operators that run in Python."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased: exactly what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence is one shingle; no words, none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, U(width), U)
    for i in range(width):
        total = mix(total + hashes[i : n - width + 1 + i] * _MULTIPLIERS[i % len(_MULTIPLIERS)])
    return np.unique(total)
