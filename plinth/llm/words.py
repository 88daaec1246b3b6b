"""Words, their 64-bit hashes and hashes of word n-grams, on numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z, all other bytes as they are; bytes.split() then separates at 0x20 and 0x09-0x0D.
LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))

# Fixed values of the 64-bit finaliser
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MIX_1
    x = (x ^ (x >> SHIFT)) * MIX_2
    return x ^ (x >> SHIFT)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


class Vocabulary:
    """Numbers words in order of first sight and hashes each once."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def number(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.ids), np.uint64, len(self.ids))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each position; the first n - 1 positions wrap around and are to be masked by the caller."""
    out = hashes.copy()
    for k in range(1, n):
        out = mix(out + STEP) + np.roll(hashes, k)
    return mix(out + np.uint64(n)) if n > 1 else out


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence is the only one; of none, none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + STEP) + hashes[i : len(hashes) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))
