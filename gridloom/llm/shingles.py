"""Word shingles of texts as sorted arrays of 64-bit hashes.

Texts are lower-cased A-Z and cut into words at ASCII white space. A text of fewer than five words has one
shingle, all its words; a text without words has none. Hashes are of 64 bits: two shingles that meet
in one comparison of texts of n shingles are taken for one another once in about 2**64 / n**2 comparisons.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_M = np.uint64(0x9E3779B97F4A7C15)
_S1, _S2 = np.uint64(29), np.uint64(32)
#: Words whose hashes a worker remembers; over that it forgets them all.
CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    z = columns[0] * _M
    for c in columns[1:]:
        z ^= z >> _S1
        z *= _M
        z += c
    z ^= z >> _S2
    z *= _M
    z ^= z >> _S1
    return z


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text in UTF-8, ascending."""
    words = (text or b"").lower().split()
    h = word_hashes(words)
    if len(h) < size:
        return _fold([np.array([len(h)], np.uint64), *(h[i : i + 1] for i in range(len(h)))]) if len(h) else h
    return np.unique(_fold([h[k : len(h) - size + 1 + k] for k in range(size)]))


def set_id(tokens: np.ndarray) -> int:
    """One signed 64-bit id for equal sets."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
