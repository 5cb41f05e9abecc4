"""Word shingles of a text as sorted, distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

_WORDS: dict[bytes, int] = {}
_MOST = 100_000  #: words remembered in a Python worker; beyond that the memory starts anew


def _hash(word: bytes) -> int:
    h = _WORDS.get(word)
    if h is None:
        if len(_WORDS) >= _MOST:
            _WORDS.clear()
        h = _WORDS[word] = xxhash.xxh3_64_intdigest(word)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; null and blank texts have none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The text's distinct n-word shingles, sorted; with fewer words the whole sequence is the one shingle; without words, none."""
    h = word_hashes(text)
    if not h.size:
        return h
    k = min(n, h.size)
    out = np.full(h.size - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : h.size - k + 1 + i])
    return np.unique(out)
