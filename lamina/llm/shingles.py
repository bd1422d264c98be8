"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes kept per process before the cache starts afresh.
CACHE_WORDS = 500_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_known: dict[bytes, int] = {}


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, order-sensitive."""
    x = (a ^ (a >> np.uint64(31))) * _MIX[0] + b
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    found = list(map(_known.get, words))
    if None in found:
        if len(_known) > CACHE_WORDS:
            _known.clear()
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(found, np.uint64, len(found))


def forget() -> None:
    """Drop the kept word hashes, at the end of a task."""
    _known.clear()


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; of all words as one run, if there are fewer; of none without words."""
    take = min(size, len(hashes))
    if not take:
        return hashes
    count = len(hashes) - take + 1
    out = mix(hashes[:count], np.full(count, take, np.uint64))
    for i in range(1, take):
        out = mix(out, hashes[i : i + count])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(rolling(word_hashes(text), size))
