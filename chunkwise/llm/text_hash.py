"""Words, five-word shingles and 64-bit hashes shared by the operators on shingles.

A *word* is a token between white space, lower-cased, with everything but
letters and digits (and ``_``) taken out; a token without any is no word.  A
*shingle* is five consecutive words.  A text of one to four words has one
shingle made of all its words; a null text or one without words has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
CACHE_WORDS = 300_000  # per Python worker; beyond it the cache starts anew
_MUL = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = re.compile(r"\W+")


class _WordHashes(dict):
    """token -> 64-bit hash of its word; 0 if it has none."""

    def __missing__(self, token: str) -> int:
        word = _NOT_WORD.sub("", token.lower())
        value = (xxhash.xxh3_64_intdigest(word) or 1) if word else 0
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = value
        return value


_WORDS = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (every input bit reaches every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    """The words themselves, for readable code on small data (tests)."""
    out = (_NOT_WORD.sub("", t.lower()) for t in (text or "").split())
    return [w for w in out if w]


def word_hashes(text: str | None) -> np.ndarray:
    tokens = text.split() if text else []
    out = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    return out[out != 0]


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """One hash per shingle, in text order, repeats included."""
    return fold_shingles(word_hashes(text), width)


def fold_shingles(w: np.ndarray, width: int = WIDTH) -> np.ndarray:
    if len(w) == 0:
        return w
    n = min(width, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _MUL + w[i : len(w) - n + 1 + i]
    return mix(out)


def digest(text: str | None) -> bytes:
    """128-bit digest of the word sequence; equal for texts with equal words."""
    return xxhash.xxh3_128_digest(word_hashes(text).tobytes())
