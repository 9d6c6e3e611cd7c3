"""Sets of hashed word shingles, computed on byte arrays.

Words are hashed by a polynomial over their bytes modulo 2**64 and mixed;
shingles by mixing their words' hashes in order. The values depend on nothing
but the text, so all machines and runs agree.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least `size` of each."""
    while len(_powers[0]) < size:
        n = len(_powers[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(base, n, 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, A-Z lower-cased, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    powers, inverses = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words in order; with fewer words, of the whole sequence; empty without words."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i])
    return out


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct shingles, ascending."""
    return np.unique(shingles(text, width))
