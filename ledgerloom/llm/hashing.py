"""Word and shingle hashes of one text, vectorised in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FACTOR = _U(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = np.cumprod(np.full(n - 1, _FACTOR, _U))
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are split at ASCII white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, _U)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    starts = np.searchsorted(at, first)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE[raw[at]] * _powers(int(lengths.max()))[place], starts) + lengths.astype(_U))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a text with fewer words is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, _U(k), _U)
    for i in range(k):
        out = mix(out * _FACTOR + words[i : len(words) - k + 1 + i])
    return np.unique(out)
