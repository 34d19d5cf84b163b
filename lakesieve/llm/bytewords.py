"""Words and shingles of many texts at once, straight from Arrow's UTF-8 buffers, as 64-bit hashes in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z on request. A word's hash is a
polynomial over its bytes, taken from prefix sums so that its length costs nothing, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside letters, digits and UTF-8 sequences: what ends a word where punctuation counts as blank.
IS_MARK = np.ones(256, bool)
IS_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and where each text starts and ends in them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some texts: hashes, the text each is in, and how many each text has."""

    def __init__(self, texts: pa.Array, lower: bool = True, blank: np.ndarray = IS_SPACE):
        data, at = buffers(texts)
        n = len(data)
        inside = ~blank[data]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < n]
        fresh[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = at[1:][at[1:] > 0] - 1
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        value = _BYTE[LOWER[data] if lower else data] * powers(n, _BASE, "base")
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        self._total, self._inverse = total, powers(n, _BASE_INV, "inverse")[self.start]
        self.hash = mix((total[self.end] - total[self.start]) * self._inverse)
        self.count = np.diff(np.searchsorted(self.start, at))
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.data, self.at = data, at

    def prefixes(self, n_bytes: int) -> np.ndarray:
        """Hashes of the first n_bytes of each word, or of all of a shorter one; other lengths give other hashes."""
        end = np.minimum(self.end, self.start + n_bytes)
        return mix((self._total[end] - self._total[self.start]) * self._inverse + _PLACE[n_bytes])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and the text of each; a text of 1 to k-1 words has one, of all its words."""
        h, doc, n = self.hash, self.text, len(self.hash)
        acc = h * _PLACE[0]
        for j in range(1, min(k, n)):
            same = doc[j:] == doc[:-j]
            acc[:-j] += np.where(same, h[j:] * _PLACE[j], np.uint64(0))
        first = np.cumsum(self.count) - self.count
        left = self.count[doc] - (np.arange(n) - first[doc])
        short = (self.count[doc] < k) & (left == self.count[doc])
        acc[short] += left[short].astype(np.uint64) * _PLACE[63]
        keep = (left >= k) | short
        return mix(acc[keep]), doc[keep]


def split_by_text(values: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """values of each of n texts; text is ascending."""
    ends = np.searchsorted(text, np.arange(1, n + 1))
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if n else []
