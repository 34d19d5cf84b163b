"""Places far along in the standard library's random numbers, so that several tasks draw from one sequence.

The generator's next word is a linear function over GF(2) of its last 624. So the state after any number of words is a sum of early
states, picked by the coefficients of x**words modulo the generator's characteristic polynomial.
"""

from __future__ import annotations

import functools
import random

import numpy as np

WORDS, MIDDLE, DEGREE = 624, 397, 19937
MATRIX = 0x9908B0DF


def _times(a: int, b: int) -> int:
    """The product over GF(2); bit i of a number stands for x**i."""
    out = 0
    while b:
        low = b & -b
        out ^= a << (low.bit_length() - 1)
        b ^= low
    return out


@functools.cache
def _exponents() -> list[int]:
    """Exponents of the characteristic polynomial below its degree (Matsumoto and Nishimura 1998, appendix A)."""
    upper, lower = 1 << WORDS | 1 << MIDDLE, 1 << (WORDS - 1) | 1 << (MIDDLE - 1)
    high, low = [1], [1]  # powers of upper and lower
    for _ in range(31):
        high.append(_times(high[-1], upper))
        low.append(_times(low[-1], lower))
    bit = [MATRIX >> i & 1 for i in range(32)]
    total = _times(low[31], upper)
    for i in range(31):
        total ^= _times(low[30 - i], upper) if bit[i] else 0
    total ^= bit[31]
    return [i for i in range(DEGREE) if total >> i & 1]


def _reduced(p: int) -> int:
    """p modulo the characteristic polynomial."""
    while (over := p >> DEGREE):
        p &= (1 << DEGREE) - 1
        for e in _exponents():
            p ^= over << e
    return p


def steps(words: int) -> np.ndarray:
    """Exponents of x**words modulo the characteristic polynomial."""
    p = 1
    for digit in bin(words)[2:]:
        p = _reduced(int("0".join(bin(p)[2:]), 2))  # squared: every bit moves to twice its place
        if digit == "1":
            p = _reduced(p << 1)
    return np.array([i for i, b in enumerate(bin(p)[:1:-1]) if b == "1"], np.int64)


def seeded(seed: int) -> np.ndarray:
    """The 624 words of random.Random(seed) before its first number."""
    return np.array(random.Random(seed).getstate()[1][:-1], np.uint32)


def generator(state: np.ndarray) -> np.random.Generator:
    """Its random() makes the numbers of the standard library's generator in this state."""
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": WORDS}}
    return np.random.Generator(bits)


def ahead(state: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The state so many words on, taken being their steps()."""
    bits = generator(state).bit_generator
    parts = [state]
    while len(parts) * WORDS < DEGREE + WORDS:
        bits.random_raw(WORDS, output=False)
        parts.append(bits.state["state"]["key"].copy())
    early = np.lib.stride_tricks.sliding_window_view(np.concatenate(parts), WORDS)
    out = np.zeros(WORDS, np.uint32)
    for a in range(0, len(taken), 512):
        out ^= np.bitwise_xor.reduce(early[taken[a : a + 512]], axis=0)
    return out
