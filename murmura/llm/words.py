"""Words of UTF-8 texts and their 64-bit hashes.

A word is a run of bytes other than space and \\x09-\\x0D, which is what bytes.split() separates. Words get seeded
XXH3 hashes; sequences of words get polynomials of these modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .runtime import remembered

#: Odd multiplier of the polynomials, its inverse modulo 2**64, and the multipliers of the final mixer.
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: Most words that a worker remembers; the memory is emptied beyond.
MEMORY = 400_000


class WordHashes(dict):
    """Word to hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word, seed=7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, from the memory that a worker shares among operators."""
    return remembered("word hashes", WordHashes).of(words)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits, one to one."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    return x ^ (x >> _S)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries of h, by doubling; empty if there are fewer."""
    if len(h) < n:
        return h[:0]
    done, out, power, width = 0, None, _P, 1
    part = h
    while True:
        if n & width:
            if out is None:
                out, done = part, width
            else:  # what is done already comes first
                m = len(h) - done - width + 1
                out, done = out[:m] * power + part[done : done + m], done + width
        if done == n:
            return out
        part = part[: len(part) - width] * power + part[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2


class Spans:
    """Hashes of spans of any length: differences of running sums, made independent of their place."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        while len(self.up) <= len(h):
            n = len(self.up)
            step = np.uint64(pow(int(_P), n, 1 << 64))
            back = np.uint64(pow(int(_PINV), n, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step]), np.concatenate([self.down, self.down * back])
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.down[: len(h)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.up[start] ^ (end - start).astype(np.uint64))
