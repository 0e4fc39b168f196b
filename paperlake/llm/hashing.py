"""Hashes of all substrings of many texts at once, as array operations.

H[i] is the sum over j < i of R[byte j] * B^j modulo 2^64, with a fixed random
number for each byte value and B odd; (H[b] - H[a]) * B^-a depends on bytes a to
b alone. All sums wrap around in unsigned 64 bits. For substrings of 8 bytes and
more the terms can be mixed words of 8 bytes instead of single ones: sums of single
bytes cancel for some texts of two letters (Thue-Morse), those of words don't.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)


class Powers:
    """B^i and B^-i, kept for as many i as were ever needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))])
                for b in (self.base, self.inverse)
            )
        return self.up, self.down


_POWERS = {1: Powers(0x9E3779B97F4A7C15), 2: Powers(0xD6E8FEB86659FD93)}


WORD = 8


class Substrings:
    """Hashes of the substrings of one byte array; two ``which`` give independent hashes.

    With ``by_word`` a substring has ``WORD`` bytes at least, and so has the array.
    """

    def __init__(self, data: np.ndarray, which: int = 1, by_word: bool = False):
        up, self.down = _POWERS[which].to(len(data) + 1)
        self.beyond = WORD - 1 if by_word else 0
        if by_word:
            values, step = data.astype(np.uint64), 1
            while step < WORD:
                values = values[:-step] | (values[step:] << np.uint64(8 * step))
                step *= 2
            values = mixed(values ^ _values(which)[0])
        else:
            values = _values(which)[data]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end - self.beyond] - self.sums[start]) * self.down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted.

    A-Z are lower-cased and words stand between ASCII blanks. A text of fewer
    words has one shingle of all of them; one without words has none.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.cumsum(sizes) - sizes
    data = _LOWER[data]
    inside = ~_BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = Substrings(data).of(start, end)
    text = np.searchsorted(base, start, side="right") - 1
    total = np.zeros(len(word), np.uint64)
    length = np.minimum(np.bincount(text, minlength=len(texts)), words)[text]
    whole = np.arange(len(word)) + length <= len(word)
    whole[whole] = text[np.flatnonzero(whole) + length[whole] - 1] == text[whole]
    for i in range(words):
        more = whole & (length > i)
        at = np.flatnonzero(more)
        total[at] = mixed(total[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + i])
    text, total = text[whole], total[whole]
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return text[fresh], total[fresh]
