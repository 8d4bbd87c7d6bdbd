"""Elias-Fano coding of a non-decreasing sequence of integers below a known bound.

Each value is cut into ``low`` bits, stored one after the other, and a high part,
stored in unary in one bit string: value i sets bit (high_i + i). Together that is
about 2 + log2(bound / n) bits a value. ``select`` gives a value by its index,
``search`` the index of the first value that is not smaller; both work on whole numpy
arrays and on memory-mapped words, and hold no table of 64-bit values.
"""

from __future__ import annotations

import numpy as np

_BLOCK_WORDS = 4
_BLOCK = 64 * _BLOCK_WORDS
_CHUNK = 1 << 16


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits (0/1 bytes) to little-endian 64-bit words, one spare word at the end."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros((len(packed) + 7) // 8 + 1, np.uint64)
    out.view(np.uint8)[:len(packed)] = packed
    return out


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0) in each word."""
    word, rank = word.copy(), rank.astype(np.int64)
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        part = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        right = rank >= ones
        rank -= np.where(right, ones, 0)
        at += np.where(right, width, 0)
        word = np.where(right, word >> np.uint64(width), part)
    return at


class EliasFano:
    """Immutable sequence over arrays that may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low = (int(x) for x in arrays["shape"])
        self.lows, self.highs, self.ones = arrays["lows"], arrays["highs"], arrays["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * _BLOCK - self.ones

    @staticmethod
    def encode(values: np.ndarray, bound: int | None = None) -> dict[str, np.ndarray]:
        """Arrays of the sequence; ``bound`` exceeds every value."""
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        if n and np.any(values[1:] < values[:-1]):
            raise ValueError("values must not decrease")
        if bound is None:
            bound = int(values[-1]) + 1 if n else 1
        if n and int(values[-1]) >= bound:
            raise ValueError("a value reaches the bound")
        low = min(63, max(0, (bound // max(n, 1)).bit_length() - 1))
        parts = []
        for i in range(0, n if low else 0, _CHUNK):      # a chunk fills whole words
            part = values[i:i + _CHUNK]
            parts.append(np.packbits((part[:, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1,
                                     bitorder="little"))
        raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        lows = np.zeros((len(raw) + 7) // 8 + 2, np.uint64)
        lows.view(np.uint8)[:len(raw)] = raw
        high = (values >> np.uint64(low)).astype(np.int64)
        size = n + ((bound - 1) >> low) + 1
        bits = np.zeros(-(-size // _BLOCK) * _BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = _pack(bits)
        counts = np.bitwise_count(highs[:-1]).astype(np.int64).reshape(-1, _BLOCK_WORDS).sum(1)
        ones = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return {"shape": np.array([n, low], np.int64), "lows": lows, "highs": highs, "ones": ones}

    def __len__(self) -> int:
        return self.n

    @property
    def nbytes(self) -> int:
        return self.lows.nbytes + self.highs.nbytes + self.ones.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = self.lows[word] >> shift
        # a shift by 64 is undefined, so the second word moves in two steps
        second = (self.lows[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (first | second) & np.uint64((1 << self.low) - 1)

    def _find_bit(self, rank: np.ndarray, directory: np.ndarray, ones: bool) -> np.ndarray:
        """Position in the high bits of the set (or clear) bit number ``rank``."""
        block = np.searchsorted(directory, rank, side="right") - 1
        rest = rank - directory[block]
        word = block * _BLOCK_WORDS
        last = len(self.highs) - 2
        for _ in range(_BLOCK_WORDS - 1):
            bits = self.highs[np.minimum(word, last)]
            count = np.bitwise_count(bits if ones else ~bits).astype(np.int64)
            on = rest >= count
            rest = np.where(on, rest - count, rest)
            if not on.any():
                break
            # a word that was left behind is not looked at again: its rest stays below the count
            word = np.where(on, word + 1, word)
        bits = self.highs[word]
        return word * 64 + _select_in_word(bits if ones else ~bits, rest)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at the indexes ``i`` (0 <= i < n)."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._find_bit(i, self.ones, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first value with each high part, and of the first one after these."""
        bit = np.zeros(len(high), np.int64)
        some = high > 0
        bit[some] = self._find_bit(high[some] - 1, self.zeros, False) + 1
        # the values with this high part are the set bits from here to the next clear one
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        bits = (self.highs[word] >> shift) | ((self.highs[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)
        start = bit - high
        after = start + run
        more = np.flatnonzero(run == 64)
        if len(more):
            after[more] = self._find_bit(high[more], self.zeros, False) - high[more]
        return start, after

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``search``, and whether the value there equals x."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        start, end = self._bucket(high)
        after = end.copy()
        want = x & np.uint64((1 << self.low) - 1)
        todo = np.flatnonzero(start < after)
        while len(todo):                                  # binary search among equal high parts
            middle = (start[todo] + after[todo]) >> 1
            less = self._low(middle) < want[todo]
            start[todo] = np.where(less, middle + 1, start[todo])
            after[todo] = np.where(less, after[todo], middle)
            todo = todo[start[todo] < after[todo]]
        same = start < end
        inside = np.flatnonzero(same)
        same[inside] = self._low(start[inside]) == want[inside]
        return start, same

    def search(self, x: np.ndarray) -> np.ndarray:
        """For each x (below the bound) the index of the first value >= x; n if none."""
        x = np.asarray(x).astype(np.uint64)
        return self._search(x)[0] if len(x) and self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x, or -1."""
        x = np.asarray(x).astype(np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), -1, np.int64)
        at, same = self._search(x)
        return np.where(same, at, -1)

    def values(self) -> np.ndarray:
        return self.select(np.arange(self.n))
