"""Elias-Fano coding of monotone sequences, read in place from bytes.

Of n values below a universe, the low bits are packed side by side and the
high bits are stored in unary, about 2 + log2(universe / n) bits a value.
Reading a value is one select; the successor of x is found through the two
selects that bound the values with its high bits.  All reads are vectorised.
"""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> dict[str, np.ndarray | int]:
    """Parts of the code of a nondecreasing sequence of non-negative values."""
    values = values.astype(np.int64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.empty((n, low_bits), np.uint8)
    for b in range(low_bits):
        bits[:, b] = (values >> b) & 1
    low = np.packbits(bits.reshape(-1), bitorder="little")
    high = values >> low_bits
    length = n + (top >> low_bits) + 1
    unary = np.zeros(-(-length // 64) * 64, np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.uint32)
    return {"n": n, "low_bits": low_bits, "low": np.concatenate((low, np.zeros(8, np.uint8))), "words": words, "ranks": ranks}


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The place of the r-th set bit of each byte.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    _IN_BYTE[_byte, : len(_set)] = _set
_IN_BYTE = _IN_BYTE.reshape(-1)


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit of each word."""
    r = r.astype(np.uint64)
    n = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    # Byte k of sums counts the bits of bytes 0 to k.
    sums = ((n + (n >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
    shift = np.bitwise_count(((r * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) * np.uint64(8)
    before = (sums << np.uint64(8)) >> shift & np.uint64(0xFF)
    byte = word >> shift & np.uint64(0xFF)
    return shift.view(np.int64) + _IN_BYTE[(byte * np.uint64(8) + r - before).view(np.int64)]


class Sequence:
    """Reads a code from its parts, which may be memory-mapped."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.words = n, low_bits, words
        # Eight bytes from any byte on: low bits are read where they lie.
        self.low = np.ndarray(max(0, len(low) - 7), "<u8", low.data if low.flags.c_contiguous else low.tobytes(), strides=(1,))
        # The directory (a bit for two of the code) is widened once, not at every search.
        self.ranks = ranks.astype(np.int64)
        self.zeros = np.arange(len(ranks), dtype=np.int64) * 64 - self.ranks

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        ranks = self.ranks if ones else self.zeros
        word = np.searchsorted(ranks, i, "right") - 1
        word = np.minimum(word, len(self.words) - 1)
        value = self.words[word] if ones else ~self.words[word]
        return word * 64 + _in_word(value, i - ranks[word])

    def _next(self, place: np.ndarray, i: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the i-th set (or clear) bit, the next one after place."""
        word = place >> 6
        value = self.words[word] if ones else ~self.words[word]
        rest = value & (np.uint64(0xFFFFFFFFFFFFFFFE) << (place & 63).astype(np.uint64))
        out = (word << 6) + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        beyond = np.flatnonzero(rest == 0)
        if len(beyond):
            out[beyond] = self._select(i[beyond], ones)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        raw = self.low[bit >> 3]
        return ((raw >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.low_bits) | self._lows(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        place = self._select(i, True)
        after = self._next(place, i + 1, True)
        return ((place - i) << self.low_bits) | self._lows(i), ((after - i - 1) << self.low_bits) | self._lows(i + 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value >= x (n if there is none), and whether it equals x."""
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        last = int(self.zeros[-1]) - 1
        far = high > last
        high = np.minimum(high, last)
        place = np.full(len(x), -1)
        later = np.flatnonzero(high > 0)
        place[later] = self._select(high[later] - 1, False)
        start = place - high + 1
        stop = np.where(high > 0, self._next(np.maximum(place, 0), high, False), 0)
        first = np.flatnonzero(high == 0)
        if len(first):
            stop[first] = self._select(high[first], False)
        stop = np.minimum(stop - high, self.n)
        end = stop.copy()
        # Many values that share their high bits lie evenly, as hashed words do: look near the likely place first.
        many = np.flatnonzero(end - start > 64)
        if len(many):
            size = end[many] - start[many]
            likely, reach = start[many] + (low[many] * size >> self.low_bits), 2 * np.sqrt(size).astype(np.int64)
            left, right = np.maximum(likely - reach, start[many]), np.minimum(likely + reach, end[many] - 1)
            low_left, low_right = self._lows(left) < low[many], self._lows(right) >= low[many]
            start[many] = np.where(low_left, left + 1, start[many])
            end[many] = np.where(low_right, right, end[many])
            start[many] = np.where(low_right, start[many], right + 1)
            end[many] = np.where(low_left, end[many], left)
        while len(open_ := np.flatnonzero(start < end)):
            mid = (start[open_] + end[open_]) >> 1
            less = self._lows(mid) < low[open_]
            start[open_] = np.where(less, mid + 1, start[open_])
            end[open_] = np.where(less, end[open_], mid)
        # Within the values that share x's high bits, equal low bits are equality.
        same = np.zeros(len(x), bool)
        near = np.flatnonzero((start < stop) & ~far)
        same[near] = self._lows(start[near]) == low[near]
        return np.where(far, self.n, start), same
