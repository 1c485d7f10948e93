"""Words of many texts as arrays: bounds in one byte buffer, and 64-bit hashes.

No word becomes a Python object.  A word's hash is that of its bytes as a
polynomial, from prefix sums of byte values times powers of the inverse base.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once: bounds the power tables.
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Fixed random values of bytes, lower-casing A-Z.
_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    def __init__(self):
        self.up = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, BASE, np.uint64)), dtype=np.uint64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, _INVERSE, np.uint64)), dtype=np.uint64)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (uint64) of the words, A-Z in lower case, of all texts, and the number of words of each."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        inside = ~_SPACE[data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        start, end = edges[::2], edges[1::2]
        per_text = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes)))))
        return self._hashes(data, start, end), per_text

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            low = start[at]
            stop = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
            high = end[stop - 1]
            out[at:stop] = self._block(data[low:high], start[at:stop] - low, end[at:stop] - low)
            at = stop
        return out

    def _block(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self.up, self.down
        if n > BLOCK:  # one word longer than a block
            up = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)), dtype=np.uint64)
            down = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE, np.uint64)), dtype=np.uint64)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_LOWERED[data] * down[:n], out=prefix[1:])
        return mixed((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64))
