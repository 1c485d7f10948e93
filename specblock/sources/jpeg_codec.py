"""Quantised coefficients of JPEG files: Huffman decoding and encoding, no pixel touched.

Reads baseline, extended and progressive files with restart markers and any
sampling factors; writes baseline files, one scan a component, with Huffman
tables made for the image.  ITU-T T.81 is the source of all rules.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

from specblock.errors import CodecError, InvalidImageError, UnsupportedFormatError


def zigzag() -> np.ndarray:
    """Natural positions in zigzag order: diagonals in turn, even ones upwards."""
    cells = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * u + v for u, v in cells])


ZIGZAG = zigzag()
_ZZ = ZIGZAG.tolist()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    qt: int
    grid: np.ndarray | None = None
    blocks: tuple[int, int] = (0, 0)


@dataclass
class Jpeg:
    """A decoded file; grids are (rows, columns, 64) in natural order."""

    width: int = 0
    height: int = 0
    tables: dict[int, list[float]] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)


class _Bits:
    """Bits of one entropy-coded segment whose stuffing has been taken out."""

    __slots__ = ("data", "at", "acc", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def fill(self, need: int) -> None:
        while self.n < need:
            chunk = self.data[self.at : self.at + 6]
            self.at += 6
            if len(chunk) < 6:
                if self.at - 6 > len(self.data) + 64:
                    raise CodecError("the scan ends too early")
                chunk = chunk + b"\0" * (6 - len(chunk))
            self.acc = ((self.acc & ((1 << self.n) - 1)) << 48) | int.from_bytes(chunk, "big")
            self.n += 48

    def get(self, count: int) -> int:
        if not count:
            return 0
        if self.n < count:
            self.fill(count)
        self.n -= count
        return (self.acc >> self.n) & ((1 << count) - 1)

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.n < 16:
            self.fill(16)
        code = (self.acc >> (self.n - 16)) & 0xFFFF
        length = table[1][code]
        if not length:
            raise CodecError("an unknown Huffman code")
        self.n -= length
        return table[0][code]

    def extended(self, size: int) -> int:
        if not size:
            return 0
        value = self.get(size)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _lookup(lengths: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For every 16 bits ahead: the symbol and the length of its code."""
    value, size, code, at = [0] * 65536, [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            start, n = code << (16 - length), 1 << (16 - length)
            value[start : start + n] = [symbols[at]] * n
            size[start : start + n] = [length] * n
            code += 1
            at += 1
        code <<= 1
    return value[:65536], size[:65536]


def parse(data: bytes, headers_only: bool = False) -> Jpeg:
    """The coefficients of a file, or its headers alone."""
    if data[:2] != b"\xff\xd8":
        raise InvalidImageError("no JPEG: it does not start with FF D8")
    jpeg, at, huffman, restart, progressive = Jpeg(), 2, {}, 0, False
    while True:
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            break
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            break
        if marker in (0x01, 0x00) or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            raise InvalidImageError("the file ends within a segment")
        size = struct.unpack(">H", data[at : at + 2])[0]
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            _quant_tables(body, jpeg.tables)
        elif marker == 0xC4:
            _huffman_tables(body, huffman)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            _frame(body, jpeg)
            if headers_only:
                continue
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise UnsupportedFormatError("lossless, hierarchical and arithmetic JPEG files are not handled")
        elif marker == 0xDA:
            if not jpeg.components:
                raise InvalidImageError("a scan without a frame")
            if headers_only:
                break
            at = _scan(data, at, body, jpeg, huffman, restart, progressive)
    if not jpeg.components:
        raise InvalidImageError("no frame found")
    if not headers_only:
        for c in jpeg.components:
            rows, cols = c.blocks
            c.grid = c.grid[:rows, :cols]
    jpeg.components = jpeg.components[:3]
    return jpeg


def _quant_tables(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        wide, ident = body[at] >> 4, body[at] & 15
        values = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1)
        table = np.empty(64, np.float32)
        table[ZIGZAG] = values
        tables[ident] = table.tolist()
        at += 1 + 64 * (1 + bool(wide))


def _huffman_tables(body: bytes, huffman: dict) -> None:
    at = 0
    while at < len(body):
        lengths = body[at + 1 : at + 17]
        n = sum(lengths)
        huffman[body[at]] = _lookup(lengths, body[at + 17 : at + 17 + n])
        at += 17 + n


def _frame(body: bytes, jpeg: Jpeg) -> None:
    precision, height, width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8:
        raise UnsupportedFormatError("only 8-bit samples are handled")
    if not height or not width:
        raise UnsupportedFormatError("a height that follows the first scan is not handled")
    jpeg.width, jpeg.height = width, height
    jpeg.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    top_h, top_v = max(c.h for c in jpeg.components), max(c.v for c in jpeg.components)
    for c in jpeg.components:
        up = lambda size, own, top: -(-size * own // (8 * top))
        c.blocks = (up(height, c.v, top_v), up(width, c.h, top_h))
        c.grid = np.zeros((-(-height // (8 * top_v)) * c.v, -(-width // (8 * top_h)) * c.h, 64), np.int16)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the scan at a position, and where it ends."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[start:])
            return [p.replace(b"\xff\x00", b"\xff") for p in parts], len(data)
        after = data[at + 1]
        if after == 0x00:
            at += 2
        elif 0xD0 <= after <= 0xD7:
            parts.append(data[start:at])
            at += 2
            start = at
        elif after == 0xFF:
            at += 1
        else:
            parts.append(data[start:at])
            return [p.replace(b"\xff\x00", b"\xff") for p in parts], at


def _scan(data: bytes, at: int, body: bytes, jpeg: Jpeg, huffman: dict, restart: int, progressive: bool) -> int:
    n = body[0]
    chosen = []
    for i in range(n):
        ident, tables = body[1 + 2 * i], body[2 + 2 * i]
        component = next((c for c in jpeg.components if c.ident == ident), None)
        if component is None:
            raise CodecError("a scan of an unknown component")
        chosen.append((component, tables >> 4, tables & 15))
    first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
    high, low = approx >> 4, approx & 15
    segments, end = _segments(data, at)
    if n == 1:
        component = chosen[0][0]
        units = [[(0, r, c)] for r in range(component.blocks[0]) for c in range(component.blocks[1])]
    else:
        rows, cols = jpeg.components[0].grid.shape[0] // jpeg.components[0].v, jpeg.components[0].grid.shape[1] // jpeg.components[0].h
        inner = [(i, r, c) for i, (comp, _, _) in enumerate(chosen) for r in range(comp.v) for c in range(comp.h)]
        units = [[(i, y * chosen[i][0].v + r, x * chosen[i][0].h + c) for i, r, c in inner] for y in range(rows) for x in range(cols)]
    step = restart or len(units)
    for part, start in zip(segments, range(0, len(units), step), strict=False):
        bits, dc, run = _Bits(part), [0] * n, [0]
        for unit in units[start : start + step]:
            for i, r, c in unit:
                component, dc_at, ac_at = chosen[i]
                block = component.grid[r, c]
                if not progressive:
                    dc[i] = _sequential(bits, block, huffman[dc_at], huffman[16 | ac_at], dc[i])
                elif first == 0:
                    if high == 0:
                        size = bits.symbol(huffman[dc_at])
                        dc[i] += bits.extended(size)
                        block[0] = dc[i] << low
                    elif bits.get(1):
                        block[0] |= 1 << low
                elif high == 0:
                    _first_ac(bits, block, huffman[16 | ac_at], first, last, low, run)
                else:
                    _refine_ac(bits, block, huffman[16 | ac_at], first, last, low, run)
    return end


def _sequential(bits: _Bits, block: np.ndarray, dc_table, ac_table, dc: int) -> int:
    dc += bits.extended(bits.symbol(dc_table))
    block[0] = dc
    k = 1
    while k < 64:
        s = bits.symbol(ac_table)
        size = s & 15
        if not size:
            if s != 0xF0:
                break
            k += 16
            continue
        k += s >> 4
        if k > 63:
            raise CodecError("a coefficient beyond the block")
        block[_ZZ[k]] = bits.extended(size)
        k += 1
    return dc


def _first_ac(bits: _Bits, block, table, first: int, last: int, low: int, run: list[int]) -> None:
    if run[0]:
        run[0] -= 1
        return
    k = first
    while k <= last:
        s = bits.symbol(table)
        zeros, size = s >> 4, s & 15
        if size:
            k += zeros
            if k > 63:
                raise CodecError("a coefficient beyond the block")
            block[_ZZ[k]] = bits.extended(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            run[0] = (1 << zeros) - 1 + bits.get(zeros)
            return


def _refine_ac(bits: _Bits, block, table, first: int, last: int, low: int, run: list[int]) -> None:
    bit, k = 1 << low, first

    def correct(at: int) -> None:
        if bits.get(1) and not abs(int(block[at])) & bit:
            block[at] += bit if block[at] > 0 else -bit

    if not run[0]:
        while k <= last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            value = 0
            if size:
                value = bit if bits.get(1) else -bit
            elif zeros < 15:
                run[0] = (1 << zeros) + bits.get(zeros)
                break
            while k <= last:
                at = _ZZ[k]
                if block[at]:
                    correct(at)
                elif zeros:
                    zeros -= 1
                else:
                    if value:
                        block[at] = value
                    k += 1
                    break
                k += 1
    if run[0]:
        while k <= last:
            at = _ZZ[k]
            if block[at]:
                correct(at)
            k += 1
        run[0] -= 1


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits, with the all-ones code left free."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heap.append((0, -1, [-1]))
    heapq.heapify(heap)
    length = dict.fromkeys([*counts, -1], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]) + 1000, a[2] + b[2]))
    by_length = [0] * (max(max(length.values()), 16) + 1)
    for n in length.values():
        by_length[n] += 1
    for i in range(len(by_length) - 1, 16, -1):
        while by_length[i]:
            j = i - 2
            while not by_length[j]:
                j -= 1
            by_length[i] -= 2
            by_length[i - 1] += 1
            by_length[j + 1] += 2
            by_length[j] -= 1
    longest = max(i for i, n in enumerate(by_length) if n)
    by_length[longest] -= 1
    order = sorted(counts, key=lambda s: (-counts[s], s))
    out, at = {}, 0
    for n, many in enumerate(by_length):
        for s in order[at : at + many]:
            out[s] = n
        at += many
    return out


def _table(counts: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body without its id, and code and length of each symbol."""
    lengths = _code_lengths(counts or {0: 1})
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17)) + bytes(order), codes


def _symbols(grid: np.ndarray) -> tuple[list[tuple[int, int, int]], dict, dict]:
    """(symbol, extra bits, their number) of all blocks in order; DC symbols are marked by 256."""
    flat = grid.reshape(-1, 64)[:, ZIGZAG].astype(int)
    out, dc_counts, ac_counts, before = [], {}, {}, 0

    def coded(value: int) -> tuple[int, int]:
        size = abs(value).bit_length()
        return size, value if value >= 0 else value + (1 << size) - 1

    for row in flat:
        size, extra = coded(int(row[0]) - before)
        before = int(row[0])
        if size > 11:
            raise CodecError("a DC step beyond baseline range")
        out.append((256 | size, extra, size))
        dc_counts[size] = dc_counts.get(size, 0) + 1
        last = 0
        for k in np.flatnonzero(row[1:]).tolist():
            zeros = k - last
            last = k + 1
            while zeros > 15:
                out.append((0xF0, 0, 0))
                ac_counts[0xF0] = ac_counts.get(0xF0, 0) + 1
                zeros -= 16
            size, extra = coded(int(row[k + 1]))
            if size > 10:
                raise CodecError("an AC coefficient beyond baseline range")
            s = zeros << 4 | size
            out.append((s, extra, size))
            ac_counts[s] = ac_counts.get(s, 0) + 1
        if last < 63:
            out.append((0, 0, 0))
            ac_counts[0] = ac_counts.get(0, 0) + 1
    return out, dc_counts, ac_counts


def encode(width: int, height: int, tables: list[list[float]], components: list[tuple[int, int, int, np.ndarray]]) -> bytes:
    """A baseline file of components (h, v, table number, grid)."""
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8"]
    if len(components) == 3 or len(components) == 1:
        out.append(segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"))
    for i, table in enumerate(tables[:4]):
        values = np.asarray(table)[ZIGZAG]
        wide = values.max() > 255
        out.append(segment(0xDB, bytes([bool(wide) << 4 | i]) + values.astype(">u2" if wide else "u1").tobytes()))
    frame = struct.pack(">BHHB", 8, height, width, len(components))
    frame += b"".join(bytes([i + 1, h << 4 | v, qt]) for i, (h, v, qt, _) in enumerate(components))
    out.append(segment(0xC0, frame))
    for i, (_, _, _, grid) in enumerate(components):
        symbols, dc_counts, ac_counts = _symbols(grid)
        dc_body, dc_codes = _table(dc_counts)
        ac_body, ac_codes = _table(ac_counts)
        out += [segment(0xC4, b"\x00" + dc_body), segment(0xC4, b"\x10" + ac_body), segment(0xDA, bytes([1, i + 1, 0, 0, 63, 0]))]
        text = []
        for s, extra, size in symbols:
            code, n = dc_codes[s & 255] if s & 256 else ac_codes[s]
            text.append(format(code, f"0{n}b"))
            if size:
                text.append(format(extra, f"0{size}b"))
        bits = "".join(text)
        bits += "1" * (-len(bits) % 8)
        raw = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
        out.append(raw.replace(b"\xff", b"\xff\x00"))
    return b"".join([*out, b"\xff\xd9"])
