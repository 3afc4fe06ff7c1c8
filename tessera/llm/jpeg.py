"""Media columns: a progressive JPEG codec in numpy that works on many images at once.

``payload_jpegs`` stores bytes losslessly: 64 bytes are the 64 coefficients of one
8x8 block (a byte b is the coefficient 256 + b), dealt over a luma plane and two chroma
planes of half its size.  Each component has five scans: DC and its refinement, two
spectral bands of AC, and one AC refinement of their last bit.  A restart marker
follows every block, so blocks can be decoded side by side.

``Decoded`` reads such files, and any Huffman-coded progressive JPEG of 8-bit samples:
scans accumulate into coefficient arrays.  Restart intervals with the same scan
parameters and tables, of all images of a batch, are decoded in step: one numpy
operation advances each of them by a symbol.  Planes are inverse-transformed by an
integer basis (exact in double precision, so a result never depends on the batch),
chroma is upsampled and RGB tensors have full resolution.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: Blocks coded or decoded in one step, which bounds the arrays in use.
LANES = 16_384
BASE = 256
#: (first coefficient, last, bits known before, bits left out) of the scans that are written.
SCRIPT = ((0, 0, 0, 1), (0, 0, 1, 0), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0))


def zigzag() -> np.ndarray:
    """Row-major index of each coefficient in coding order."""
    cells = [(x + y, (x, y)[(x + y) % 2 == 0], 8 * y + x) for y in range(8) for x in range(8)]
    return np.array([c[2] for c in sorted(cells)])


ZIGZAG = zigzag()


def basis() -> np.ndarray:
    """From coefficients in coding order to row-major samples, times 4096, in whole numbers."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.round(np.kron(one, one).T[ZIGZAG] * 4096)


BASIS = basis()


# ---- writing ----


def huffman_segment(kind: int, first: int, others: list[int]) -> bytes:
    """A table in which ``first`` has the one-bit code and the others have eight bits."""
    counts = [1, 0, 0, 0, 0, 0, 0, len(others)] + [0] * 8
    return struct.pack(">BBHB", 0xFF, 0xC4, 19 + 1 + len(others), kind) + bytes(counts) + bytes([first, *others])


DC_TABLE = huffman_segment(0x00, 8, [s for s in range(12) if s != 8])
AC_TABLE = huffman_segment(0x10, 0x08, [0x00, 0xF0, *(r << 4 | s for r in range(8) for s in range(1, 10) if (r, s) != (0, 8))])
REFINE_TABLE = huffman_segment(0x11, 0x00, [0xF0, *(r << 4 | s for r in range(15) for s in (0, 1) if (r, s) != (0, 0))])


def plan(blocks: int) -> tuple[int, int]:
    """Width and height in units of 16 samples, near a square, that hold ``blocks`` blocks (six to a unit)."""
    units = max(1, -(-blocks // 6))
    width = max(1, int(np.ceil(np.sqrt(units))))
    height = -(-units // width)
    if width * 16 > 65535:
        raise ValueError("payload is beyond the format's largest image")
    return width, height


def header(width: int, height: int) -> bytes:
    quant = struct.pack(">BBHB", 0xFF, 0xDB, 67, 0) + b"\x01" * 64
    frame = struct.pack(">BBHBHHB", 0xFF, 0xC2, 17, 8, height * 16, width * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + quant + frame + DC_TABLE + AC_TABLE + REFINE_TABLE + b"\xff\xdd\x00\x04\x00\x01"


def scan_bytes(values: np.ndarray, scan: tuple[int, int, int, int]) -> np.ndarray:
    """Coded bytes of each block, before stuffing; values: bytes, a row for each block."""
    low, high, known, left = scan
    part = values[:, low : high + 1]
    n, width = part.shape
    if known:  # a bit for each coefficient, after the code of "no new coefficients" for AC
        bits = part & 1
        if low:
            bits = np.concatenate([np.zeros((n, 1), np.uint8), bits], 1)
    else:  # each coefficient: the one-bit code of size 8, then 8 bits of (256 + b) >> 1
        eight = np.unpackbits(((part >> 1) | 0x80)[:, :, None], axis=2)
        bits = np.concatenate([np.zeros((n, width, 1), np.uint8), eight], 2).reshape(n, 9 * width)
    fill = -bits.shape[1] % 8
    return np.packbits(np.concatenate([bits, np.ones((n, fill), np.uint8)], 1), axis=1)


def coded(values: np.ndarray, scan: tuple[int, int, int, int], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All blocks' coded bytes with stuffing and a restart marker after each, and each block's end."""
    parts, sizes = [], []
    for at in range(0, len(values), LANES):
        raw = scan_bytes(values[at : at + LANES], scan)
        n, width = raw.shape
        flat = raw.reshape(-1)
        full = flat == 0xFF
        each = full.reshape(n, width).sum(1) + width + 2
        where = np.arange(n * width) + np.cumsum(full) - full + 2 * np.repeat(np.arange(n), width)
        out = np.zeros(int(each.sum()), np.uint8)
        out[where] = flat
        ends = np.cumsum(each)
        out[ends - 2] = 0xFF
        out[ends - 1] = 0xD0 + number[at : at + LANES] % 8
        parts.append(out)
        sizes.append(each)
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def payload_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a positive multiple of 64."""
    plans = [plan(len(p) // BLOCK) for p in payloads]
    blocks = [6 * w * h for w, h in plans]
    filled = b"".join(p.ljust(BLOCK * n, b"\0") for p, n in zip(payloads, blocks, strict=True))
    values = np.frombuffer(filled, np.uint8).reshape(-1, BLOCK)
    sizes = [n for w, h in plans for n in (4 * w * h, w * h, w * h)]  # blocks of each component in turn
    bounds = np.cumsum([0, *sizes])
    number = np.arange(len(values)) - np.repeat(bounds[:-1], sizes)
    chunks: list[list[bytes]] = [[] for _ in range(len(sizes))]
    for scan in SCRIPT:
        data, ends = coded(values, scan, number)
        low, high, known, left = scan
        table = 0x01 if known and low else 0x00
        starts = np.concatenate([[0], ends])[bounds[:-1]]
        stops = ends[bounds[1:] - 1] - 2  # no marker after the last block
        for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            head = bytes([0xFF, 0xDA, 0, 8, 1, i % 3 + 1, table, low, high, known << 4 | left])
            chunks[i] += [head, data[a:b].tobytes()]
    return [header(w, h) + b"".join(chunks[3 * i] + chunks[3 * i + 1] + chunks[3 * i + 2]) + b"\xff\xd9" for i, (w, h) in enumerate(plans)]


# ---- reading ----


class Table:
    """Huffman codes by their next 16 bits: the code's length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k = 0, 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                low, high = code << (16 - bits), (code + 1) << (16 - bits)
                self.length[low:high], self.symbol[low:high] = bits, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


@dataclass
class Component:
    number: int
    across: int
    down: int
    quant: int
    wide: int = 0  # blocks of a row as stored, of whole units
    high: int = 0
    first: int = 0  # its first block in the batch's array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)


class Decoded:
    """Coefficients and samples of several files."""

    def __init__(self, files: list[bytes]):
        self.images: list[Image] = []
        self.tables: dict[bytes, Table] = {}
        self.jobs: list[dict] = []
        raw = np.frombuffer(b"".join(files) + b"\xff\xd9\0\0\0\0\0\0", np.uint8)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[full + 1]
        stuffed = full[after == 0] + 1
        is_restart = (after >= 0xD0) & (after <= 0xD7)
        self.restarts = full[is_restart]
        self.markers = full[~is_restart & (after != 0) & (after != 0xFF)].tolist()
        self.blocks = 0
        at = 0
        for file in files:
            self._read(file, at)
            at += len(file)
        # entropy-coded bytes without the stuffed ones; windows of 32 bits at each byte
        kept = np.ones(len(raw), bool)
        kept[stuffed] = False
        clean = raw[kept].astype(np.int64)
        clean = np.concatenate([clean, np.zeros(8, np.int64)])
        self.window = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
        self.stuffed = stuffed
        self.coefficients = np.zeros((self.blocks, BLOCK), np.int32)
        self._decode()
        del self.window, self.jobs

    def _read(self, file: bytes, base: int) -> None:
        image, tables, interval, at = Image(), {}, 0, 2
        if file[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while file[at + 1] != 0xD9:
            code, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
            body = file[at + 4 : at + 2 + size]
            at += 2 + size
            if code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif code == 0xC2:
                self._frame(image, body)
            elif code == 0xC4:
                while body:
                    n = sum(body[1:17])
                    key = body[1 : 17 + n]
                    if key not in self.tables:
                        self.tables[key] = Table(key[:16], key[16:])
                    tables[body[0]] = key
                    body = body[17 + n :]
            elif code == 0xDD:
                interval = int.from_bytes(body, "big")
            elif code == 0xDA:
                end = self.markers[bisect_left(self.markers, base + at)]
                self._scan(image, tables, interval, body, base + at, end)
                at = end - base
            elif 0xC0 <= code <= 0xCF:
                raise ValueError("only progressive Huffman-coded JPEG is read here")
        self.images.append(image)

    def _frame(self, image: Image, body: bytes) -> None:
        image.height, image.width = struct.unpack(">HH", body[1:5])
        image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        most_across, most_down = max(c.across for c in image.components), max(c.down for c in image.components)
        for c in image.components:
            c.wide = -(-image.width // (8 * most_across)) * c.across
            c.high = -(-image.height // (8 * most_down)) * c.down
            c.first = self.blocks
            self.blocks += c.wide * c.high

    def _scan(self, image: Image, tables: dict, interval: int, body: bytes, begin: int, end: int) -> None:
        own = [(next(c for c in image.components if c.number == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
        low, high, bits = body[-3:]
        if len(own) == 1:
            c = own[0][0]
            most_across, most_down = max(x.across for x in image.components), max(x.down for x in image.components)
            wide, tall = -(-image.width * c.across // (8 * most_across)), -(-image.height * c.down // (8 * most_down))
            order = (c.first + np.arange(tall)[:, None] * c.wide + np.arange(wide)[None, :]).reshape(-1, 1)
        else:
            units_wide, units_high = own[0][0].wide // own[0][0].across, own[0][0].high // own[0][0].down
            y, x = (g.reshape(-1) for g in np.mgrid[:units_high, :units_wide])
            order = np.stack([c.first + (y * c.down + v) * c.wide + x * c.across + h for c, _ in own for v in range(c.down) for h in range(c.across)], 1)
        of = tuple(i for i, (c, _) in enumerate(own) for _ in range(c.across * c.down if len(own) > 1 else 1))
        kinds = tuple(tables.get(t >> 4 if not low else 0x10 | t & 15, b"") for _, t in own)
        a, b = np.searchsorted(self.restarts, (begin, end))
        starts = np.concatenate([[begin], self.restarts[a:b] + 2])
        self.jobs.append({"key": (low, high, bits >> 4, bits & 15, kinds, of, interval or len(order)), "starts": starts, "order": order})

    def _decode(self) -> None:
        """Scans in file order by depth, so that refinements come after what they refine."""
        waves: dict[tuple, list[dict]] = defaultdict(list)
        for job in self.jobs:
            waves[job["key"]].append(job)
        for key in sorted(waves, key=lambda k: (-k[3], k[2] > 0, k[0])):
            low, high, known, left, kinds, of, interval = key
            lanes, orders = [], []
            for job in waves[key]:
                order = job["order"]
                fill = -len(order) % interval
                if fill:
                    order = np.concatenate([order, np.full((fill, order.shape[1]), -1)])
                orders.append(order.reshape(-1, interval * order.shape[1]))
                lanes.append(job["starts"][: len(orders[-1])])
            starts, order = np.concatenate(lanes), np.concatenate(orders)
            position = 8 * (starts - np.searchsorted(self.stuffed, starts))
            for at in range(0, len(starts), LANES):
                self._interval(position[at : at + LANES].copy(), order[at : at + LANES], low, high, known, left, [self.tables.get(k) for k in kinds], of)

    def _peek(self, position: np.ndarray, count) -> np.ndarray:
        """The next ``count`` bits, 32 at most, of each lane."""
        return self.window[position >> 3] >> (40 - (position & 7) - count) & ((1 << count) - 1)

    def _symbols(self, position: np.ndarray, table: Table) -> np.ndarray:
        next_bits = self._peek(position, 16)
        position += table.length[next_bits]
        return table.symbol[next_bits]

    def _signed(self, position: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        bits = self._peek(position, sizes)
        position += sizes
        return np.where((sizes > 0) & (bits < (1 << np.maximum(sizes, 1) - 1)), bits - (1 << sizes) + 1, bits)

    def _interval(self, position, order, low, high, known, left, tables, of) -> None:
        before = np.zeros((len(tables), len(position)), np.int64)
        run = np.zeros(len(position), np.int64)
        for j in range(order.shape[1]):
            at = np.flatnonzero(order[:, j] >= 0)
            blocks, own, c = order[at, j], position[at], of[j % len(of)]
            if low == 0 and not known:
                before[c][at] += self._signed(own, self._symbols(own, tables[c]))
                self.coefficients[blocks, 0] = before[c][at] << left
            elif low == 0:
                self.coefficients[blocks, 0] |= (self._peek(own, 1) << left).astype(np.int32)
                own += 1
            elif not known:
                run[at] = self._ac_first(own, blocks, run[at], low, high, left, tables[0])
            else:
                run[at] = self._ac_refine(own, blocks, run[at], low, high, left, tables[0])
            position[at] = own

    def _ac_first(self, position, blocks, run, low, high, left, table) -> np.ndarray:
        k = np.full(len(position), low)
        busy = np.flatnonzero(run == 0)
        run = np.maximum(run - 1, 0)
        while len(busy):
            own = position[busy]
            symbol = self._symbols(own, table)
            zeros, size = symbol >> 4, symbol & 15
            if size.all():
                k[busy] += zeros
                self.coefficients[blocks[busy], k[busy]] = self._signed(own, size) << left
                k[busy] += 1
            else:
                some, ends = size > 0, (size == 0) & (zeros < 15)
                k[busy] += np.where(ends, 0, zeros)
                value = self._signed(own, size)
                self.coefficients[blocks[busy[some]], k[busy[some]]] = value[some] << left
                k[busy] += 1
                more = np.where(ends, zeros, 0)
                run[busy] = np.where(ends, (1 << more) - 1 + self._peek(own, more), run[busy])
                own += more
                k[busy] = np.where(ends, BLOCK, k[busy])
            position[busy] = own
            busy = busy[k[busy] <= high]
        return run

    def _ac_refine(self, position, blocks, run, low, high, left, table) -> np.ndarray:
        """A step passes one coefficient; lanes whose band ends take all their correction bits at once."""
        bit = 1 << left
        k = np.full(len(position), low)
        skip, fresh = np.full(len(position), -1), np.zeros(len(position), np.int64)  # -1: a symbol is due
        ended = run > 0
        finish: list[np.ndarray] = [np.flatnonzero(ended)]
        run = np.maximum(run - 1, 0)
        busy = np.flatnonzero(~ended)
        while len(busy):
            due = busy[skip[busy] < 0]
            if len(due):
                own = position[due]
                symbol = self._symbols(own, table)
                zeros, size = symbol >> 4, symbol & 15
                ends = (size == 0) & (zeros < 15)
                more = np.where(ends, zeros, size)  # a new coefficient has its sign, an end its run's bits
                got = self._peek(own, more)
                own += more
                position[due] = own
                run[due] = np.where(ends, (1 << more) - 1 + got, run[due])
                fresh[due] = np.where(size > 0, np.where(got > 0, bit, -bit), 0)
                skip[due] = zeros
                if ends.any():
                    finish.append(due[ends])
                    busy = busy[~np.isin(busy, due[ends])]
                    if not len(busy):
                        break
            value = self.coefficients[blocks[busy], k[busy]]
            old = value != 0
            own = position[busy]
            got = self._peek(own, 1)
            position[busy] = own + old
            fixed = value + np.where(old & (got > 0) & (value & bit == 0), np.sign(value) * bit, 0)
            put = ~old & (skip[busy] == 0)
            self.coefficients[blocks[busy], k[busy]] = np.where(put, fresh[busy], fixed)
            skip[busy] -= ~old
            k[busy] += 1
            busy = busy[k[busy] <= high]
        lanes = np.concatenate(finish)
        if len(lanes):
            band = self.coefficients[blocks[lanes], low : high + 1]
            old = (band != 0) & (np.arange(low, high + 1)[None, :] >= k[lanes][:, None])
            nth = np.cumsum(old, 1)
            where = position[lanes][:, None] + nth - old
            got = self.window[where >> 3] >> (39 - (where & 7)) & 1
            self.coefficients[blocks[lanes], low : high + 1] = band + np.where(old & (got > 0) & (band & bit == 0), np.sign(band) * bit, 0)
            position[lanes] += nth[:, -1]
        return run

    def plane(self, c: Component, quant: np.ndarray) -> np.ndarray:
        """Samples of a component, rows by columns, as 8-bit values."""
        own = self.coefficients[c.first : c.first + c.wide * c.high]
        samples = np.floor(((own * quant) @ BASIS + 2048) / 4096) + 128
        return np.clip(samples, 0, 255).astype(np.uint8).reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)

    def rgb(self, i: int) -> np.ndarray:
        """The full-resolution tensor of image ``i``: height, width, 3."""
        image = self.images[i]
        most_across, most_down = max(c.across for c in image.components), max(c.down for c in image.components)
        planes = [self.plane(c, image.quants[c.quant]).repeat(most_down // c.down, 0).repeat(most_across // c.across, 1)[: image.height, : image.width] for c in image.components]
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        y, blue, red = (p.astype(np.int32) for p in planes)
        blue, red = blue - 128, red - 128
        # the conversion's factors times 65536, rounded
        parts = (91881 * red, -22554 * blue - 46802 * red, 116130 * blue)
        return np.clip(np.stack([y + (x + 32768 >> 16) for x in parts], 2), 0, 255).astype(np.uint8)

    def payload(self, i: int) -> bytes:
        """The bytes that ``payload_jpegs`` stored, with zeros up to whole units."""
        c = self.images[i].components
        own = self.coefficients[c[0].first : c[-1].first + c[-1].wide * c[-1].high]
        return (own - BASE).astype(np.uint8).tobytes()
