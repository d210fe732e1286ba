"""Progressive JPEG in numpy: scans gathered into coefficient arrays, and a store of bytes as coefficients.

``decode`` takes Huffman-coded progressive files (8 bits, one to four
components, any sampling, restart intervals): every scan, whether it brings a
band of frequencies or one more bit of precision, is added to the components'
coefficient arrays. ``to_rgb`` transforms them back, repeats chroma samples to
full resolution and converts to RGB.

``encode`` stores bytes losslessly as the quantised coefficients themselves, 64
to a block: byte b is the coefficient of category 8 whose value bits are b, that
is b from 128 and b - 255 below. Colours are sampled 4:2:0.
"""

from __future__ import annotations

import functools
import math
import struct
from dataclasses import dataclass, field

import numpy as np

# Zigzag order: diagonals in turn, alternately upwards and downwards.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
WIDTH_IN_UNITS = 64
LONGEST_RUN = (1 << 15) - 1


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks of the picture
    cols: int = 0
    coefficients: np.ndarray = field(default=None, repr=False)  # rows and columns of whole units, zigzag


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comments: list[bytes]


# Huffman tables ------------------------------------------------------------


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, code, length))
            code += 1
        at += n
        code <<= 1
    return out


@functools.lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: no code) and symbol for each 16 bits ahead."""
    lengths, found = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for symbol, code, length in _codes(counts, symbols):
        first = code << (16 - length)
        lengths[first : first + (1 << (16 - length))] = length
        found[first : first + (1 << (16 - length))] = symbol
    return lengths, found


# Reading bits --------------------------------------------------------------


class _Bits:
    """Bits of one stretch of entropy-coded bytes; past the end come ones."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.size = len(self.data) * 8
        self._all = None

    def ahead(self, at: int, n: int = 16) -> int:
        i = at >> 3
        word = int.from_bytes(self.data[i : i + 4].ljust(4, b"\xff"), "big")
        return (word >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def all(self) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._all

    def some(self, at: int, n: int) -> np.ndarray:
        """n single bits."""
        a = at >> 3
        part = np.frombuffer(self.data, np.uint8)[a : (at + n + 7) >> 3]
        found = np.unpackbits(part)[at & 7 : (at & 7) + n]
        if len(found) < n:
            raise ValueError("a scan ends too soon")
        return found

    def windows(self) -> np.ndarray:
        """The 16 bits ahead of every bit."""
        padded = np.frombuffer(self.data + b"\xff\xff\xff", np.uint8).astype(np.uint32)
        word = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
        return ((word[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).ravel().astype(np.uint16)


def _extend(bits, size):
    """Signed values of ``size`` value bits."""
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _no_code(length: int) -> int:
    if not length:
        raise ValueError("not a code of the Huffman table")
    return length


# Scans ---------------------------------------------------------------------


def _dc_first(bits: _Bits, flat: list[np.ndarray], units: np.ndarray, owner: list[int], tables: list, al: int) -> None:
    """Differences of DC values for the blocks ``units`` (unit, block); ``owner`` names each column's component."""
    windows = bits.windows()
    size_at, step = {}, []
    for i in set(owner):
        lengths, symbols = tables[i]
        length, size = lengths[windows], symbols[windows]
        after = np.where(length == 0, -1, np.arange(len(windows)) + length + size)
        size_at[i] = (length, size, after.tolist())
    step = [size_at[i][2] for i in owner]
    n_units, width = units.shape
    places, at = [], 0
    try:
        if all(s is step[0] for s in step):
            after = step[0]
            for _ in range(n_units * width):
                places.append(at)
                at = after[at]
        else:
            for _ in range(n_units):
                for after in step:
                    places.append(at)
                    at = after[at]
    except IndexError:
        raise ValueError("a scan ends too soon") from None
    where = np.array(places, np.int64).reshape(n_units, width)
    if where.size and (where < 0).any() or at < 0:
        raise ValueError("not a code of the Huffman table")
    for i in set(owner):
        columns = [k for k, o in enumerate(owner) if o == i]
        spots = where[:, columns].ravel()
        length, size, _ = size_at[i]
        s = size[spots].astype(np.int64)
        value_at = np.minimum(spots + length[spots], len(windows) - 1)
        value = windows[value_at].astype(np.int64) >> (16 - s)
        flat[i][units[:, columns].ravel(), 0] = np.cumsum(np.where(s == 0, 0, _extend(value, s))) << al


def _uniform(bits: _Bits, at: int, length: int, code: int, size: int, most: int) -> np.ndarray:
    """Value bits of the next symbols as long as all have this one code."""
    stride = length + size
    most = min(most, (bits.size - at) // stride)
    if stride == 8 and at % 8 == 0:
        found = np.frombuffer(bits.data, np.uint8)[at >> 3 : (at >> 3) + most]
        other = np.flatnonzero(found >> size != code)
        return (found[: other[0]] if len(other) else found) & ((1 << size) - 1)
    table = bits.all()[at : at + most * stride].reshape(most, stride)
    number = table @ (1 << np.arange(stride - 1, -1, -1))
    other = np.flatnonzero(number >> size != code)
    return (number[: other[0]] if len(other) else number) & ((1 << size) - 1)


def _ac_first(bits: _Bits, blocks: np.ndarray, order: np.ndarray, table, ss: int, se: int, al: int) -> None:
    """First bits of a band. Blocks whose symbols all share one code are read at once, others one by one."""
    lengths, symbols = table
    at, b, band, wait = 0, 0, se - ss + 1, 0
    while b < len(order):
        ahead = bits.ahead(at)
        length, symbol = _no_code(int(lengths[ahead])), int(symbols[ahead])
        if b >= wait and 0 < symbol < 16:
            found = _uniform(bits, at, length, ahead >> (16 - length), symbol, (len(order) - b) * band)
            whole = len(found) // band
            if whole:
                value = _extend(found[: whole * band].astype(np.int16), symbol) << al
                blocks[order[b : b + whole], ss : se + 1] = value.reshape(whole, band)
                at, b = at + whole * band * (length + symbol), b + whole
                continue
            wait = b + 8  # mixed: look again later
        k = ss
        while k <= se:
            ahead = bits.ahead(at)
            length, symbol = _no_code(int(lengths[ahead])), int(symbols[ahead])
            run, size = symbol >> 4, symbol & 15
            at += length
            if size:
                k += run
                if k > se:
                    raise ValueError("a run leaves its band")
                blocks[order[b], k] = int(_extend(bits.ahead(at, size), size)) << al
                at, k = at + size, k + 1
            elif run == 15:
                k += 16
            else:
                b += (1 << run) - 1 + (bits.ahead(at, run) if run else 0)
                at += run
                break
        b += 1


def _ac_refine(bits: _Bits, blocks: np.ndarray, order: np.ndarray, table, ss: int, se: int, al: int) -> None:
    """One more bit of a band. A run of blocks without new coefficients is corrected at once."""
    lengths, symbols = table
    at, b, one = 0, 0, 1 << al

    def correct(rows: np.ndarray, ks: np.ndarray) -> None:
        nonlocal at
        values = blocks[rows, ks]
        take = bits.some(at, len(values)).astype(bool)
        at += len(values)
        blocks[rows, ks] = np.where(take, values + np.sign(values) * one, values)

    while b < len(order):
        k = ss
        while k <= se:
            ahead = bits.ahead(at)
            length, symbol = _no_code(int(lengths[ahead])), int(symbols[ahead])
            run, size = symbol >> 4, symbol & 15
            at += length
            if not size and run < 15:
                blocks_in_run = (1 << run) + (bits.ahead(at, run) if run else 0)
                at += run
                own = order[b : b + blocks_in_run]
                seen = blocks[own, ss : se + 1] != 0
                seen[0, : k - ss] = False
                rows, ks = np.nonzero(seen)
                correct(own[rows], ks + ss)
                b += blocks_in_run - 1
                break
            new = 0
            if size:
                new, at = (one if bits.ahead(at, 1) else -one), at + 1
            row = blocks[order[b]]
            zeros = np.flatnonzero(row[k : se + 1] == 0)
            if run < len(zeros):
                end = k + int(zeros[run])
            elif new:
                raise ValueError("a run leaves its band")
            else:
                end = se
            ks = k + np.flatnonzero(row[k : end + 1])
            correct(np.full(len(ks), order[b]), ks)
            if new:
                blocks[order[b], end] = new
            k = end + 1
        b += 1


# Files ---------------------------------------------------------------------


def _frame(body: bytes) -> Picture:
    depth, height, width, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or not width or not height or not 1 <= n <= 4:
        raise ValueError("not an 8-bit picture of one to four components")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
        raise ValueError("sampling factors are 1 to 4")
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    for c in parts:
        c.cols, c.rows = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
        c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int16)
    return Picture(width, height, parts, {}, [])


@functools.lru_cache(maxsize=256)
def _units(shape: tuple[int, int], h: int, v: int) -> np.ndarray:
    """Flat block numbers (unit, block in unit) in interleaved order."""
    grid = np.arange(shape[0] * shape[1]).reshape(shape[0] // v, v, shape[1] // h, h)
    return grid.transpose(0, 2, 1, 3).reshape(-1, v * h)


def _scan(picture: Picture, header: bytes, pieces: list[bytes], huffman: dict, restart: int) -> None:
    n = header[0]
    chosen = [(header[1 + 2 * i], header[2 + 2 * i]) for i in range(n)]
    ss, se, (ah, al) = header[1 + 2 * n], header[2 + 2 * n], divmod(header[3 + 2 * n], 16)
    by_ident = {c.ident: c for c in picture.components}
    parts = [by_ident[i] for i, _ in chosen]
    flat = [c.coefficients.reshape(-1, 64) for c in parts]
    if n == 1:
        c = parts[0]
        grid = np.arange(len(flat[0])).reshape(c.coefficients.shape[:2])
        units = [np.ascontiguousarray(grid[: c.rows, : c.cols]).reshape(-1, 1)]
    else:
        units = [_units(c.coefficients.shape[:2], c.h, c.v) for c in parts]
    owner = [i for i, u in enumerate(units) for _ in range(u.shape[1])]
    together = np.hstack(units)
    step = restart or len(together)
    for i, piece in enumerate(pieces):
        own = together[i * step : (i + 1) * step]
        if not len(own):
            break
        bits = _Bits(piece)
        if ss == 0 and ah == 0:
            _dc_first(bits, flat, own, owner, [huffman[0, t >> 4] for _, t in chosen], al)
        elif ss == 0:
            found = bits.some(0, own.size).reshape(own.shape)
            for k, o in enumerate(owner):
                flat[o][own[:, k], 0] |= found[:, k].astype(np.int16) << al
        elif n != 1:
            raise ValueError("bands above the first come one component at a time")
        else:
            read = _ac_refine if ah else _ac_first
            read(bits, flat[0], own[:, 0], huffman[1, chosen[0][1] & 15], ss, se, al)


def decode(data: bytes) -> Picture:
    """All scans of a progressive JPEG, gathered. A damaged or other file is a ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, picture, huffman, tables, comments, restart = 2, None, {}, {}, [], 0
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    huffman[divmod(body[0], 16)] = _lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide, ident = divmod(body[0], 16)
                    n = 128 if wide else 64
                    tables[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[1 + n :]
            elif marker == 0xC2:
                picture = _frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman-coded picture")
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                comments.append(body)
            elif marker == 0xDA:
                pieces, begin = [], at
                while True:
                    at = data.index(b"\xff", at)
                    follows = data[at + 1]
                    if 0xD0 <= follows <= 0xD7:
                        pieces.append(data[begin:at])
                        at += 2
                        begin = at
                    elif follows:
                        break
                    else:
                        at += 2
                _scan(picture, body, [*pieces, data[begin:at]], huffman, restart)
    except (IndexError, KeyError, TypeError, AttributeError, struct.error) as wrong:
        raise ValueError(f"a damaged JPEG file: {wrong!r}") from wrong
    if picture is None:
        raise ValueError("no frame")
    picture.tables, picture.comments = tables, comments
    return picture


@functools.lru_cache(maxsize=8)
def _transform(table: bytes) -> np.ndarray:
    """Coefficients in zigzag order to samples, dequantised: one matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    wave = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    wave[:, 0] /= math.sqrt(2)
    matrix = np.einsum("xu,yv->uvxy", wave, wave).reshape(64, 64)[ZIGZAG]
    return matrix * np.frombuffer(table)[:, None]


def samples(picture: Picture, c: Component) -> np.ndarray:
    """A component's samples at its own resolution, whole units."""
    rows, cols, _ = c.coefficients.shape
    values = c.coefficients.reshape(-1, 64).astype(np.float64) @ _transform(picture.tables[c.table].tobytes())
    values = np.clip(np.rint(values) + 128, 0, 255).astype(np.int16)
    return values.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def to_rgb(picture: Picture) -> np.ndarray:
    """Height x width x 3 bytes; chroma samples are repeated to full resolution. One component is grey."""
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)

    def full(plane: np.ndarray, c: Component) -> np.ndarray:
        if h % c.h or v % c.v:
            i = np.arange(picture.height) * c.v // v
            j = np.arange(picture.width) * c.h // h
            return plane[i][:, j]
        plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1) if (h, v) != (c.h, c.v) else plane
        return plane[: picture.height, : picture.width]

    parts = picture.components
    y = full(samples(picture, parts[0]), parts[0])
    out = np.empty((picture.height, picture.width, 3), np.uint8)
    if len(parts) < 3:
        out[:] = y[:, :, None]
        return out
    cb, cr = (samples(picture, c).astype(np.int32) - 128 for c in parts[1:3])
    half = 1 << 15
    shift = [((91881 * cr + half) >> 16, parts[2]), None, ((116130 * cb + half) >> 16, parts[1])]
    if cb.shape == cr.shape:
        shift[1] = ((-22554 * cb - 46802 * cr + half) >> 16, parts[1])
        green = full(shift[1][0].astype(np.int16), parts[1])
    else:
        green = (-22554 * full(cb, parts[1]) - 46802 * full(cr, parts[2]) + half >> 16).astype(np.int16)
    for i, add in enumerate((full(shift[0][0].astype(np.int16), parts[2]), green, full(shift[2][0].astype(np.int16), parts[1]))):
        out[:, :, i] = np.clip(y + add, 0, 255)
    return out


# Storing bytes -------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Twelve sizes of DC difference with codes of 5 bits. In the AC table the one symbol of
# the first scans takes 1 bit and its 7 value bits a byte; a run of 2^n blocks and
# more takes 16 - n bits and its n value bits two bytes.
_DC = (bytes(4) + bytes([12]) + bytes(11), bytes(range(12)))
_AC = (bytes([1]) + bytes([1] * 15), bytes([7]) + bytes(n << 4 for n in range(14, -1, -1)))
_RUN_CODE = {symbol >> 4: code for symbol, code, _ in _codes(*_AC) if not symbol & 15}
_DC_CODE = np.array([code for _, code, _ in sorted(_codes(*_DC))], np.int64)
_CATEGORY = np.array([int(x).bit_length() for x in range(512)], np.int64)
_TABLES = b"".join(
    [
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC4, b"\x00" + _DC[0] + _DC[1]),
        _segment(0xC4, b"\x10" + _AC[0] + _AC[1]),
    ]
)
# (component, first and last frequency): the bands of the first scans.
_BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def _packed(bits: np.ndarray) -> bytes:
    """Bits filled up with ones, and 0 after each byte 255."""
    whole = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(whole).tobytes().replace(b"\xff", b"\xff\x00")


def _start(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    chosen = b"".join(bytes([c, 0]) for c in components)
    return _segment(0xDA, bytes([len(components)]) + chosen + bytes([ss, se, ah << 4 | al]))


def _dc_scan(first: list[np.ndarray]) -> bytes:
    """Differences of each component (unit, block), in unit order."""
    diffs = [np.diff(f.ravel(), prepend=0).reshape(f.shape) for f in first]
    diff = np.hstack(diffs).ravel()
    size = _CATEGORY[np.abs(diff)]
    number = (_DC_CODE[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 5
    place = length[:, None] - 1 - np.arange(16)
    bits = (number[:, None] >> np.maximum(place, 0)) & 1
    return _packed(bits[place >= 0].astype(np.uint8))


def _refining(blocks: np.ndarray) -> bytes:
    """Last bits of the magnitudes behind run symbols that say: no new coefficient."""
    out = []
    for a in range(0, len(blocks), LONGEST_RUN):
        part = blocks[a : a + LONGEST_RUN, 1:]
        n = len(part).bit_length() - 1
        head = _RUN_CODE[n] << n | (len(part) - (1 << n))
        out.append(np.unpackbits(np.frombuffer(head.to_bytes(2, "big"), np.uint8)))
        out.append(((part ^ (part < 128)) & 1).ravel())
    return _packed(np.concatenate(out))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are these bytes; a positive multiple of 64 of them."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-(len(payload) // 64) // 6)
    across = min(units, max(WIDTH_IN_UNITS, math.isqrt(units) + 1))
    down = -(-units // across)
    across = -(-units // down)
    units = across * down
    data = np.frombuffer(payload.ljust(units * 384, b"\0"), np.uint8).reshape(-1, 64)
    parts = {1: data[: 4 * units], 2: data[4 * units : 5 * units], 3: data[5 * units :]}
    dc = {}
    for ident, blocks in parts.items():
        value = blocks[:, 0].astype(np.int64)
        value = np.where(value < 128, value - 255, value)
        k = 2 if ident == 1 else 1
        dc[ident] = value[_units((down * k, across * k), k, k)]
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _TABLES,
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _start([1, 2, 3], 0, 0, 0, 1),
        _dc_scan([v >> 1 for v in dc.values()]),
    ]
    for ident, ss, se in _BANDS:
        out += [_start([ident], ss, se, 0, 1), (parts[ident][:, ss : se + 1] >> 1).tobytes()]
    out += [_start([1, 2, 3], 0, 0, 1, 0), _packed((np.hstack(list(dc.values())) & 1).ravel().astype(np.uint8))]
    for ident, blocks in parts.items():
        out += [_start([ident], 1, 63, 1, 0), _refining(blocks)]
    return b"".join([*out, b"\xff\xd9"])


def payload(picture: Picture) -> bytes:
    """The bytes that ``encode`` stored in these coefficients."""
    size = int(picture.comments[0].removeprefix(b"payload "))
    flat = np.concatenate([c.coefficients.ravel() for c in picture.components])[:size]
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()
