"""Progressive JPEG: exact round trips, and a plain scan writer for files of other makers."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from canopygrid.llm import jpeg, media


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 13, 64, 385, 1000])
def test_round_trip(blocks):
    for data in (os.urandom(64 * blocks), bytes(64 * blocks), b"\xff" * 64 * blocks, b"text " * 64 * blocks):
        data = data[: 64 * blocks]
        picture = jpeg.decode(jpeg.encode(data))
        assert jpeg.payload(picture) == data
        assert jpeg.to_rgb(picture).shape == (picture.height, picture.width, 3)


def test_long_runs_of_blocks(monkeypatch):
    monkeypatch.setattr(jpeg, "LONGEST_RUN", 5)
    data = os.urandom(64 * 100)
    assert jpeg.payload(jpeg.decode(jpeg.encode(data))) == data


class Writer:
    """Scans with one flat Huffman table of all 256 symbols, 9 bits each."""

    counts, symbols = bytes([0] * 8 + [255, 1] + [0] * 6), bytes(range(256))

    def __init__(self):
        self.codes = {s: (c, n) for s, c, n in jpeg._codes(self.counts, self.symbols)}
        self.bits = ""

    def put(self, value, n):
        if n:
            self.bits += format(value, f"0{n}b")

    def symbol(self, s):
        self.put(*self.codes[s])

    def number(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def done(self):
        bits, self.bits = self.bits + "1" * (-len(self.bits) % 8), ""
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    def dc(self, blocks, al):
        last = 0
        for b in blocks:
            v = int(b[0]) >> al
            self.symbol(abs(v - last).bit_length())
            self.number(v - last)
            last = v

    def first(self, blocks, ss, se, al, runs):
        waiting = 0

        def flush():
            nonlocal waiting
            if waiting:
                n = waiting.bit_length() - 1
                self.symbol(n << 4)
                self.put(waiting - (1 << n), n)
                waiting = 0

        for b in blocks:
            zeros, empty = 0, True
            values = [int(np.sign(v)) * (abs(int(v)) >> al) for v in b[ss : se + 1]]
            last = max((i for i, v in enumerate(values) if v), default=-1)
            for v in values[: last + 1]:
                empty = False
                if not v:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    self.symbol(0xF0)
                    zeros -= 16
                self.symbol(zeros << 4 | abs(v).bit_length())
                self.number(v)
                zeros = 0
            if last + 1 < len(values) or empty:
                waiting += 1
                if not runs:
                    flush()
        flush()

    def refine(self, blocks, ss, se, al):
        for b in blocks:
            now = [abs(int(v)) >> al for v in b[ss : se + 1]]
            last = max((i for i, v in enumerate(now) if v == 1), default=-1)
            k = zeros = 0
            marks = []
            while k <= last:
                if now[k] > 1:
                    marks.append(now[k] & 1)
                elif now[k] == 1:
                    self.symbol(zeros << 4 | 1)
                    self.put(int(b[ss + k] > 0), 1)
                    for m in marks:
                        self.put(m, 1)
                    marks, zeros = [], 0
                else:
                    zeros += 1
                    if zeros == 16:
                        self.symbol(0xF0)
                        for m in marks:
                            self.put(m, 1)
                        marks, zeros = [], 0
                k += 1
            rest = marks + [v & 1 for v in now[k:] if v > 1]
            if zeros or k < len(now):
                self.symbol(0)
                for m in rest:
                    self.put(m, 1)


def other_file(r, width, height, h, v, restart, runs, density):
    w = Writer()
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(r.randrange(1, 40) for _ in range(64)))]
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 7, h << 4 | v, 0, 8, 0x11, 0, 9, 0x11, 0])
    out.append(jpeg._segment(0xC2, frame))
    for kind in (0, 0x10):
        out.append(jpeg._segment(0xC4, bytes([kind]) + w.counts + w.symbols))
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))
    empty = jpeg._frame(frame)
    grids = []
    for c in empty.components:
        grid = np.zeros_like(c.coefficients)
        for i in range(c.rows):
            for j in range(c.cols):
                for k in range(64):
                    if k == 0 or r.random() < density:
                        grid[i, j, k] = r.randrange(-90, 90)
        grids.append(grid)

    def scan(head, number, write):
        out.append(head)
        step = restart or number
        for n, a in enumerate(range(0, number, step)):
            if n:
                out.append(bytes([0xFF, 0xD0 + (n - 1) % 8]))
            write(a, min(a + step, number))
            out.append(w.done())

    units = [jpeg._units(c.coefficients.shape[:2], c.h, c.v) for c in empty.components]

    def dc_first(a, b):
        last = [0, 0, 0]
        for u in range(a, b):
            for c, grid in enumerate(grids):
                for block in units[c][u]:
                    value = int(grid.reshape(-1, 64)[block, 0]) >> 1
                    w.symbol(abs(value - last[c]).bit_length())
                    w.number(value - last[c])
                    last[c] = value

    def dc_last(a, b):
        for u in range(a, b):
            for c, grid in enumerate(grids):
                for block in units[c][u]:
                    w.put(int(grid.reshape(-1, 64)[block, 0]) & 1, 1)

    scan(jpeg._start([7, 8, 9], 0, 0, 0, 1), len(units[0]), dc_first)
    for c, grid in zip(empty.components, grids):
        own = grid[: c.rows, : c.cols].reshape(-1, 64)
        scan(jpeg._start([c.ident], 1, 5, 0, 2), len(own), lambda a, b: w.first(own[a:b], 1, 5, 2, runs))
        scan(jpeg._start([c.ident], 6, 63, 0, 2), len(own), lambda a, b: w.first(own[a:b], 6, 63, 2, runs))
        scan(jpeg._start([c.ident], 1, 63, 2, 1), len(own), lambda a, b: w.refine(own[a:b], 1, 63, 1))
    scan(jpeg._start([7, 8, 9], 0, 0, 1, 0), len(units[0]), dc_last)
    for c, grid in zip(empty.components, grids):
        own = grid[: c.rows, : c.cols].reshape(-1, 64)
        scan(jpeg._start([c.ident], 1, 63, 1, 0), len(own), lambda a, b: w.refine(own[a:b], 1, 63, 0))
    return b"".join([*out, b"\xff\xd9"]), grids


@pytest.mark.parametrize("seed", range(12))
def test_scans_of_other_files(seed):
    r = random.Random(seed)
    h, v = r.choice([(1, 1), (2, 1), (2, 2), (1, 2)])
    data, grids = other_file(
        r, r.randrange(1, 70), r.randrange(1, 50), h, v, r.choice([0, 0, 3]), r.random() < 0.5, r.choice([0, 0.02, 0.2, 1])
    )
    picture = jpeg.decode(data)
    for c, grid in zip(picture.components, grids):
        assert (c.coefficients == grid).all()
    rgb = jpeg.to_rgb(picture)
    assert rgb.shape == (picture.height, picture.width, 3)
    # Inverse transform and colours by their formulas.
    zig = np.array(jpeg.ZIGZAG)
    planes = []
    for c, grid in zip(picture.components, grids):
        plane = np.zeros((grid.shape[0] * 8, grid.shape[1] * 8))
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5**0.5 if u == 0 else 1) / 2 for u in range(8)] for x in range(8)])
        for i in range(grid.shape[0]):
            for j in range(grid.shape[1]):
                square = np.zeros(64)
                square[zig] = grid[i, j] * picture.tables[0]
                plane[i * 8 : i * 8 + 8, j * 8 : j * 8 + 8] = basis @ square.reshape(8, 8) @ basis.T
        plane = np.clip(np.rint(plane) + 128, 0, 255)
        planes.append(plane.repeat(v // c.v, 0).repeat(h // c.h, 1)[: picture.height, : picture.width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    # A sample just at a half may round the other way, by 1 in luma and in chroma.
    off = np.abs(np.clip(want, 0, 255) - rgb)
    assert off.max() <= 3 and off.mean() <= 0.6


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"no picture", b"\xff\xd8\xff\xd9", jpeg.encode(bytes(64))[:-40]])
def test_damaged_files(data):
    with pytest.raises(ValueError):
        jpeg.to_rgb(jpeg.decode(data))


TEXTS = [None, "", "a", "x" * 63, "x" * 64, "é" * 32, "é" * 33, "\x00\xff ÿ", "long " * 40_000, "a"]


def test_digests(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, payload int")
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = jpeg.encode(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.endswith(f"{zlib.crc32(jpeg.to_rgb(jpeg.decode(stored)).tobytes()):08x}")
    assert got[2][1:] == got[9][1:] == got[None][1:]


def test_columns_in_the_way_and_bad_media(spark):
    rows = spark.createDataFrame([(1, b"no picture", 5), (2, None, 6), (3, jpeg.encode(bytes(128)), 7)], "k int, media binary, width int")
    got = {r.k: r for r in media.decode_media(rows).collect()}
    assert got[1].width is None and got[2].tensor is None
    assert got[3].payload == bytes(128) and len(got[3].tensor) == got[3].width * got[3].height * 3
    again = media.encode_media(media.decode_media(rows)).select("k", "media").collect()
    assert {r.k: r.media for r in again} == {1: None, 2: None, 3: rows.collect()[2].media}


def test_empty_table(spark):
    assert media.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
