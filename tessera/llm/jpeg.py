"""Progressive JPEG: a lossless byte carrier, a decoder into coefficients, and full-resolution RGB tensors.

The carrier stores 64 bytes in the 64 coefficients of a block. A byte b over 127 is the AC coefficient b, another one is
b - 255: both have eight magnitude bits, which are b itself. As DC coefficient b is b - 128. Frames are 4:2:0. Each
component has a DC scan and two AC bands without their lowest bit, then a DC and an AC scan that refine it; the tables
hold the codes needed only, so that an AC coefficient of the first pass is one byte of the stream.

The decoder takes any progressive Huffman frame of 8-bit samples: scans accumulate in one coefficient array for each
component. Scans of one code, refinements of bands without zeros, and DC scans of one component are decoded as arrays;
others symbol by symbol.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes

#: Bytes of a payload come in multiples of this, three blocks.
UNIT, PAD = 192, 32
#: Bands of the first pass, as (first, last) in zigzag order.
BANDS = ((1, 5), (6, 63))


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: by antidiagonal, every other one from below."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, symbols: list[int], length: int) -> bytes:
    """A DHT of equally long codes."""
    return _segment(0xC4, bytes([kind << 4 | slot, *[len(symbols) if i == length else 0 for i in range(1, 17)], *symbols]))


def _scan(component: int, table: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, table, first, last, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]).tobytes()


def _sizes(v: np.ndarray) -> np.ndarray:
    """Magnitude bits of each value."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _dc_bits(diff: np.ndarray) -> np.ndarray:
    """Four bits of size, then that many of the difference."""
    size = _sizes(diff)
    code = (size << size) | (np.where(diff < 0, diff - 1, diff) & ((1 << size) - 1))
    width = 4 + size
    at = np.arange(15, -1, -1)
    return ((code[:, None] >> at) & 1).astype(np.uint8)[at[None, :] < width[:, None]]


def _runs(n: int) -> Iterator[int]:
    while n:
        yield (k := min(n, 32767))
        n -= k


def frame_shape(blocks: int) -> tuple[int, int]:
    """(width, height) in units of six blocks."""
    units = max(1, -(-blocks // 6))
    wide = min(units, max(64, -(-units // 4095)))
    return wide, -(-units // wide)


def encode(payload: bytes) -> bytes:
    """A frame of the payload, a positive multiple of 192 bytes; blocks that fill the frame up hold PAD."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    wide, tall = frame_shape(len(payload) // 64)
    units = wide * tall
    b = np.full(units * 384, PAD, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = b.reshape(-1, 64)
    out = [b"\xff\xd8", _segment(0xDB, bytes([0] + [1] * 64))]
    out.append(_segment(0xC2, bytes([8, *(16 * tall).to_bytes(2, "big"), *(16 * wide).to_bytes(2, "big"), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_table(0, 0, list(range(8)), 4), _table(1, 0, [7], 1), _table(1, 1, [r << 4 for r in range(15)], 4)]
    parts = [(1, b[: 4 * units]), (2, b[4 * units : 5 * units]), (3, b[5 * units :])]
    for c, x in parts:
        dc = (x[:, 0] >> 1).astype(np.int64) - 64
        out.append(_scan(c, 0, 0, 0, 0, 1, _packed(_dc_bits(np.diff(dc, prepend=0)))))
    for first, last in BANDS:
        for c, x in parts:
            out.append(_scan(c, 0, first, last, 0, 1, (x[:, first : last + 1] >> 1).tobytes()))
    for c, x in parts:
        out.append(_scan(c, 0, 0, 0, 1, 0, _packed(x[:, 0] & 1)))
    for c, x in parts:
        low = (x[:, 1:] ^ ((x[:, 1:] < 128))) & 1
        bits, at = [], 0
        for n in _runs(len(x)):
            size = n.bit_length() - 1
            head = f"{size:04b}" + (f"{n - (1 << size):0{size}b}" if size else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, low[at : at + n].ravel()]
            at += n
        out.append(_scan(c, 1, 1, 63, 1, 0, _packed(np.concatenate(bits))))
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Huffman:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.symbols, self.codes = symbols, {}
        self.size, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, i = 0, 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                self.codes[n, code] = symbols[i]
                at = code << (16 - n)
                self.size[at : at + (1 << (16 - n))], self.symbol[at : at + (1 << (16 - n))] = n, symbols[i]
                code, i = code + 1, i + 1
            code <<= 1
        self.only = next(iter(self.codes.items())) if len(self.codes) == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = int.from_bytes(data, "big"), len(data) * 8, len(data) * 8

    def take(self, n: int) -> int:
        if n > self.at:
            raise ValueError("a scan ends early")
        self.at -= n
        return (self.data >> self.at) & ((1 << n) - 1)

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such code")


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class Frame:
    """A decoded frame: ``components`` with ``coefficients`` (rows, columns, 64) in zigzag order."""

    def __init__(self, data: bytes):
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], _Huffman] = {}
        self.restart, self.size, self.components = 0, len(data), []
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                if not self.components:
                    raise ValueError("no frame")
                break
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                self._quants(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self._start(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman frame")
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _quants(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, slot = body[at] >> 4, body[at] & 15
            self.quants[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float32)
            at += 1 + 64 * (1 + wide)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            n = sum(body[at + 1 : at + 17])
            self.tables[body[at] >> 4, body[at] & 15] = _huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
            at += 17 + n

    def _start(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        if not (self.height and self.width and self.components and all(c.h and c.v for c in self.components)):
            raise ValueError("an empty frame")
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        if self.across * self.down * sum(c.h * c.v for c in self.components) > 8 * self.size:
            raise ValueError("fewer bits than blocks")
        for c in self.components:
            c.coefficients = np.zeros((self.down * c.v, self.across * c.h, 64), np.int16)
            c.rows, c.columns = -(-(-(-self.height * c.v // self.vmax)) // 8), -(-(-(-self.width * c.h // self.hmax)) // 8)

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        named = {c.ident: c for c in self.components}
        own = [(named[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        parts, start = [], at
        while True:
            at = data.index(b"\xff", at)
            if data[at + 1] == 0:
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                parts.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                start = at = at + 2
            else:
                parts.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                break
        if n == 1 and len(parts) == 1 and self._as_arrays(own[0], first, last, high, low, parts[0]):
            return at
        self._by_symbol(own, first, last, high, low, parts)
        return at

    def _as_arrays(self, own: tuple, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Decodes a scan of one component whose shape allows it."""
        c, dc, ac = own
        view = c.coefficients[: c.rows, : c.columns]
        blocks, band = c.rows * c.columns, last - first + 1
        if first == 0 and high:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=blocks)
            view[..., 0] |= (bits.astype(np.int16) << low).reshape(c.rows, c.columns)
            return True
        if first == 0:
            bits = np.unpackbits(np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8)).astype(np.int32)
            n = len(data) * 8
            window = np.zeros(n, np.int32)
            for i in range(16):
                window = window << 1 | bits[i : i + n]
            table = self.tables[0, dc]
            length, size = table.size[window].astype(np.int64), table.symbol[window].astype(np.int64)
            after, at, p = (np.arange(n) + length + size).tolist(), [], 0
            for _ in range(blocks):
                at.append(p)
                p = after[p]
            at = np.array(at)
            size, start = size[at], at + length[at]
            value = np.zeros(blocks, np.int64)
            for i in range(int(size.max(initial=0))):
                live = i < size
                value[live] = value[live] << 1 | bits[start[live] + i]
            value = np.where((size > 0) & (value < (1 << np.maximum(size, 1) - 1)), value - (1 << size) + 1, value)
            view[..., 0] = (np.cumsum(value) << low).reshape(c.rows, c.columns)
            return True
        table = self.tables[1, ac]
        if not high and table.only and table.only[1] >> 4 == 0 and table.only[1]:
            (length, _), size = table.only
            if size + length == 8:
                value = np.frombuffer(data, np.uint8, blocks * band).astype(np.int16) & ((1 << size) - 1)
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=blocks * band * (size + length)).reshape(-1, size + length)[:, length:]
                value = (bits @ (1 << np.arange(size - 1, -1, -1))).astype(np.int16)
            value -= (value < (1 << (size - 1))) * np.int16((1 << size) - 1)
            view[..., first : last + 1] = (value << low).reshape(c.rows, c.columns, band)
            return True
        flat = np.ascontiguousarray(view[..., first : last + 1]).reshape(blocks, band)
        if high and flat.all():
            bits, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
            change = np.zeros((blocks, band), np.int16)
            while done < blocks:
                head = np.r_[bits[at : at + 32], np.zeros(32, np.uint8)]
                window = int(np.packbits(head[:16]).view(">u2")[0])
                symbol, at = int(table.symbol[window]), at + int(table.size[window])
                if symbol & 15 or symbol == 0xF0:
                    return False
                run = 1 << (symbol >> 4)
                for _ in range(symbol >> 4):
                    run += int(bits[at]) << ((symbol >> 4) - 1 - _)
                    at += 1
                run = min(run, blocks - done)
                change[done : done + run] = bits[at : at + run * band].reshape(run, band)
                at, done = at + run * band, done + run
            view[..., first : last + 1] += (np.where(flat < 0, -change, change) << low).reshape(c.rows, c.columns, band)
            return True
        return False

    def _by_symbol(self, own: list, first: int, last: int, high: int, low: int, parts: list[bytes]) -> None:
        if len(own) == 1:
            c = own[0][0]
            units = [[(own[0], r, k)] for r in range(c.rows) for k in range(c.columns)]
        else:
            units = [[(o, m * o[0].v + r, x * o[0].h + k) for o in own for r in range(o[0].v) for k in range(o[0].h)] for m in range(self.down) for x in range(self.across)]
        step = self.restart or len(units)
        for i, data in zip(range(0, len(units), step), parts, strict=False):
            bits, before, state = _Bits(data), dict.fromkeys([c.ident for c, _, _ in own], 0), {"run": 0}
            for unit in units[i : i + step]:
                for (c, dc, ac), r, k in unit:
                    block = c.coefficients[r, k]
                    if first == 0 and high:
                        block[0] |= bits.take(1) << low
                    elif first == 0:
                        size = bits.symbol(self.tables[0, dc])
                        before[c.ident] += _extend(bits.take(size), size)
                        block[0] = before[c.ident] << low
                    elif not high:
                        self._first(bits, self.tables[1, ac], block, first, last, low, state)
                    else:
                        self._refine(bits, self.tables[1, ac], block, first, last, low, state)

    @staticmethod
    def _first(bits: _Bits, table: _Huffman, block: np.ndarray, first: int, last: int, low: int, state: dict) -> None:
        if state["run"]:
            state["run"] -= 1
            return
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                block[k] = _extend(bits.take(size), size) << low
            elif run == 15:
                k += 15
            else:
                state["run"] = (1 << run) + bits.take(run) - 1
                return
            k += 1

    @staticmethod
    def _refine(bits: _Bits, table: _Huffman, block: np.ndarray, first: int, last: int, low: int, state: dict) -> None:
        one, k = 1 << low, first

        def correct(k: int) -> None:
            if bits.take(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        while k <= last and not state["run"]:
            run, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif run < 15:
                state["run"] = (1 << run) + bits.take(run)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if size and k <= last:
                block[k] = value
            k += 1
        if state["run"]:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            state["run"] -= 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3) bytes; one component is repeated, chroma is replicated to full resolution."""
        planes = []
        for c in self.components:
            x = (c.coefficients.reshape(-1, 64) * self.quants[c.quant]) @ _inverse()
            x += 128.0
            np.clip(np.rint(x, out=x), 0, 255, out=x)
            rows, columns = c.coefficients.shape[:2]
            x = x.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
            up, along = self.vmax // c.v, self.hmax // c.h
            planes.append((np.repeat(np.repeat(x, up, 0), along, 1) if up * along > 1 else x)[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.uint8)
        if len(planes) == 1:
            out[:] = planes[0][..., None]
            return out
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        # The fixed factors of JFIF.
        for i, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[..., i] = np.clip(np.rint(x, out=x), 0, 255, out=x)
        return out


def decode(data: bytes) -> Frame | None:
    """The frame, or nothing where the bytes are no whole progressive Huffman frame."""
    try:
        return Frame(data)
    except (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError):
        return None


@functools.lru_cache(maxsize=64)
def _huffman(lengths: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(lengths, symbols)


@functools.lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples, as one matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.sqrt(np.where(k == 0, 1, 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.kron(c, c)[ZIGZAG].astype(np.float32)


def payload(frame: Frame) -> bytes:
    """The bytes that ``encode`` stored, with those that fill the frame."""
    out = []
    for c in frame.components:
        v = c.coefficients.reshape(-1, 64)
        b = np.where(v < 0, v + 255, v).astype(np.uint8)
        b[:, 0] = (v[:, 0] + 128).astype(np.uint8)
        out.append(b.tobytes())
    return b"".join(out)


def feature(rgb: np.ndarray) -> str:
    """Size, then sum, sum of squares and sum of steps along a row of each channel: whole numbers, so exact."""
    x = rgb.reshape(-1, 3)
    sums = x.sum(axis=0, dtype=np.int64)
    squares = [int((h := np.bincount(x[:, i], minlength=256)) @ np.arange(256) ** 2) for i in range(3)]
    step = lambda c: np.maximum(c[:, 1:], c[:, :-1]) - np.minimum(c[:, 1:], c[:, :-1])
    steps = [int(step(rgb[:, :, i]).sum(dtype=np.int64)) for i in range(3)]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ":".join(f"{a},{b},{c}" for a, b, c in zip(sums.tolist(), squares, steps, strict=True))


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's UTF-8, padded, as a progressive JPEG. Null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _fits(n: int | None, frame: Frame) -> bytes:
    return payload(frame)[: max(UNIT, -(-(n or 0) // UNIT) * UNIT)]


def from_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> (doc_id, payload binary, height, width, rgb binary): any progressive JPEG. Null media, and bytes
    that are no whole progressive frame (cut short, other kinds, more blocks than bits), give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, m in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                f = decode(m.as_py()) if m.is_valid else None
                rows.append((_fits(n, f), f.height, f.width, f.rgb().tobytes()) if f else (None,) * 4)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "payload", "height", "width", "rgb"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, payload binary, height int, width int, rgb binary")


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) as read back -> sizes, digests and a feature of the decoded pixels, all of them.

    The tensors are made as in ``from_media``, but only their feature leaves the task. Equal media have equal values; null media
    and bytes that are no whole progressive frame give nulls beside n_bytes and the digests of the bytes themselves.
    """
    names = ("payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string")

    def one(n: int | None, m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 6
        held, f = (len(m), hashlib.sha256(m).hexdigest()), decode(m)
        if f is None:
            return None, None, None, *held, None
        back = _fits(n, f)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *held, feature(f.rgb())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(n, m.as_py()) for n, m in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            cols = [pa.array([r[i] for r in rows], pa.int64() if n.endswith("long") else pa.string()) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_bytes", *[n.split()[0] for n in names]])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, {', '.join(names)}")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``to_media`` of each text, written to the shared folder and read back. Null and empty texts are a payload of 192 spaces."""
    return materialise(to_media(docs, id_col, text_col), "media")
