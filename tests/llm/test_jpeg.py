import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import jpeg


def texts():
    rng = random.Random(6)
    return [b"", b"a", "é日😀".encode() * 30, bytes(rng.randrange(256) for _ in range(4000)), b"word " * 9000, b"\x00" * 192, b"\xff" * 400]


def test_round_trip():
    for t in texts():
        p = jpeg.padded(t)
        m = jpeg.encode(p)
        f = jpeg.Frame(m)
        assert jpeg.payload(f)[: len(p)] == p and len(p) % 192 == 0 and p.rstrip(b" ") == t.rstrip(b" ")
        assert f.rgb().shape == (f.height, f.width, 3)
        assert m == jpeg.encode(p)
    with pytest.raises(ValueError):
        jpeg.encode(b"abc")


def test_arrays_and_symbols_agree(monkeypatch):
    for t in texts()[:4]:
        m = jpeg.encode(jpeg.padded(t))
        fast = [c.coefficients for c in jpeg.Frame(m).components]
        with monkeypatch.context() as x:
            x.setattr(jpeg.Frame, "_as_arrays", lambda *a: False)
            slow = [c.coefficients for c in jpeg.Frame(m).components]
        assert all((a == b).all() for a, b in zip(fast, slow))


class Writer:
    """Plain progressive scans with codes of 8 bits, one symbol each."""

    def __init__(self):
        self.bits = ""

    def symbol(self, s, table):
        self.bits += f"{table.index(s):08b}"

    def value(self, v, n):
        if n:
            self.bits += f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    def data(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        out = int(b, 2).to_bytes(len(b) // 8, "big") if b else b""
        return out.replace(b"\xff", b"\xff\x00")


def shifted(v, low):
    return int(math.copysign(abs(int(v)) >> low, v))


def sparse_frame(coefs, symbols):
    """coefs: Y (2, 4, 64), Cb and Cr (1, 2, 64) of a 4:2:0 frame of 27 x 13 samples; restarts in the DC scan."""
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [2] * 64)), jpeg._segment(0xC2, bytes([8, 0, 13, 0, 27, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    out += [jpeg._table(0, 0, list(range(12)), 8), jpeg._table(1, 0, symbols, 8), jpeg._segment(0xDD, b"\x00\x01")]
    parts = []
    for m in range(2):
        w = Writer()
        last = [0, 0, 0]
        for i, cells in enumerate(([(r, 2 * m + k) for r in range(2) for k in range(2)], [(0, m)], [(0, m)])):
            for r, k in cells:
                v = int(coefs[i][r, k, 0]) >> 1
                d, last[i] = v - last[i], v
                w.symbol(abs(d).bit_length(), list(range(12)))
                w.value(d, abs(d).bit_length())
        parts.append(w.data())
    out.append(jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])) + parts[0] + b"\xff\xd0" + parts[1])
    out.append(jpeg._segment(0xDD, b"\x00\x00"))
    for i, c in enumerate(coefs):
        w, eob = Writer(), 0
        cells = [c[r, k] for r in range(c.shape[0]) for k in range(c.shape[1])]

        def flush():
            nonlocal eob
            if eob:
                n = eob.bit_length() - 1
                w.symbol(n << 4, symbols)
                if n:
                    w.bits += f"{eob - (1 << n):0{n}b}"
                eob = 0

        for b in cells:
            run = 0
            for k in range(1, 64):
                v = shifted(b[k], 1)
                if not v:
                    run += 1
                    continue
                flush()
                while run > 15:
                    w.symbol(0xF0, symbols)
                    run -= 16
                n = abs(v).bit_length()
                w.symbol(run << 4 | n, symbols)
                w.value(v, n)
                run = 0
            if run:
                eob += 1
        flush()
        out.append(jpeg._segment(0xDA, bytes([1, i + 1, 0, 1, 63, 1])) + w.data())
    w = Writer()
    w.bits = "".join(str(int(coefs[0][r, k, 0]) & 1) for r in range(2) for k in range(4))
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0x10])) + w.data())
    # Refinement of Y: no runs of ended blocks, one by one.
    w = Writer()
    for b in coefs[0].reshape(-1, 64):
        fresh = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        k = 1
        while k <= 63:
            rest = [f for f in fresh if f >= k]
            if not rest:
                w.symbol(0, symbols)
                w.bits += "".join(str(abs(int(b[j])) & 1) for j in range(k, 64) if abs(int(b[j])) > 1)
                break
            run, corrections, j = 0, "", k
            while j < rest[0] and run < 16:
                if abs(int(b[j])) > 1:
                    corrections += str(abs(int(b[j])) & 1)
                else:
                    run += 1
                    if run == 16:
                        break
                j += 1
            if run == 16:
                w.symbol(0xF0, symbols)
                w.bits += corrections
                k = j + 1
                continue
            w.symbol(run << 4 | 1, symbols)
            w.bits += "1" if b[rest[0]] > 0 else "0"
            w.bits += corrections
            k = rest[0] + 1
    out.append(jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + w.data())
    return b"".join([*out, b"\xff\xd9"])


def test_sparse_scans_accumulate():
    symbols = [r << 4 | s for r in range(16) for s in range(8) if (r, s) != (15, 7)]
    for seed in range(12):
        rng = np.random.default_rng(seed)
        coefs = []
        for shape in ((2, 4, 64), (1, 2, 64), (1, 2, 64)):
            c = rng.integers(-9, 10, shape) * (rng.random(shape) < rng.choice([0.02, 0.2, 0.7]))
            c[..., 0] = rng.integers(-300, 300, shape[:2])
            coefs.append(c)
        f = jpeg.Frame(sparse_frame(coefs, symbols))
        assert (f.components[0].coefficients == coefs[0]).all()
        for i in (1, 2):
            want = np.where(coefs[i] < 0, -(-coefs[i] >> 1), coefs[i] >> 1) << 1
            want[..., 0] = coefs[i][..., 0] >> 1 << 1
            assert (f.components[i].coefficients == want).all()
        rgb = f.rgb()
        assert rgb.shape == (13, 27, 3)
        y, x = 9, 21
        sample = []
        for c, (r, k, sy, sx) in zip(f.components, ((1, 2, 1, 5), (0, 1, 4, 2), (0, 1, 4, 2))):
            total = 128.0
            for z, n in enumerate(jpeg.ZIGZAG.tolist()):
                u, v = divmod(n, 8)
                total += 2 * c.coefficients[r, k, z] / 4 * (1 / math.sqrt(2) if u == 0 else 1) * (1 / math.sqrt(2) if v == 0 else 1) * math.cos((2 * sy + 1) * u * math.pi / 16) * math.cos((2 * sx + 1) * v * math.pi / 16)
            sample.append(min(255, max(0, round(total))))
        luma, cb, cr = sample[0], sample[1] - 128, sample[2] - 128
        want = [luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb]
        assert all(abs(min(255, max(0, w)) - g) <= 2.5 for w, g in zip(want, rgb[y, x].tolist()))


def test_frames(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "long " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    for r in jpeg.digests(jpeg.stored(df)).collect():
        t = dict(rows)[r.doc_id] or ""
        p = jpeg.padded(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == len(jpeg.encode(p)) and r.media_sha256 == hashlib.sha256(jpeg.encode(p)).hexdigest()
    media = jpeg.to_media(df)
    back = jpeg.from_media(media)
    for r in back.collect():
        assert bytes(r.payload) == jpeg.padded((dict(rows)[r.doc_id] or "").encode()) and len(r.rgb) == 3 * r.height * r.width
    assert jpeg.digests(jpeg.stored(df.limit(0))).count() == 0
    assert jpeg.from_media(spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")).first().payload is None


def test_corrupt_media_give_nulls(spark):
    good = jpeg.encode(jpeg.padded(b"some words " * 40))
    huge = good.replace(b"\x11\x08", b"\x11\x08", 1)
    at = huge.index(b"\xff\xc2") + 5
    huge = huge[:at] + b"\xff\xf0\xff\xf0" + huge[at + 4 :]
    cases = [good, good[:50], good[: len(good) // 2], good[:-2], b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"text", good.replace(b"\xff\xc2", b"\xff\xc0", 1), huge, None]
    df = spark.createDataFrame(list(enumerate([440] * len(cases))), "doc_id long, n_bytes long")
    media = spark.createDataFrame(list(enumerate(cases)), "doc_id long, media binary")
    df = df.join(media, "doc_id")
    for r in jpeg.from_media(df).collect():
        assert (r.payload is not None) == (r.rgb is not None) == (r.doc_id == 0), r.doc_id
    for r in jpeg.digests(df).collect():
        assert (r.feature is not None) == (r.doc_id == 0) and r.media_bytes == (None if cases[r.doc_id] is None else len(cases[r.doc_id]))


def test_feature_reads_every_pixel():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (16, 24, 3), np.uint8)
    whole = jpeg.feature(x)
    want = [[int(x[..., i].astype(int).sum()), int((x[..., i].astype(int) ** 2).sum()), int(np.abs(np.diff(x[..., i].astype(int), axis=1)).sum())] for i in range(3)]
    assert whole == "24x16:" + ":".join(",".join(map(str, w)) for w in want)
