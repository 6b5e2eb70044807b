"""SimHash fingerprints and their near-duplicate classes by bit-sliced comparison.

Fingerprints are 64 bits, the strict majority of XXH64 over word shingles. Distinct fingerprints are keyed by every
choice of equal blocks that a pair inside the radius must leave (pigeonhole), and compared inside a key only. There
their bits stand vertically: plane p holds bit p of 64 fingerprints in each machine word. A lane is compared with the
lane ``s`` further by shifting planes; the differing bits are added with carry-save bitwise counters, and a word of
lanes is abandoned once all 64 exceed the radius. Runs that are still not one class after a few shifts are compared
query by query against all planes of the run. A key with more than ``HOT`` fingerprints is split into blocks, and each
pair of blocks is a group of its own. Only links that join two classes of a group leave it, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise, text_bytes
from .components import connected_components

#: Fingerprints of one key that are compared in one group, and unrelated ones that a key may hold on average.
HOT, CROWD = 8192, 512
#: Shifts tried on all runs of a task at once at least, and machine words of lanes that more of them must be worth; what
#: is left is taken run by run. Runs that have become one class drop out every so many shifts.
SHIFTS, FEW = 8, 64
_CHUNK = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, k: int) -> int:
    """Unsigned. Words are split at ASCII white space after lower-casing A-Z; fewer than k words are one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(s, 42) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        counts += np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long). Null and empty texts have fingerprint 0; long texts are taken whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in text_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(bits, words) with bit i of word w of plane p = bit p of fingerprint 64 w + i; one word of zeros is added.

    ``fp``: (n,) or, for fingerprints of several machine words, (n, words).
    """
    n = len(fp)
    own = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8 * (fp.shape[1] if fp.ndim > 1 else 1)), axis=1, bitorder="little").T
    bits = np.zeros((len(own), (n // 64 + 2) * 64), np.uint8)
    bits[:, :n] = own
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Carry-save counters over lanes: ``digits[j]`` holds bit j of each lane's count, ``over`` that it overflowed."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.digits = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for d in self.digits:
            carry = d & x
            d ^= x
            x = carry
        self.over |= x

    def exceeds(self) -> np.ndarray:
        """Lanes whose count is over the radius, by comparing digits from the top."""
        more, same = self.over.copy(), ~self.over
        for j in reversed(range(len(self.digits))):
            if self.radius >> j & 1:
                same &= self.digits[j]
            else:
                more |= same & self.digits[j]
                same &= ~self.digits[j]
        return more

    def keep(self, where: np.ndarray) -> None:
        self.digits, self.over = [d[..., where] for d in self.digits], self.over[..., where]


def _near(take, n_planes: int, words: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``words`` with lanes within the radius, and the lanes; ``take(p, words)`` gives differing bits."""
    counter = Counter(valid.shape, radius)
    for p in range(n_planes):
        counter.add(take(p, words))
        if p % 8 == 7:
            alive = valid & ~counter.exceeds()
            some = alive.any(axis=0) if alive.ndim > 1 else alive != 0
            if not some.any():
                return words[:0], valid[..., :0]
            if some.mean() < 0.75:  # abandon blocks of which every lane exceeds the radius
                words, valid = words[some], valid[..., some]
                counter.keep(some)
    return words, valid & ~counter.exceeds()


def _lanes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[:, None] * 64 + np.arange(64))[np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links_in_runs(run: np.ndarray, fp: np.ndarray, radius: int, joined: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links inside each run of equal ``run`` (sorted), beside those already ``joined``."""
    n, found = len(fp), []
    if n < 2:
        return found
    union = _Union(n)
    for i, j in joined or ():
        union.join(i, j)

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if union.join(i, j):
                found.append((i, j))

    planes = bit_planes(fp)
    last = planes.shape[1] - 1
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[starts, n])
    open_ = np.repeat(size > 1, size)  # lanes of runs that aren't one class yet
    s = 0
    while True:
        s += 1
        pairs = np.zeros((last + 1) * 64, np.uint8)
        pairs[: max(0, n - s)] = (run[: n - s] == run[s:]) & open_[: n - s] if s < n else 0
        valid = np.packbits(pairs, bitorder="little").view(np.uint64)
        words = np.flatnonzero(valid)
        if not len(words):
            return found
        if s > SHIFTS and len(words) < FEW:
            break

        def take(p: int, w: np.ndarray, far: int = s // 64, by: int = s % 64) -> np.ndarray:
            row = planes[p]
            x = row[np.minimum(w + far, last)]
            if by:
                x = (x >> np.uint64(by)) | (row[np.minimum(w + far + 1, last)] << np.uint64(64 - by))
            return row[w] ^ x

        lanes = _lanes(*_near(take, len(planes), words, valid[words], radius))
        meet(lanes, lanes + s)
        if s % SHIFTS == 0:
            roots = np.fromiter((union.root(i) for i in range(n)), np.int64, n)
            split = np.r_[0, np.cumsum(roots[1:] != roots[:-1])]
            own = np.searchsorted(starts, np.arange(n), side="right") - 1
            open_ &= (split[np.minimum(starts + size, n) - 1] != split[starts])[own]
    for a, b in zip(starts.tolist(), (starts + size).tolist(), strict=True):
        if b - a <= s or not open_[a]:  # all its shifts are done, or it is one class
            continue
        roots = np.fromiter((union.root(i) for i in range(a, b)), np.int64)
        names, counts = np.unique(roots, return_counts=True)
        if len(names) == 1:
            continue
        ask = np.flatnonzero(roots != names[counts.argmax()])  # links between two classes touch one that isn't the largest
        own = bit_planes(fp[a:b])
        width = own.shape[1]
        mask = np.zeros(width * 64, np.uint8)
        mask[: b - a] = 1
        full = np.packbits(mask, bitorder="little").view(np.uint64)
        for at in range(0, len(ask), step := max(1, (1 << 15) // width)):
            q = ask[at : at + step]
            asked = np.ascontiguousarray(fp[a + q]).view(np.uint8).reshape(len(q), -1)
            flip = np.unpackbits(asked, axis=1, bitorder="little").T.astype(np.uint64) * _ONES

            def take(p: int, w: np.ndarray, flip: np.ndarray = flip, own: np.ndarray = own) -> np.ndarray:
                return own[p][w][None, :] ^ flip[p][:, None]

            words, bits = _near(take, len(own), np.arange(width), np.repeat(full[None, :], len(q), 0), radius)
            for i in np.flatnonzero(bits.any(axis=1)).tolist():
                on = bits[i] != 0
                lanes = _lanes(words[on], bits[i][on])
                meet(np.full(len(lanes), a + q[i]), a + lanes)
    return found


def _compare(radius: int):
    """Rows sorted by run -> links; a run that the end of a batch cuts waits for the next one."""

    def links(run: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = np.array(links_in_runs(run, fp, radius), np.int64).reshape(-1, 2)
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[found[:, 0]]), pa.array(signed[found[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            keys = np.r_[keys, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)]
            fps = np.r_[fps, b.column(2).to_numpy().view(np.uint64)]
            if len(fps) < 1 << 17:
                continue
            names = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield links(names[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(fps):
            yield links(np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))], fps)

    return run


def spare_blocks(n: int, radius: int) -> int:
    """Equal blocks that make a key, of radius + spare blocks. More of them make keys longer and buckets smaller: as many as
    keep CROWD unrelated fingerprints of n in a key, two at least."""
    spare = 2
    while spare < 8 and n > CROWD << (64 * spare // (radius + spare)):
        spare += 1
    return spare


def fingerprint_links(distinct: DataFrame, radius: int, spare: int | None = None, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every class of the graph "differs in ``radius`` bits or fewer".

    ``spare``: see ``spare_blocks``, which gives it by the number of fingerprints unless it is set.
    """
    count = distinct.count()
    spare = spare_blocks(count, radius) if spare is None else spare
    blocks = radius + spare
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fp = F.col("fingerprint")
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), spare)):
        key = F.lit(t).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part[i])
        keys.append(key)
    dealt = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    # A key with a single fingerprint has no pair; one with many is split into blocks.
    groups = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / hot).cast("int"))
    met = hub_join(dealt, materialise(groups, "keys"), "key", "n", count * len(keys)).withColumn("block", F.pmod(F.xxhash64("fingerprint", "key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(F.col("block"), o).cast("long") * F.col("blocks") + F.greatest(F.col("block"), o))
    met = met.select("key", F.explode(pair).alias("pair"), "fingerprint")
    return met.repartition("key", "pair").sortWithinPartitions("key", "pair", "fingerprint").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links, itself included; null where every id reachable is null.
    Null and empty texts have fingerprint 0 and link like any other; repeated rows share a class; an empty table gives
    an empty table; other columns are not read.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialise(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    linked = connected_components(fingerprint_links(classes.select("fingerprint"), radius))
    named = classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", "n", F.coalesce("component", "fingerprint").alias("class"))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    count, rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = materialise(hub_join(named, materialise(least, "least"), "class", "members", count).select("fingerprint", "n", "component_id"), "named")
    return hub_join(fps, named, "fingerprint", "n", rows).select("doc_id", "fingerprint", "component_id")
