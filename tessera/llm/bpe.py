"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A text is split by the vocabulary's pattern. A pre-token that is an entry itself is resolved by one probe of a minimal
perfect hash (hash and displace; the entry's bytes are compared). Any other is merged pair by pair: its bytes form a
linked list, a heap holds the adjacent pairs by rank and place, and a merge links past the right part. Results are kept
in two-generation memos of bounded size, for pre-tokens and for words with their leading space.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: White space as the pattern means it (Unicode's White_Space), written out as libraries differ on controls.
SPACE = r"\t-\r \x85\xa0  -     　"
_M, _K, _MASK = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    return ((((h ^ (d * _K)) & _MASK) * _M & _MASK) >> 17) % n


class MinimalPerfectHash:
    """n keys to the slots 0 to n - 1. A bucket's displacement sends its keys to free slots; that of a single key is
    the slot itself, as -slot - 1."""

    def __init__(self, keys: list[bytes]):
        n, digest = len(keys), xxhash.xxh3_64_intdigest
        self.n, self.buckets = n, max(1, n // 4)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [digest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.displacements, taken, self.order = [0] * self.buckets, bytearray(n), [0] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if not own:
                break
            if len(own) == 1:
                while taken[free]:
                    free += 1
                taken[free], self.order[free], self.displacements[b] = 1, own[0], -free - 1
                continue
            d = 0
            while True:
                slots = [_slot(hashes[i], d, n) for i in own]
                if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            for s, i in zip(slots, own, strict=True):
                taken[s], self.order[s] = 1, i
            self.displacements[b] = d

    def index(self, key: bytes) -> int:
        """The slot of ``key`` if it is one of the keys; else that of another."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacements[h % self.buckets]
        return _slot(h, d, self.n) if d >= 0 else -d - 1


class Memo:
    """A dict of two generations: what is asked for again moves to the young one, and the old one goes when that is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Vocabulary:
    """Ranks of byte strings, with the perfect hash over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slot_keys = [keys[i] for i in self.hash.order]
        self.slot_ids = [ranks[k] for k in self.slot_keys]

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def load(path: str, pattern: str) -> Vocabulary:
        """From a file of lines ``base64 rank``."""
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def lookup(self, token: bytes) -> int | None:
        s = self.hash.index(token)
        return self.slot_ids[s] if self.slot_keys[s] == token else None

    def merge(self, token: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        n, rank = len(token), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [rank(token[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [r << 32 | i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = None
            if end < n:
                before[end] = i
                r = pair[i] = rank(token[i : after[end]])
                if r is not None:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = None
            if (p := before[i]) >= 0:
                r = pair[p] = rank(token[p:end])
                if r is not None:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[token[i : after[i]]])
            i = after[i]
        return out


class Codec:
    """Encodes and decodes with memos; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, units: int = 500_000, tokens: int = 500_000):
        self.v = vocabulary
        pattern = vocabulary.pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(pattern).findall
        self.units_of = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.spaced = regex.compile(f"^[{SPACE}]|[{SPACE}]$").search
        self.units, self.tokens = Memo(units), Memo(tokens)
        size = max(vocabulary.ranks.values(), default=-1) + 1
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.bytes_of: list[bytes | None] = [None] * size
        for k, i in vocabulary.ranks.items():
            self.bytes_of[i] = k
        self.decimal = [str(i).encode() for i in range(size)]

    def _pretoken(self, token: bytes) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            i = self.v.lookup(token)
            got = np.array(self.v.merge(token) if i is None else [i], self.kind).tobytes()
            if len(token) <= 64:
                self.tokens.put(token, got)
        return got

    def _unit(self, unit: str) -> bytes:
        return b"".join([self._pretoken(t.encode()) for t in self.split(unit)])

    def _word(self, piece: bytes) -> bytes | bool:
        """Ids of a space and ``piece``; False where its ends are white space, as what stands around matters then."""
        text = piece.decode()
        got = False if not text or self.spaced(text) else self._unit(f" {text}")
        if len(piece) <= 64:
            self.units.put(piece, got)
        return got

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text. A space with the non-space run after it can be encoded by itself where no other white space adjoins."""
        if not text:
            return np.zeros(0, self.kind)
        first, *pieces = text.split(b" ")
        young, get = self.units.young.get, self.units.get
        out = [young(p) for p in pieces]
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    x = get(pieces[i])
                    out[i] = self._word(pieces[i]) if x is None else x
        head = first.decode()
        if not head or self.spaced(head) or False in out:
            out = []
            for u in self.units_of(text.decode()):
                key = u.encode()[1:] if u[0] == " " and len(u) > 1 and not u[1:].isspace() else None
                x = self._unit(u) if key is None else get(key)
                out.append(self._word(key) if x is None else x or self._unit(u))
            return np.frombuffer(b"".join(out), self.kind)
        return np.frombuffer(self._unit(head) + b"".join(out), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CODECS: dict[tuple, Codec] = {}


def _codec(shared) -> Codec:
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class Shared:
    """A vocabulary that workers get once, by broadcast; its size is that of the file."""

    def __init__(self, df: DataFrame, path: str, pattern: str):
        self.id = (path, pattern)
        self.sent = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path, pattern))

    @property
    def value(self) -> Vocabulary:
        return self.sent.value


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row per row. A null or empty text has no ids; very long texts are taken whole."""
    shared = Shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec = _codec(shared)
            ids = [codec.encode(t).astype(np.int32) for t in text_bytes(b.column(1))]
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, decoded binary). Null ids give empty bytes; an id outside the vocabulary is an error."""
    shared = Shared(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec = _codec(shared)
            out = [codec.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode`` of each text in one pass, as digests."""
    from hashlib import sha256

    shared = Shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codec, counts, of_ids, of_bytes = _codec(shared), [], [], []
            for t in text_bytes(b.column(1)):
                ids = codec.encode(t)
                counts.append(len(ids))
                of_ids.append(sha256(b",".join(map(codec.decimal.__getitem__, ids.tolist()))).hexdigest())
                of_bytes.append(sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
