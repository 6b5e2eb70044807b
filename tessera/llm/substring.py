"""Repeated word sequences by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are dealt to blocks of bounded size, and every block is reference and input at once. A block is indexed by
its windows of ``window`` words: hash -> first document and position. Blocks do not meet pair by pair; their indexes are
dealt by hash to shards, where what one block holds is looked up in all the others:

1. Each block sends the minimum hash of the 5-grams of each window (a sample that equal windows share), cut to 32
   bits, once for each block. Shards answer with those that more than one document holds.
2. Each block sends its windows around such an anchor, once each, with their first place. Shards answer with the
   first place over all blocks where that lies in a smaller document than the block's own.
3. Each document is parsed: a factor starts at a word whose window has an earlier place and goes on as long as the next
   window continues at the next word of the same place. At a factor's boundary the windows are looked up afresh, so
   one that straddles two factors is judged too. The words of all factors are the duplicate spans.

A frequent passage travels once for each block and not once for each document. Hashes of windows have 64 bits beside
the shard's number, which comes from a second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text in a block, and entries of an index shard, on average.
BLOCK_BYTES, SHARD_ENTRIES = 4 << 20, 500_000
#: Words of an anchor.
GRAM = 5
#: The document id that never precedes another.
LAST = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """A hash for each k consecutive entries."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * by + h[j : j + n]
    return _mixed(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Block:
    """Word hashes of a block's documents, one after the other."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int, keep_words: bool = False):
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).cast(pa.int64())
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = np.where(self.null, LAST, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.words: list[list[bytes]] = []
        digest, parts, counts = xxhash.xxh3_64_intdigest, [], []
        for t in text_bytes(texts):
            w = t.split()
            counts.append(len(w))
            parts.append(np.fromiter([digest(x) for x in w], np.uint64, len(w)))
            if keep_words:
                self.words.append(w)
        self.counts = np.array(counts, np.int64)
        self.first = np.r_[0, np.cumsum(self.counts)]
        self.h = np.concatenate([*parts, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(counts)), self.counts)
        n = max(0, len(self.h) - window + 1)
        #: Where a window starts that lies in one document.
        self.at = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n]) if n else np.zeros(0, np.int64)
        self.row = row[self.at]
        self.window = window

    def anchors(self) -> np.ndarray:
        return sliding_min(grams(self.h, min(GRAM, self.window), _A), max(1, self.window - GRAM + 1))[self.at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return grams(self.h, self.window, _A)[self.at], grams(self.h, self.window, _B)[self.at]


def _cut(anchors: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32 bits of an anchor."""
    return (anchors & np.uint64(0xFFFFF)).astype(np.int64) % shards, (anchors >> np.uint64(20)).astype(np.uint32)


def _by(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """For each value of ``group`` the columns' entries as bytes, in the order given."""
    order = np.argsort(group, kind="stable")
    names, starts = np.unique(group[order], return_index=True)
    columns = [c[order] for c in columns]
    for name, a, b in zip(names.tolist(), starts, np.r_[starts, len(group)][1:], strict=True):
        yield name, [c[a:b].tobytes() for c in columns]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and the row that each came from."""
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _send_anchors(window: int, shards: int, id_col: str, text_col: str):
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        b = Block(docs[id_col], docs[text_col], window)
        a, row = b.anchors(), b.row
        new = np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])][: len(a)]
        a, row = a[new], row[new]
        order = np.lexsort((row, a))
        a, row = a[order], row[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])][: len(a)]
        a, counts = np.unique(a[new], return_counts=True)
        shard, short = _cut(a, shards)
        got = {}
        for i, few in enumerate((counts == 1, counts > 1)):
            for s, (x,) in _by(shard[few], short[few]):
                got.setdefault(s, [b"", b""])[i] = x
        return _table([(s, key[0].as_py(), *x) for s, x in got.items()], schema)

    return run


def _shared_anchors(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])
    block = sent["block"].to_numpy()
    once, r1 = _joined(sent["once"], np.uint32)
    more, r2 = _joined(sent["more"], np.uint32)
    vals, rows = np.r_[once, more], block[np.r_[r1, r2]] if len(block) else np.zeros(0, np.int64)
    _, where, counts = np.unique(np.r_[vals, more], return_inverse=True, return_counts=True)
    shared = counts[where[: len(vals)]] > 1
    return _table([(b, key[0].as_py(), x, None, None) for b, (x,) in _by(rows[shared], vals[shared])], schema)


def _firsts(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the entry with the smallest (doc, at) of each h, by h."""
    order = np.lexsort((at, doc, h))
    return order[np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]]


def _send_windows(window: int, shards: int, window_shards: int, id_col: str, text_col: str):
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        b = Block(docs[id_col], docs[text_col], window)
        short, row = _joined(shared["a"], np.uint32)
        known = np.sort((shared["shard"].to_numpy()[row] << 32 | short.astype(np.int64)) if len(row) else np.zeros(0, np.int64))
        shard, short = _cut(b.anchors(), shards)
        mine = np.flatnonzero(np.isin(shard << 32 | short.astype(np.int64), known))
        ha, hb = (x[mine] for x in b.windows())
        row, at = b.row[mine], (b.at - b.first[b.row])[mine]
        real = ~b.null[row]
        ha, hb, row, at = ha[real], hb[real], row[real], at[real]
        first = _firsts(ha, b.ids[row], at)
        got = _by((hb[first] % np.uint64(window_shards)).astype(np.int64), ha[first], b.ids[row[first]], at[first].astype(np.int32))
        return _table([(s, key[0].as_py(), *x) for s, x in got], schema)

    return run


def _first_places(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()), ("docs", pa.binary()), ("at", pa.binary())])
    h, r = _joined(sent["h"], np.uint64)
    docs, at = _joined(sent["docs"], np.int64)[0], _joined(sent["at"], np.int32)[0]
    if not len(h):
        return schema.empty_table()
    first = _firsts(h, docs, at)
    best = first[np.searchsorted(h[first], h)]
    later = docs[best] < docs
    best = best[later]
    got = _by(sent["block"].to_numpy()[r[later]], h[best], docs[best], at[best])
    return _table([(b, key[0].as_py(), *x) for b, x in got], schema)


def factors(window: int, dup: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: (start, end, source document, source word), in words.

    ``dup`` windows that have an earlier place (``doc``, ``at``). A factor goes on while the place does; its end is
    a boundary, where the next window's own place counts.
    """
    on = np.flatnonzero(dup)
    if not len(on):
        return []
    go = (on[1:] == on[:-1] + 1) & (doc[on[1:]] == doc[on[:-1]]) & (at[on[1:]] == at[on[:-1]] + 1)
    a, b = on[np.r_[True, ~go]], on[np.r_[~go, True]]
    return list(zip(a.tolist(), (b + window).tolist(), doc[a].tolist(), at[a].tolist(), strict=True))


def _parse(window: int, window_shards: int, names: list[str], schema: pa.Schema, id_col: str, text_col: str):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, places: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        b = Block(docs[id_col], docs[text_col], window, keep_words=True)
        ha, hb = b.windows()
        ids, at = b.ids[b.row], b.at - b.first[b.row]
        # The first place inside the block, then that in other blocks where it is earlier.
        doc, pos = np.full(len(ha), LAST), np.zeros(len(ha), np.int64)
        real = np.flatnonzero(~b.null[b.row])
        first = real[_firsts(ha[real], ids[real], at[real])]
        if len(first):
            i = np.minimum(np.searchsorted(ha[first], ha), len(first) - 1)
            same = ha[first[i]] == ha
            doc[same], pos[same] = ids[first[i]][same], at[first[i]][same]
        h, r = _joined(places["a"], np.uint64)
        if len(h):
            pd, pp, ps = _joined(places["docs"], np.int64)[0], _joined(places["at"], np.int32)[0], places["shard"].to_numpy()[r]
            order = np.argsort(h)
            h, pd, pp, ps = h[order], pd[order], pp[order], ps[order]
            i = np.minimum(np.searchsorted(h, ha), len(h) - 1)
            same = (h[i] == ha) & (ps[i] == (hb % np.uint64(window_shards)).astype(np.int64)) & (pd[i] < doc)
            doc[same], pos[same] = pd[i][same], pp[i][same]
        dup = (doc < ids) & ~b.null[b.row]
        bounds = np.searchsorted(b.row, np.arange(len(b.ids) + 1))
        n_removed, kept, spans = np.zeros(len(b.ids), np.int64), [], []
        hit = np.add.reduceat(np.r_[dup, False].astype(np.int64), np.minimum(bounds[:-1], len(dup))) if len(dup) else n_removed
        hit = np.where(bounds[1:] > bounds[:-1], hit, 0)
        for k, words in enumerate(b.words):
            found = []
            if hit[k]:
                s = slice(bounds[k], bounds[k + 1])
                found = factors(window, dup[s], doc[s], pos[s])
                out = np.zeros(len(words), bool)
                for x, y, _, _ in found:
                    out[x:y] = True
                n_removed[k] = out.sum()
                words = [words[i] for i in np.flatnonzero(~out).tolist()]
            kept.append(b" ".join(words))
            spans.append([{"start": x, "end": y, "source_id": d, "source_start": p} for x, y, d, p in found])
        own = [docs[n] for n in names]
        made = [pa.array(b.counts), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("factors").type)]
        return pa.Table.from_arrays([*own, *made], schema=schema)

    return run


def parse(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, n_removed, kept (words that stay, by one space) and
    factors (array of start, end, source_id, source_start, in words).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. Words are
    split at ASCII white space. A null text has no words. A row with a null id is neither reference nor deduplicated;
    rows that repeat an id don't precede each other. Columns of the input by the names of the four new ones are
    replaced. An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    new = ("n_words", "n_removed", "kept", "factors", "block_")
    own = [c for c in docs.columns if c.lower() not in new]
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = max(1, -(-size // (32 * SHARD_ENTRIES)))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block_"))
    dealt = lambda: rows.groupBy("block_")  # noqa: E731  the same exchange each time, so Spark reuses it
    sent = dealt().applyInArrow(_send_anchors(window, shards, id_col, text_col), "shard long, block long, once binary, more binary")
    answer = "block long, shard long, a binary, docs binary, at binary"
    shared = sent.groupBy("shard").applyInArrow(_shared_anchors, answer)
    sent = dealt().cogroup(shared.groupBy("block")).applyInArrow(_send_windows(window, shards, shards, id_col, text_col), "shard long, block long, h binary, docs binary, at binary")
    places = sent.groupBy("shard").applyInArrow(_first_places, answer)
    factor = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "source_id", "source_start")]))
    out = T.StructType([*[docs.schema[c] for c in own], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("factors", factor)])
    return dealt().cogroup(places.groupBy("block")).applyInArrow(_parse(window, shards, own, to_arrow_schema(out), id_col, text_col), out)
