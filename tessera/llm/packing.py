"""Packing into fixed windows by lexical retrieval: a sharded BM25 index returns unused neighbours for each seed.

Documents are encoded once, written as bytes of ids, and dealt to shards of bounded size by content: they are ordered by the
terms that win two weighted lots (a term wins the more likely the fewer documents hold it, and documents that share their rare
terms share the winners), and this order is cut into shards. A crowd of like or equal documents fills as many shards as it
needs. Each shard holds an inverted index of its own documents; how many documents hold a term is counted over all shards
first, so weights don't depend on the dealing (the table of counts is as long as the vocabulary at most). A seed opens a
window, its neighbours follow by score while they fit; when none fits any more, the best unused one is cut to fill the
window, and its rest stays unused. So only a shard's last window has padding. Neighbours are those of the seed's shard.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .merges import PairTable, merge_rows

#: Tokens of a shard, on average, and of a window.
SHARD_TOKENS, WINDOW = 1 << 20, 2048
#: Bytes of text that are encoded at once, and words that an encoder remembers with their ids from one turn to the next.
TURN, MEMO = 8 << 20, 1 << 18
K1, B = 1.2, 0.75


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of ``counts[i]`` entries from ``starts[i]`` on, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array without nulls."""
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value after the other, of ``counts`` items of ``data``."""
    ends = np.r_[0, np.cumsum(counts * data.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of all documents' distinct terms, by document, then by term."""
    flat, sizes = np.concatenate(docs), [len(d) for d in docs]
    key, shift = (np.uint32, 16) if flat.itemsize == 2 and len(docs) <= 1 << 16 else (np.uint64, 32)
    keys = np.repeat(np.arange(len(docs), dtype=key) << key(shift), sizes) | flat.astype(key)
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    own = keys[first]
    return (own >> key(shift)).astype(np.intp), (own & key((1 << shift) - 1)).astype(flat.dtype), np.diff(np.r_[first, len(keys)])


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and case and splits letters, digits and the rest.

    A batch is worked on as arrays: its distinct words (between ASCII white space, which encode alone) are cut into runs
    as the tokenizer's pattern cuts them, the distinct runs are merged by the vocabulary's own table, and words and texts
    are put together from these; words of up to LONGEST bytes are remembered, MEMO at most, then those of the last turn. Words with an apostrophe or with characters beyond ASCII that aren't plain letters go to the
    tokenizer whole.
    """

    #: Bytes of the longest run that is merged in arrays, and of the longest word that is remembered.
    LONGEST = 48

    def __init__(self, spec: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        #: Texts that may hold an added token go to the tokenizer whole.
        self.added = [t["content"] for t in json.loads(spec).get("added_tokens") or ()]
        model = json.loads(spec)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        column = lambda f: np.array([vocabulary[f(p)] for p in pairs], np.int64)
        self.table = PairTable(column(lambda p: p[0]), column(lambda p: p[1]), column(lambda p: p[0] + p[1]))
        # Bytes as the printable characters that stand for them: those that are printable themselves, then the others in order.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
        self.inner = np.array([vocabulary[stand[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[stand[b] + suffix] for b in range(256)], np.int32)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = end_id
        self.known, self.coded = pa.array([], pa.binary()), pa.array([], pa.binary())
        letter, digit = np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.isin(np.arange(256), range(48, 58))
        self.classes = np.where(letter, 1, np.where(digit, 2, 3)).astype(np.uint8)

    def _whole(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _merge(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct runs: (all ids, start and count of each run's, whether its word must be encoded whole)."""
        n = len(at) - 1
        length, beyond = np.diff(at), np.r_[0, np.cumsum(data >= 128)]
        # Small letters of Latin-1 are two bytes, C3 and 9F to BF without B7; they stand as they are.
        after = np.r_[data[1:], 0]
        good = (data < 128) | ((data == 0xC3) & (after >= 0x9F) & (after <= 0xBF) & (after != 0xB7)) | (np.r_[0, data[:-1]] == 0xC3)
        odd = np.r_[0, np.cumsum(~good)]
        bad, alone = np.zeros(n, bool), np.flatnonzero((length > self.LONGEST) & (beyond[at[1:]] == beyond[at[:-1]])).tolist()
        for i in np.flatnonzero((odd[at[1:]] > odd[at[:-1]]) | ((length > self.LONGEST) & (beyond[at[1:]] > beyond[at[:-1]]))).tolist():
            s = data[at[i] : at[i + 1]].tobytes().decode()
            t = "".join(map(str.lower, unicodedata.normalize("NFC", s)))
            if not s.isalpha() or not t.isalpha():
                bad[i] = True
            elif t != s or length[i] > self.LONGEST:
                alone.append(i)
        parts, starts, counts, total = [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        left = ~bad
        left[alone] = False
        for size in np.unique(length[left]).tolist():
            own = np.flatnonzero(left & (length == size))
            for a in range(0, len(own), 1 << 16):
                some = own[a : a + (1 << 16)]
                raw = data[at[some][:, None] + np.arange(size)]
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                for rows, final in merge_rows(ids, self.table):
                    width = final.shape[1]
                    starts[some[rows]], counts[some[rows]] = total + np.arange(len(rows)) * width, width
                    parts.append(final.ravel())
                    total += final.size
        for i, ids in zip(alone, self._whole([data[at[i] : at[i + 1]].tobytes() for i in alone]), strict=True):
            starts[i], counts[i] = total, len(ids)
            parts.append(ids)
            total += len(ids)
        return np.concatenate([*parts, np.zeros(0, np.int32)]), starts, counts, bad

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, start and count of each word's)."""
        at, data = _strings(words)
        n = len(words)
        data = data[at[0] : at[-1]]
        at = at - at[0]
        kind = self.classes[data]
        new = np.r_[True, kind[1:] != kind[:-1]][: len(data)] | (kind == 2)
        new[at[:-1][at[:-1] < at[1:]]] = True
        first = np.flatnonzero(new)
        word = np.searchsorted(at, first, side="right") - 1
        ends = np.r_[first, len(data)].astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        ids, starts, counts, bad = self._merge(*_strings(runs.dictionary))
        run = runs.indices.to_numpy()
        whole = np.zeros(n, bool)
        whole[word[bad[run]]] = True
        whole[np.searchsorted(at, np.flatnonzero(data == 39), side="right") - 1] = True
        run_counts = np.where(whole[word], 0, counts[run])
        out, total = [ids[_ragged(starts[run], run_counts)]], np.bincount(word, run_counts, n).astype(np.int64)
        begin = np.cumsum(total) - total
        end, some = int(total.sum()), np.flatnonzero(whole).tolist()
        for i, x in zip(some, self._whole([data[at[i] : at[i + 1]].tobytes() for i in some]), strict=True):
            begin[i], total[i] = end, len(x)
            out.append(x)
            end += len(x)
        return np.concatenate(out), begin, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the closing one of each, offsets)."""
        texts = texts.cast(pa.string()).fill_null("")
        some = np.zeros(len(texts), bool)
        for content in self.added:
            some |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not some.any():
            return self._plain(texts)
        ids, offsets = self._plain(pc.if_else(pa.array(some), "", texts))
        parts, sizes, at = [], np.diff(offsets), 0
        for i in np.flatnonzero(some).tolist():
            own = np.r_[self._whole([texts[i].as_py().encode()])[0], self.end].astype(self.kind)
            parts += [ids[at : offsets[i]], own]
            sizes[i], at = len(own), offsets[i + 1]
        return np.concatenate([*parts, ids[at:]]), np.r_[0, np.cumsum(sizes)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.binary()).dictionary_encode()
        ends = ends - ends[0]
        words = coded.dictionary
        at = pc.index_in(words, self.known)
        new = words.filter(at.is_null())
        ids, starts, counts = self._words(new)
        made = _binary(ids[_ragged(starts, counts)].astype(self.kind), counts)
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.known) + np.arange(len(new))
        own = pa.concat_arrays([self.coded, made])
        if len(own) <= MEMO:
            short = pc.less_equal(pc.binary_length(new), self.LONGEST)
            self.known, self.coded = pa.concat_arrays([self.known, new.filter(short)]), pa.concat_arrays([self.coded, made.filter(short)])
        else:
            some = np.flatnonzero(pc.less_equal(pc.binary_length(words), self.LONGEST).to_numpy(zero_copy_only=False))[:MEMO]
            self.known, self.coded = words.take(pa.array(some)), own.take(pa.array(at[some]))
        word = np.insert(at[coded.indices.to_numpy()], ends[1:], len(own))
        offsets, data = _strings(pa.concat_arrays([own, _binary(np.array([self.end], self.kind), np.array([1]))]).take(pa.array(word)))
        offsets = offsets[np.r_[0, ends[1:] + np.arange(1, len(ends))]] // np.dtype(self.kind).itemsize
        return data.view(self.kind)[: offsets[-1]], offsets


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(key: tuple, spec) -> WordEncoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec.value, key[1])
    return _ENCODERS[key]


def tokenize(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary: 16-bit little-endian, 32-bit for vocabularies over 65,536)."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    key = (path, end_id)

    def coded(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        doc_id, text = (pa.concat_arrays([b.column(j) for b in some]) for j in (0, 1))
        ids, offsets = _encoder(key, spec).encode(text)
        n = np.diff(offsets)
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n), _binary(ids, n)], ["doc_id", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in batches:
            if some and size + b.nbytes > TURN:
                yield coded(some)
                some, size = [], 0
            some.append(b)
            size += b.nbytes
        if some:
            yield coded(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def document_counts(tokens: DataFrame, width: int) -> DataFrame:
    """(term, n): documents that hold each id, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            n = np.bincount(_terms([np.frombuffer(x.as_py(), f"<u{width}") for x in b.column(0)])[1])
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "n"])

    return tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lots(idf: np.ndarray, seed: int) -> np.ndarray:
    """Of each term: an exponential draw over its squared weight. The term of a document with the least one is its winner, and
    two documents share it with the weighted similarity of their sets of terms."""
    draw = -np.log1p(-np.random.default_rng([seed, len(idf)]).random(len(idf)))
    return draw / np.maximum(idf, 1e-3) ** 2


def _winners(idf, width: int):
    """Adds the two winners, in the order of a shuffled vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        own = [lots(weights, k) for k in range(2)]
        name = np.random.default_rng(2).permutation(len(weights))
        for b in batches:
            ids = [np.frombuffer(x.as_py(), f"<u{width}") for x in b.column(2)]  # repeats of a term draw the same lot
            won = [pa.array([int(name[t[k[t].argmin()]]) for t in ids], pa.int64()) for k in own]
            yield pa.RecordBatch.from_arrays([*b.columns, *won], ["rid", "doc_id", "ids", "w1", "w2"])

    return run


class Index:
    """Inverted index with BM25 weights over one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        rows, t, tf = _terms(docs)
        self.of = np.split(t, np.searchsorted(rows, np.arange(1, len(docs))))
        length = np.array([len(d) for d in docs])
        order = np.argsort(t, kind="stable")
        self.rows = rows[order]
        self.weights = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)[rows]) * idf[t])[order]
        self.starts = np.searchsorted(t[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def scores(self, i: int) -> np.ndarray:
        t = self.of[i]
        a, n = self.starts[t], self.starts[t.astype(np.int64) + 1] - self.starts[t]
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.rows[at], self.weights[at], self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. What is longer than a window fills whole ones first."""
    out, sequence = [], 0
    start = np.zeros(len(docs), np.int64)
    for i, d in enumerate(docs):
        while len(d) - start[i] >= window:
            out.append((i, int(start[i]), window, sequence, 0))
            start[i] += window
            sequence += 1
    left = np.array([len(d) for d in docs], np.int64) - start
    if not left.any():
        return out
    index = Index([d[s:] for d, s in zip(docs, start, strict=True)], idf, mean)
    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        score, at, i = index.scores(seed), 0, seed
        while True:
            n = int(min(left[i], window - at))
            out.append((i, int(start[i]), n, sequence, at))
            start[i] += n
            left[i] -= n
            at += n
            if at == window:
                break
            fits = np.where((left > 0) & (left <= window - at), score, -1)
            i = int(fits.argmax())
            if fits[i] < 0:
                rest = np.where(left > 0, score, -1)
                i = int(rest.argmax())
                if rest[i] < 0:
                    break
        sequence += 1
    return out


def dealt(tokens: DataFrame, idf, width: int, shards: int) -> DataFrame:
    """``tokens`` (rid, doc_id, ids) ordered by their winners over ``shards`` partitions; rid tells equal ones apart."""
    won = tokens.select("rid", "doc_id", "ids").mapInArrow(_winners(idf, width), "rid long, doc_id long, ids binary, w1 long, w2 long")
    return won.repartitionByRange(shards, "w1", "w2", "rid").sortWithinPartitions("w1", "w2", "rid")


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids array<int>.

    A null or empty text is the closing id alone. Every id of every row lies in one piece; repeated rows and null
    ids are packed like others. Ties go to the longer, then the earlier document. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, path, end_id, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    tokens = materialise(tokens, "tokens")
    with open(path, encoding="utf-8") as f:
        from tokenizers import Tokenizer

        width = 2 if Tokenizer.from_str(f.read()).get_vocab_size() <= 1 << 16 else 4
    n_docs, n_tokens = tokens.agg(F.count("*"), F.sum("n_tokens")).first()
    counts = document_counts(tokens, width).collect()  # as many rows as the vocabulary has entries at most
    held = np.zeros(max((r.term for r in counts), default=-1) + 1)
    for r in counts:
        held[r.term] = r.n
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - held + 0.5) / (held + 0.5)))
    mean = (n_tokens or 1) / max(1, n_docs)
    shards = max(1, -(-(n_tokens or 0) // shard_tokens))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def packed(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        order = sorted(range(len(ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
        doc_ids, ids = [doc_ids[i] for i in order], [ids[i] for i in order]
        rows, last = [], first
        for i, s, n, q, at in pack_shard(ids, idf.value, mean, window):
            piece = ids[i][s : s + n].astype("<u4")
            rows.append((doc_ids[i], s, n, zlib.crc32(piece.tobytes()), len(ids[i]), first + q, at, *[piece.astype(np.int32)] * with_ids))
            last = max(last, first + q + 1)
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema), last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts where a partition of the sampled ranges came out twice as long as a shard."""
        first, doc_ids, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(d)
                ids.append(np.frombuffer(x.as_py(), f"<u{width}"))
                size += len(ids[-1])
                if size >= 2 * shard_tokens:
                    out, first = packed(doc_ids, ids, first)
                    yield out
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield packed(doc_ids, ids, first)[0]

    made = ", ".join(f"{n} long" for n in schema.names[:7]) + ", ids array<int>" * with_ids
    return dealt(tokens, idf, width, shards).select("doc_id", "ids").mapInArrow(run, made)
