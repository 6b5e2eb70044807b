"""Near-duplicate texts at a shingle similarity, by SimHash fingerprints of several machine words.

64 bits tell copies from others, but not a similarity of 0.8 from one of 0.6. Here a fingerprint has 256 bits and only
finds candidates: pairs whose distance is within REACH of that of pairs at the similarity. So wide a radius leaves no block
surely equal; keys are sampled bits instead, as many as keep a bucket of unrelated texts small, in as many tables as give
the recall asked for, over both radius and keys, at the similarity itself. Inside a key the comparison is bit-sliced as for
64 bits. A candidate is a link only where the sets of shingles themselves have the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HUBS, hub_join, materialise, spread_join, text_bytes
from .components import connected_components
from .simhash import _CHUNK, _Union, links_in_runs

WORDS, BUCKET, RECALL = 4, 32.0, 0.95
#: Fingerprints of one key that are compared in one group.
HOT = 4096
#: Share of the pairs at the similarity that the radius of candidates holds.
REACH = 0.99


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of k words; one shingle for a shorter text, none for one without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(k)), strict=False)) if len(tokens) >= k else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(s, 42) for s in shingles], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have the Jaccard similarity; two empty ones have."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def wide_fingerprint(text: bytes, k: int, words: int = WORDS) -> bytes:
    """Majority bits over the XXH64 of each distinct shingle and its mixes; zeros for a text without words."""
    return _fingerprint(shingle_set(text, k), words)


def _fingerprint(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    counts = np.zeros((words, 64), np.int64)
    for j in range(words):
        if j:
            h = h + np.uint64(0x9E3779B97F4A7C15)
            x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        else:
            x = h
        for at in range(0, len(x), _CHUNK):
            counts[j] += np.unpackbits(x[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes()


def agreement(similarity: float) -> float:
    """Expected share of equal bits of two texts at a Jaccard similarity: that of the angle between their sets."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _distances(similarity: float, size: int) -> np.ndarray:
    """Chance of each distance at the similarity."""
    p = agreement(similarity)
    return np.array([math.comb(size, d) * (1 - p) ** d * p ** (size - d) for d in range(size + 1)])


def reach(similarity: float, words: int = WORDS) -> int:
    """Radius of candidates."""
    return int(np.searchsorted(np.cumsum(_distances(similarity, 64 * words)), REACH))


def recall(similarity: float, radius: int, bits: int, tables: int, words: int = WORDS) -> float:
    """Chance that a pair at the similarity is within the radius and shares a key."""
    size = 64 * words
    meets = np.array([math.prod(max(0, size - d - i) / (size - i) for i in range(bits)) for d in range(radius + 1)])
    return float((_distances(similarity, size)[: radius + 1] * (1 - (1 - meets) ** tables)).sum())


def settings(n: int, similarity: float, words: int = WORDS) -> tuple[int, int, int]:
    """(radius of likely links, bits of a key, tables) for n fingerprints; candidates reach further than likely links."""
    p, size = agreement(similarity), 64 * words
    radius = int(size * (1 - p) + math.sqrt(size * p * (1 - p)))
    bits = min(size, max(8, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    far, tables = reach(similarity, words), 1
    while recall(similarity, far, bits, tables, words) < RECALL:
        tables += 1
    return radius, bits, tables


def _keys(bits: int, tables: int, words: int, seed: int):
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(64 * words, bits, replace=False) for _ in range(tables)]
    weight = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.uint8).reshape(b.num_rows, 8 * words)
            own = np.unpackbits(fp, axis=1, bitorder="little")
            keys = np.stack([(own[:, c] @ weight) * tables + t for t, c in enumerate(chosen)], axis=1)
            ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["cid", "fp", "keys"])

    return run


def _runs(key: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))]


def _forest(likely: int, far: int):
    """(key, pair, cid, fp) -> candidates that span each run: likely links first, so that few of them fail."""

    def links(key: np.ndarray, cid: np.ndarray, fp: list[bytes]) -> pa.RecordBatch:
        run, own = _runs(key), np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), WORDS)
        found = links_in_runs(run, own, likely)
        found = cid[np.array(found + links_in_runs(run, own, far, found), np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cid, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), []
        for b in batches:
            key = np.r_[key, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)]
            cid = np.r_[cid, b.column(2).to_numpy()]
            fp += b.column(3).to_pylist()
            if len(fp) < 1 << 16:
                continue
            name = _runs(key)
            if cut := int(np.searchsorted(name, name[-1])):
                yield links(key[:cut], cid[:cut], fp[:cut])
                key, cid, fp = key[cut:], cid[cut:], fp[cut:]
        if fp:
            yield links(key, cid, fp)

    return run


def between(fp: np.ndarray, sets: list[np.ndarray], part: np.ndarray, far: int, similarity: float) -> list[tuple[int, int]]:
    """Links of one run that join its parts: every candidate whose ends are still apart is compared by its sets."""
    union, out = _Union(len(part)), []
    first: dict[int, int] = {}
    for i, p in enumerate(part.tolist()):
        union.join(first.setdefault(p, i), i)
    root = np.fromiter((union.root(i) for i in range(len(part))), np.int64, len(part))
    for i in range(len(part) - 1):
        other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        for j in other[np.bitwise_count(fp[other] ^ fp[i]).sum(axis=1, dtype=np.int64) <= far].tolist():
            if root[i] != root[j] and similar(sets[i], sets[j], similarity):
                out.append((i, j))
                low, high = sorted((int(root[i]), int(root[j])))
                root[root == high] = low
    return out


def _between(far: int, similarity: float):
    """(key, pair, cid, fp, part, shingles) -> the links that join parts of a run, a forest of them for each run."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len({r[4] for r in rows}) < 2:
            return []
        fp = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), WORDS)
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        return [tuple(sorted((rows[i][2], rows[j][2]))) for i, j in between(fp, sets, np.array([r[4] for r in rows]), far, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            found = []
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][:2] != r[:2]:
                    found += links(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _met(classes: DataFrame, bits: int, tables: int, seed: int, hot: int) -> DataFrame:
    """``classes`` (cid, fp and others) under the keys of all tables, as (key, pair, ...): crowded keys are pairs of blocks."""
    own = classes.columns
    keyed = classes.select("cid", "fp").mapInArrow(_keys(bits, tables, WORDS, seed), "cid long, fp binary, keys array<bigint>").select("cid", "fp", F.explode("keys").alias("key"))
    dealt = materialise(keyed, "dealt")
    # Most keys hold several fingerprints but few hold very many: only these are looked up, the largest of them in a broadcast.
    crowded = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = materialise(crowded.select("key", "n", F.ceil(F.col("n") / hot).cast("int").alias("blocks")), "crowded")
    hub = F.col("n") * HUBS > F.lit(dealt.count())
    hubs = F.broadcast(crowded.where(hub).select("key", F.col("blocks").alias("most")))
    met = dealt.join(hubs, "key", "left")
    rest = crowded.where(~hub).select("key", "blocks")
    met = met.where("most is not null").withColumn("blocks", F.col("most")).unionByName(met.where("most is null").join(rest, "key", "left")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(F.col("block"), o).cast("long") * F.col("blocks") + F.greatest(F.col("block"), o))
    met = met.select("key", F.explode(pair).alias("pair"), "cid", "fp")
    return met.join(classes.drop("fp"), "cid") if len(own) > 2 else met


def _carried(met: DataFrame, classes: DataFrame) -> DataFrame:
    """``met`` with the other columns of ``classes``, by (key, pair)."""
    of = met.groupBy("cid").agg(F.collect_list(F.struct("key", "pair")).alias("in"))  # as many as tables, but for crowded keys
    out = classes.join(of, "cid").select(F.explode("in").alias("at"), *classes.columns).select("at.key", "at.pair", *classes.columns)
    return out.repartition("key", "pair").sortWithinPartitions("key", "pair", "cid")


def _verified(found: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs whose texts (cid, text) have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # pairs come sorted by one end, mostly
        for b in batches:
            ends = b.column(1).to_pylist()
            keep = []
            for end, x, y in zip(ends, text_bytes(b.column(2)), text_bytes(b.column(3)), strict=True):
                if end != last:
                    last, held = end, shingle_set(y, shingle)
                keep.append(similar(shingle_set(x, shingle), held, similarity))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    total = found.count()
    met = spread_join(found.select("a", "b"), texts.select(F.col("cid").alias("a"), F.col("text").alias("x")), "a", total)
    met = spread_join(found.select("a", "b"), texts.select(F.col("cid").alias("b"), F.col("text").alias("y")), "b", total).join(met, ["a", "b"])
    return met.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in text_bytes(b.column(1))], pa.binary())], ["cid", "shingles"])

    return run


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, seed: int = 3) -> DataFrame:
    """The rows of ``docs``, unchanged, of which one of each near-duplicate group stays: that of the smallest id.

    Null ids come last, then the smallest hash decides. Null and empty texts are one group of copies. Repeated rows are
    copies too. Groups are the components of the links, over which copies of copies fall together; every link has the
    similarity. An empty table gives an empty table.

    First each key gives pairs that span its candidates. Where all of them are links, the group is done; where some aren't,
    the shingles of its texts travel to their keys, and all candidates between the parts are compared there, so no pair is judged
    by the estimate and only links that join parts leave a task.
    """
    own = docs.columns
    ident = [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit(seed), id_col).alias("k2")]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in text_bytes(b.column(3))]
            fp = pa.array([_fingerprint(h, WORDS) for h in sets], pa.binary())
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), fp, same], ["k1", "k2", "id", "fp", "same"])

    rows = docs.select(*ident, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(rows.mapInArrow(prints, "k1 long, k2 long, id long, fp binary, same binary"), "prints")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    # Equal sets of shingles are one class; different sets may share a fingerprint.
    classes = materialise(rows.groupBy("fp", "same").agg(F.min(who).alias("who")).drop("same").withColumn("cid", F.monotonically_increasing_id()), "classes")
    likely, bits, tables = settings(classes.count(), similarity)
    far = reach(similarity)
    met = _met(classes.select("cid", "fp"), bits, tables, seed, hot).repartition("key", "pair").sortWithinPartitions("key", "pair", "cid")
    found = materialise(met.mapInArrow(_forest(likely, far), "a long, b long").distinct(), "candidates")
    ends = found.select(F.col("a").alias("cid")).unionByName(found.select(F.col("b").alias("cid"))).distinct()
    asked = classes.join(ends, "cid").select("cid", "who.k1", "who.k2")
    texts = docs.select(*ident, F.col(text_col).alias("text")).join(asked, ["k1", "k2"]).groupBy("cid").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    links = materialise(_verified(found, texts, shingle, similarity), "verified")
    whole = connected_components(found).select(F.col("node").alias("cid"), F.col("component").alias("within"))
    parts = whole.join(connected_components(links), F.col("cid") == F.col("node"), "left").select("cid", "within", F.coalesce("component", "cid").alias("own"))
    parts = materialise(parts, "parts")
    broken = parts.groupBy("within").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("within")
    open_ = materialise(classes.select("cid", "fp").join(parts.join(broken, "within").select("cid", F.col("own").alias("part")), "cid"), "open")
    # Only keys under which parts meet, and of them the shingles themselves, so that no candidate has to leave its task.
    met = materialise(_met(open_, bits, tables, seed, max(2, hot // 8)).drop("fp"), "met")
    ends = met.groupBy("key", "pair").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high")
    apart = hub_join(met, materialise(ends.select("key", "pair", "n"), "apart"), ["key", "pair"], "n", met.count()).select("key", "pair", "cid")
    sets = texts.join(open_.select("cid"), "cid").mapInArrow(_sets(shingle), "cid long, shingles binary")
    more = _carried(apart, open_.join(sets, "cid").select("cid", "fp", "part", "shingles")).mapInArrow(_between(far, similarity), "a long, b long")
    linked = connected_components(links.unionByName(more.distinct()))
    named = classes.join(linked, F.col("cid") == F.col("node"), "left").select(F.coalesce("component", "cid").alias("class"), "who")
    stays = materialise(named.groupBy("class").agg(F.min("who").alias("who")).select("who.k1", "who.k2", F.lit(True).alias("stays")), "stays")
    # What becomes of each row that does not simply stay: it goes, or one of several equal rows stays.
    counts = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    acts = counts.join(stays, ["k1", "k2"], "left").where("stays is null or n > 1").select("k1", "k2", F.when(F.col("stays"), "once").otherwise("goes").alias("act"))
    acts = materialise(acts, "acts")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("r"), *ident).join(acts, ["k1", "k2"], "left")
    once = marked.where("act = 'once'").groupBy("k1", "k2").agg(F.first("r").alias("r")).select("r")
    return marked.where("act is null").select("r").unionByName(once).select(*[F.col("r").getField(c).alias(c) for c in own])
