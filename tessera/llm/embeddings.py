"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, distributed components.

Equal vectors of a label are one class first. A class's key in a table is the signs of its products with that table's
hyperplanes. Bits follow the number of classes, so that a bucket of unrelated vectors stays small, and tables follow
the bits, so that a pair at the threshold meets in one of them with the recall asked for. Buckets of hundreds are cheap to
multiply out, and every table sends each vector once, so buckets are wide and tables few. In a bucket cosines are
computed in double precision from the components as given. A pair counts in the first table in which it meets, which the keys
of linked vectors, computed again where they are, tell; so links are summed without ever being listed, and only links that
join two classes of a bucket go on to the components. Buckets over ``HOT`` classes are split into blocks, and each pair of
blocks is compared apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise
from .components import connected_components

#: Classes of a bucket that are compared in one group, and unrelated ones that a bucket may hold on average.
HOT, BUCKET = 2048, 256.0
#: Runs up to this length are compared by shifts, longer ones by matrix products, so many rows at a time.
SHORT, ROWS = 12, 256


def table_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = min(62, max(4, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


class Signs:
    """Keys of vectors in all tables; one vector at a time, so that a key never depends on the vectors beside it."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.planes: dict[int, np.ndarray] = {}
        self.weight = 1 << np.arange(bits, dtype=np.int64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        n = len(unit)
        if n not in self.planes:
            self.planes[n] = np.random.default_rng([self.seed, n]).standard_normal((n, self.bits * self.tables))
        return (unit @ self.planes[n] > 0).reshape(self.tables, self.bits) @ self.weight


def unit(v: np.ndarray) -> np.ndarray:
    x = np.asarray(v, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return [unit(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _sketch(signs: Signs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [signs.keys(x) for x in _vectors(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["cid", "keys"])

    return run


class Forest:
    """Components of index pairs that come in parts; ``edges`` are those that joined two."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)  # each root is hooked once, under a smaller one
            self.root[high] = np.minimum(a, b)[first]
            self.edges.append(np.stack([i[first], j[first]], axis=1))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def pairs(self) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.int64), *self.edges])


def pairs_in_runs(run: np.ndarray, units: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) inside each run of equal ``run`` (sorted) with cosine at or over the threshold, in parts."""
    n = len(run)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lengths = np.diff(np.r_[starts, n])
    size = np.repeat(lengths, lengths)
    # Runs of one dimension each, but of different ones in a task.
    width = np.array([len(u) for u in units])
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) & (size > 1))
        if not len(rows):
            continue
        x = np.stack([units[i] for i in rows])
        own, few = run[rows], size[rows] <= SHORT
        for s in range(1, SHORT):
            i = np.flatnonzero((own[: len(own) - s] == own[s:]) & few[: len(own) - s])
            if not len(i):
                break
            i = i[np.einsum("ij,ij->i", x[i], x[i + s]) >= threshold]
            yield rows[i], rows[i + s]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]] & ~few)
        for a in first.tolist():
            b = a + int(size[rows[a]])
            for c in range(a, b, ROWS):
                i, j = np.nonzero(x[c : min(b, c + ROWS)] @ x[c:b].T >= threshold)
                up = j > i
                yield rows[c + i[up]], rows[c + j[up]]


def _verify(threshold: float, signs: Signs):
    def links(table: np.ndarray, run: np.ndarray, rows: dict[str, list]) -> pa.RecordBatch:
        cid, n, block = (np.array(rows[k], np.int64) for k in ("cid", "n", "block"))
        split, units = np.array(rows["cross"], bool), rows["v"]
        forest, total = Forest(len(cid)), np.zeros(len(cid), np.int64)
        keys: list[np.ndarray | None] = [None] * len(cid)
        for i, j in pairs_in_runs(run, units, threshold):
            real = ~(split[i] & (block[i] == block[j]))
            i, j = i[real], j[real]
            if not len(i):
                continue
            who, at = np.unique(np.r_[i, j], return_inverse=True)
            for k in who.tolist():
                if keys[k] is None:
                    keys[k] = signs.keys(units[k])
            held = np.stack([keys[k] for k in who.tolist()])
            for t in range(int(table[i].max())):  # pairs that met in an earlier table count there
                new = (held[at[: len(i)], t] != held[at[len(i) :], t]) | (table[i] <= t)
                i, j, at = i[new], j[new], np.r_[at[: len(new)][new], at[len(new) :][new]]
            np.add.at(total, i, n[j])
            np.add.at(total, j, n[i])
            forest.add(i, j)
        who, e = np.flatnonzero(total), forest.pairs()
        no = lambda k: pa.nulls(k, pa.int64())
        cols = [(pa.array(cid[who]), pa.array(cid[e[:, 0]])), (no(len(who)), pa.array(cid[e[:, 1]])), (pa.array(total[who]), no(len(e)))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in cols], ["a", "b", "n"])

    names = ("cid", "n", "block", "cross")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in (*names, "v")}
        key = np.zeros((0, 4), np.int64)
        for b in batches:
            key = np.r_[key, np.stack([b.column(c).to_numpy() for c in ("t", "group", "key", "pair")], axis=1)]
            for k in names:
                held[k] += b.column(k).to_pylist()
            held["v"] += _vectors(b.column("v"))
            if len(key) < 1 << 13:
                continue
            name = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))]
            if cut := int(np.searchsorted(name, name[-1])):
                yield links(key[:cut, 0], name[:cut], {k: v[:cut] for k, v in held.items()})
                key, held = key[cut:], {k: v[cut:] for k, v in held.items()}
        if len(key):
            yield links(key[:, 0], np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))], held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.97, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", hot: int = HOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors of one label (and one dimension) link at cosine ``threshold`` or more; a pair exactly there is found with
    probability ``recall`` at least, a closer one more likely, none below it. n_links counts the other rows linked directly,
    component_id is the smallest id reachable. A null label, and a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing and keeps its own id. Rows that repeat an id are counted one by one; a
    null id is never a smallest one. An empty table gives an empty table; other columns are not read.
    """
    v = F.col("v")
    good = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("good", good)
    one, two = F.xxhash64("label", "v"), F.xxhash64("v", F.lit(seed), "label")
    keyed = rows.withColumn("h1", F.when(F.col("good"), one)).withColumn("h2", F.when(F.col("good"), two))
    classes = keyed.where("good").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    count, rows_of = classes.agg(F.count("*"), F.sum("n")).first()
    bits, tables = table_shape(count, threshold, recall)
    signs = Signs(bits, tables, seed)
    sketched = classes.select("cid", "v").mapInArrow(_sketch(signs), "cid long, keys array<bigint>")
    sketched = materialise(sketched, "sketched")
    classes = classes.withColumn("group", F.xxhash64("label", F.size("v")))
    # Which buckets a class is in, without its vector; buckets of one class drop out before vectors travel.
    dealt = sketched.select("cid", F.posexplode("keys").alias("t", "key")).join(classes.select("cid", "group"), "cid").withColumn("t", F.col("t").cast("long"))
    dealt = materialise(dealt.select("cid", "t", "group", "key"), "dealt")
    groups = dealt.groupBy("t", "group", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / hot).cast("long"))
    met = hub_join(dealt, materialise(groups, "groups"), ["t", "group", "key"], "m", count * tables).withColumn("block", F.pmod(F.xxhash64("cid", "t"), F.col("blocks")))
    met = materialise(met.groupBy("cid").agg(F.collect_list(F.struct("t", "key", "block", "blocks")).alias("in")), "met")
    met = classes.select("cid", "n", "v", "group").join(met, "cid").select("cid", "n", "v", "group", F.explode("in").alias("at")).select("cid", "n", "v", "group", "at.*")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    met = met.select("t", "group", "key", F.explode(pair).alias("pair"), "cid", "n", "v", "block", "blocks").select("t", "group", "key", "pair", "cid", "n", "v", "block", (F.expr("pair div blocks") != F.expr("pair % blocks")).alias("cross"))
    found = met.repartition("t", "group", "key", "pair").sortWithinPartitions("t", "group", "key", "pair").mapInArrow(_verify(threshold, signs), "a long, b long, n long")
    found = materialise(found, "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    linked = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.select("cid", "h1", "h2", "n", "first").join(counts, "cid", "left").join(linked, F.col("cid") == F.col("node"), "left").withColumn("class", F.coalesce("component", "cid"))
    least = named.groupBy("class").agg(F.min("first").alias("low"), F.count("*").alias("members"))
    named = hub_join(named, materialise(least, "least"), "class", "members", count)
    named = materialise(named.select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "low"), "named")
    own = hub_join(keyed.where("good").select("vec_id", "h1", "h2"), named, ["h1", "h2"], "n", rows_of or 0).select("vec_id", "links", "low")
    out = own.unionByName(keyed.where("not good").select("vec_id", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("low")))
    component = F.coalesce("low", "vec_id")
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
