"""Quality of a partition: feature indices, graph indices (vertex and block level), agreement of two partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S

from .graph import block_pairs

#: Whether larger is better.
DIRECTION = {"SW": 1, "CH": 1, "S_Dbw": -1, "AVI": 1, "AVU": -1, "ANUI": 1, "MQ": 1, "Q": 1, "AVI_ref": 1, "AVU_ref": -1, "ANUI_ref": 1, "MQ_ref": 1}


def silhouette(df: DataFrame, entity: str, vector: str, label: str) -> DataFrame:
    """One row, ``SW``: mean euclidean silhouette; 0 for members of a cluster of one. Distances are summed by blocks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"e": [], "own": [], "other": [], "s": []})
        a, b = np.stack(left[vector].to_numpy()).astype(float), np.stack(right[vector].to_numpy()).astype(float)
        names, code = np.unique(right[label].to_numpy(), return_inverse=True)
        own, other, hot, parts = left[entity].to_numpy(), right[entity].to_numpy(), np.eye(len(names))[code], []
        for at in range(0, len(a), 256):
            x = a[at : at + 256]
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * x @ b.T, 0))
            d[own[at : at + 256, None] == other[None, :]] = 0
            parts.append(d @ hot)
        sums = np.concatenate(parts)
        n, k = sums.shape
        return pd.DataFrame({"e": np.repeat(left[entity].to_numpy(), k), "own": np.repeat(left[label].to_numpy(), k), "other": np.tile(names, n), "s": sums.ravel()})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (entity, label)}
    parts = block_pairs(df.withColumn("all_", F.lit(0)), "all_", entity, [vector, label], run, f"e {kinds[entity]}, own {kinds[label]}, other {kinds[label]}, s double", 8192)
    sums = parts.groupBy("e", "own", "other").agg(F.sum("s").alias("s"))
    sizes = df.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    same = F.col("own") == F.col("other")
    each = sums.join(sizes, "other").groupBy("e").agg(
        F.max(F.when(same, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"), F.max(F.when(same, F.col("n"))).alias("n")
    )
    return each.agg(F.avg(F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).alias("SW"))


def calinski_harabasz(df: DataFrame, vector: str, label: str, size: int) -> DataFrame:
    """One row, ``CH``, from the moments of each cluster; null unless 1 < K < n."""
    x = [F.col(vector)[i] for i in range(size)]
    own = df.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("m"), S.array_sum(F.array(*[F.var_pop(c) for c in x])).alias("v"))
    whole = df.agg(F.array(*[F.avg(c) for c in x]).alias("mu"))
    between = F.sum(F.col("n") * S.squared_distance(F.col("m"), F.col("mu")))
    one = own.crossJoin(F.broadcast(whole)).agg(between.alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return one.select(F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("CH"))


def s_dbw(df: DataFrame, vector: str, label: str, size: int) -> DataFrame:
    """One row, ``S_Dbw``: scatter plus density between clusters. The K centres are broadcast; points meet them once."""
    x = [F.col(vector)[i] for i in range(size)]
    norm = lambda a: F.sqrt(S.dot(a, a))
    own = df.groupBy(label).agg(F.array(*[F.avg(c) for c in x]).alias("m"), norm(F.array(*[F.var_pop(c) for c in x])).alias("v"))
    whole = df.agg(norm(F.array(*[F.var_pop(c) for c in x])).alias("v0"))
    scat = own.agg(F.avg("v").alias("mean_v"), (F.sqrt(F.sum("v")) / F.count("*")).alias("std"), F.count("*").alias("k")).crossJoin(whole)
    a, b = own.select(F.col(label).alias("i"), F.col("m").alias("mi")), own.select(F.col(label).alias("j"), F.col("m").alias("mj"))
    points = df.select(F.col(label).alias("i"), F.col(vector).alias("x")).join(F.broadcast(a), "i").crossJoin(F.broadcast(b)).crossJoin(F.broadcast(scat.select("std")))
    middle = F.zip_with("mi", "mj", lambda p, q: (p + q) / 2)
    near = points.groupBy("i", "j").agg(F.sum((F.sqrt(S.squared_distance(F.col("x"), F.col("mi"))) <= F.col("std")).cast("int")).alias("own"), F.sum((F.sqrt(S.squared_distance(F.col("x"), middle)) <= F.col("std")).cast("int")).alias("mid"))
    swap = near.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("own").alias("own2"), F.col("mid").alias("mid2"))
    dens = near.where("i <> j").join(swap, ["i", "j"]).agg(F.sum((F.col("mid") + F.col("mid2")) / F.greatest("own", "own2", F.lit(1))).alias("t"))
    return scat.crossJoin(dens).select((F.col("mean_v") / F.col("v0") + F.col("t") / (F.col("k") * (F.col("k") - 1))).alias("S_Dbw"))


def _labelled(edges: DataFrame, labels: DataFrame, entity: str, label: str, by: list[str]) -> DataFrame:
    """Edges without loops, larger weight of both directions, with the labels of both ends. Either frame may lack ``by``."""
    of_edges, of_labels = [c for c in by if c in edges.columns], [c for c in by if c in labels.columns]
    both = edges.where("src <> dst").select(*of_edges, "src", "dst", "w")
    both = both.unionByName(both.select(*of_edges, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy(*of_edges, "src", "dst").agg(F.max("w").alias("w"))
    ends = [labels.select(*of_labels, F.col(entity).alias(e), F.col(label).alias(c)) for e, c in (("src", "a"), ("dst", "b"))]
    return both.join(ends[0], [*[c for c in of_labels if c in of_edges], "src"]).join(ends[1], [*of_labels, "dst"])


def _met(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    shared = [c for c in by if c in a.columns and c in b.columns]
    return a.join(b, shared, how) if shared else a.crossJoin(b)


def graph_vertex(edges: DataFrame, labels: DataFrame, entity: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each value of ``by`` with an edge: AVI, AVU, ANUI over vertices with an edge, MQ and Q over clusters."""
    by = by or []
    e = _labelled(edges, labels, entity, label, by)
    of_labels = [c for c in by if c in labels.columns]
    k = labels.select(*of_labels, label).distinct().groupBy(*of_labels).agg(F.count("*").alias("k"))
    into = e.groupBy(*by, "src", "a", "b").agg(F.sum("w").alias("w"))
    each = into.groupBy(*by, "src").agg(F.sum("w").alias("deg"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("own"), F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.col("w"))), F.lit(0.0)).alias("out")).where("deg > 0")
    vertex = each.groupBy(*by).agg(F.coalesce(F.avg(F.col("own") / F.col("deg")), F.lit(0.0)).alias("AVI"), F.coalesce(F.avg(F.col("out") / F.col("deg")), F.lit(0.0)).alias("u"))
    blocks = e.groupBy(*by, "a").agg(F.sum("w").alias("tot"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)).alias("own"))
    m2 = blocks.groupBy(*by).agg(F.sum("tot").alias("m2"))
    cluster = _met(blocks, m2, by).groupBy(*by).agg(F.sum(F.col("own") / F.greatest("tot", F.lit(1e-12))).alias("MQ"), F.sum(F.col("own") / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)).alias("Q"))
    avu = F.when(F.col("k") > 1, F.col("u")).otherwise(0.0)
    return _met(_met(vertex, cluster, by), k, by).select(*by, "AVI", avu.alias("AVU"), F.when(F.col("AVI") > 0, 1 / (avu + 1 / F.col("AVI"))).otherwise(0.0).alias("ANUI"), F.coalesce("MQ", F.lit(0.0)).alias("MQ"), F.coalesce("Q", F.lit(0.0)).alias("Q"))


def graph_blocks(edges: DataFrame, labels: DataFrame, entity: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each value of ``by`` with an edge: the same family over pairs of clusters, AVI_ref, AVU_ref, ANUI_ref, MQ_ref."""
    by = by or []
    s = _labelled(edges, labels, entity, label, by).groupBy(*by, "a", "b").agg(F.sum("w").alias("s"))
    codes = labels.select(*[c for c in by if c in labels.columns], F.col(label).alias("a")).distinct()
    row = s.groupBy(*by, "a").agg(F.sum("s").alias("tot"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))), F.lit(0.0)).alias("own"))
    k = codes.groupBy(*[c for c in by if c in labels.columns]).agg(F.count("*").alias("k"))
    share = F.coalesce(F.try_divide("own", "tot"), F.lit(0.0))
    mean = row.groupBy(*by).agg(F.sum(share).alias("MQ_ref"))
    out = row.select(*by, "a", (F.col("tot") - F.col("own")).alias("out"))
    den = F.col("out") + F.col("inn") - F.col("s")
    pair = s.where("a <> b").join(out, [*by, "a"]).join(out.select(*by, F.col("a").alias("b"), F.col("out").alias("inn")), [*by, "b"]).groupBy(*by).agg(F.sum(F.try_divide(F.col("s"), den)).alias("p"))
    own = _met(_met(mean, k, by), pair, by, "left").select(*by, F.coalesce("MQ_ref", F.lit(0.0)).alias("MQ_ref"), "k", F.coalesce("p", F.lit(0.0)).alias("p"))
    avi, avu = F.col("MQ_ref") / F.col("k"), F.col("p") / F.col("k")
    return own.select(*by, avi.alias("AVI_ref"), avu.alias("AVU_ref"), F.when(avi > 0, 1 / (avu + 1 / avi)).otherwise(0.0).alias("ANUI_ref"), "MQ_ref")


def graph_family(src: np.ndarray, dst: np.ndarray, w: np.ndarray, label: np.ndarray, k: int) -> dict[str, float]:
    """The indices of ``graph_vertex`` and ``graph_blocks`` of one graph in memory: ends are rows of ``label``, codes under ``k``."""
    n, kept = len(label), src != dst
    key = np.concatenate([(src * n + dst)[kept], (dst * n + src)[kept]])
    order = np.argsort(key, kind="stable")
    key, w = key[order], np.concatenate([w[kept], w[kept]])[order]
    first = np.r_[0, np.nonzero(np.diff(key))[0] + 1]
    src, dst, w = key[first] // n, key[first] % n, np.maximum.reduceat(w, first)
    into = np.bincount(src * k + label[dst], w, n * k).reshape(n, k)
    deg, own = into.sum(1), into[np.arange(n), label]
    other = into.copy()
    other[np.arange(n), label] = 0
    on = deg > 0
    avi, u = float((own[on] / deg[on]).mean()), float((other.max(1)[on] / deg[on]).mean())
    s = np.bincount(label[src] * k + label[dst], w, k * k).reshape(k, k)
    tot, inner, m2 = s.sum(1), np.diag(s), s.sum()
    share = np.divide(inner, tot, out=np.zeros(k), where=tot > 0)
    out = tot - inner
    den = out[:, None] + out[None, :] - s
    p = float(np.divide(s, den, out=np.zeros((k, k)), where=(s > 0) & (den != 0) & ~np.eye(k, dtype=bool)).sum())
    nui = lambda a, v: 1 / (v + 1 / a) if a > 0 else 0.0
    avu, mq = u if k > 1 else 0.0, float(share.sum())
    return {"AVI": avi, "AVU": avu, "ANUI": nui(avi, avu), "MQ": float((inner / np.maximum(tot, 1e-12)).sum()), "Q": float((inner / m2 - (tot / m2) ** 2).sum()), "AVI_ref": mq / k, "AVU_ref": p / k, "ANUI_ref": nui(mq / k, p / k), "MQ_ref": mq}


def all_indices(df: DataFrame, edges: DataFrame, entity: str, vector: str, label: str, size: int) -> DataFrame:
    """One row of all twelve indices. Those of features are null unless 1 < K < n."""
    n = df.agg(F.countDistinct(label).alias("k"), F.count("*").alias("n")).select(((F.col("k") > 1) & (F.col("k") < F.col("n"))).alias("valid"))
    got = n.crossJoin(silhouette(df, entity, vector, label)).crossJoin(calinski_harabasz(df, vector, label, size)).crossJoin(s_dbw(df, vector, label, size))
    got = got.select(*[F.when(F.col("valid"), F.col(c)).alias(c) for c in ("SW", "CH", "S_Dbw")])
    return got.crossJoin(graph_vertex(edges, df, entity, label)).crossJoin(graph_blocks(edges, df, entity, label))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``ARI`` of two labels, for each value of ``by``; 1 where both partitions are trivial."""
    by = by or []
    cells = df.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    one = lambda c: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias(f"s_{c}"), F.sum("n").alias(f"t_{c}"))
    both = cells.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("s"))
    met = both.join(one(a), by).join(one(b), by) if by else both.crossJoin(one(a)).crossJoin(one(b))
    expected = F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), _pairs(F.col(f"t_{a}")))
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return met.select(*by, F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("ARI"))


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """``NMI``, by the arithmetic mean of the entropies; 1 where both are 0."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    entropy = lambda cols, name: (cells.groupBy(*cols).agg(F.sum("n").alias("n")).crossJoin(total).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias(name)))
    met = entropy([a], "ha").crossJoin(entropy([b], "hb")).crossJoin(entropy([a, b], "hab"))
    return met.select(F.coalesce(F.try_divide(2 * (F.col("ha") + F.col("hb") - F.col("hab")), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("NMI"))


def cluster_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each code of ``a``: Jaccard with the same code of ``b``, and the largest with any."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ta, tb = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    j = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return cells.join(ta, a).join(tb, b).groupBy(a).agg(F.coalesce(F.max(F.when(F.col(a) == F.col(b), j)), F.lit(0.0)).alias("same"), F.max(j).alias("best"))


__all__ = ["DIRECTION", "adjusted_rand", "all_indices", "calinski_harabasz", "cluster_jaccard", "graph_blocks", "graph_vertex", "normalised_mutual_information", "s_dbw", "silhouette"]
