import numpy as np
from pyspark.sql import functions as F

from tessera.llm import sharding


def place(spark, n, shards, per=50, seed=7):
    df = spark.createDataFrame([(None if i % 3 == 0 else i, "same" if i % 2 else None) for i in range(n)], "doc_id long, shard string").repartition(7)
    return sharding.shard(df.withColumnRenamed("shard", "s"), shards, seed, per).collect()


def test_sizes_and_slots(spark):
    for n in (1, 39, 41, 2003):
        rows = place(spark, n, 40)
        assert len(rows) == n
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        sizes = [len(by.get(s, [])) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, slot string, id int, r int, p int")
    out = sharding.shard(df, 4)
    assert out.count() == 0 and out.columns == ["doc_id", "id", "r", "p", "shard", "slot"]
    out = sharding.shard(spark.createDataFrame([(1, "x", 2, 3, 4)] * 5, "doc_id long, slot string, id int, r int, p int"), 4)
    assert sorted(r.shard for r in out.collect()) == [0, 0, 1, 2, 3]


def test_hypergeometric_follows_its_law(spark):
    n, g, t, draws = 40, 30, 100, 20000
    u = (F.col("id") + 0.5) / draws
    got = spark.range(draws).select(sharding.hypergeometric(F.lit(n), F.lit(g), F.lit(t), u).alias("k"))
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    from math import comb

    for k in range(g + 1):
        want = comb(g, k) * comb(t - g, n - k) / comb(t, n)
        assert abs(counts.get(k, 0) / draws - want) < 2 / draws + 1e-9


def test_shuffle_is_even(spark):
    rows = place(spark, 4000, 4)
    shard = np.array([r.shard for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)])
    first = np.bincount(shard[: len(shard) // 2], minlength=4) / (len(shard) / 2)
    assert abs(first - 0.25).max() < 0.05


def test_matrix_follows_the_joint_law(spark):
    """Rows 2, 1 and 2 over columns 2 and 3: each of the matrices as often as a uniform permutation makes it."""
    from itertools import permutations

    n = 6000
    df = spark.range(n).select(F.col("id").alias("key"), F.expr("array(named_struct('p', 0L, 'n', 2L), named_struct('p', 1L, 'n', 1L), named_struct('p', 2L, 'n', 2L))").alias("rows"), F.expr("array(2L, 3L)").alias("cols"))
    got = sharding.communication_matrix(df, "rows", "cols", "key", 3).select(F.transform("matrix", lambda m: m["to"]).alias("m"))
    seen = {tuple(tuple(x) for x in r.m): r["count"] / n for r in got.groupBy("m").count().collect()}
    want, of = {}, [0, 0, 1, 2, 2]
    for order in permutations(range(5)):
        m = [[0, 0], [0, 0], [0, 0]]
        for at, i in enumerate(order):
            m[of[i]][at >= 2] += 1
        key = tuple(map(tuple, m))
        want[key] = want.get(key, 0) + 1 / 120
    assert set(seen) == set(want) and all(abs(seen[k] - want[k]) < 0.025 for k in want)


def test_tree_of_any_fan(spark):
    """Three levels: every partition's rows are dealt whole, and each shard has its size."""
    df = spark.range(700).withColumnRenamed("id", "doc_id")
    for fan in (2, 5, 100):
        rows = sharding.shard(df, 6, rows_per_part=40, fan=fan).collect()
        assert sorted(r.doc_id for r in rows) == list(range(700))
        assert sorted(np.bincount([r.shard for r in rows]).tolist()) == [116, 116, 117, 117, 117, 117]


def test_texts_travel_with_clashing_columns(spark):
    rows = [(i, f"text {i} " * (i % 50), "shard?", 3.5, [i]) for i in range(300)] + [(7, None, None, None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard string, u double, ends array<long>")
    out = sharding.shard(df, 7, rows_per_part=30)
    assert out.columns == ["doc_id", "text", "u", "ends", "shard", "slot"]
    got = [(r.doc_id, r.text, r.u, tuple(r.ends or ())) for r in out.collect()]
    key = lambda x: (x[0], x[1] or "")
    assert sorted(got, key=key) == sorted([(i, t, u, tuple(e or ())) for i, t, _, u, e in rows], key=key)
