"""Operators against brute force on small fixtures."""

import hashlib
import itertools
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import dynamics, features, graph, indices, model, panel, partitions, stats, validation


def test_weighted_city_and_gates(spark):
    rows = [("a", 1, 20.0, 100), ("b", 1, 100.0, 300), ("a", 2, 20.0, 100)]
    df = spark.createDataFrame(rows, "tid string, m int, total double, pop int").withColumn("city", F.lit("c"))
    got = panel.aggregate_members(df, "city", "tid", "m", ["total"], "pop").collect()
    assert [(r.m, r.total, r["pop"]) for r in got] == [(1, 80.0, 400)]
    static = spark.createDataFrame([("c", 1000.0, 10.0, 0.2, 1.0), ("c", 2000.0, 30.0, 0.8, 3.0), ("c", None, None, 0.9, 1.0)], "city string, wage double, emp double, manuf double, pop double")
    r = panel.aggregate_static(static, "city", ["wage"], "pop", ["manuf"], "emp").first()
    assert r.manuf == pytest.approx(0.65) and r.emp == 40.0 and r.wage == 1750.0
    with pytest.raises(Exception, match="negative other"):
        panel.with_remainder(spark.createDataFrame([(1.0, 2.0)], "t double, p double"), "t", ["p"], "other").collect()
    with pytest.raises(Exception, match="repeated x"):
        panel.strict_pivot(spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "k int, c string, v int"), "k", "c", "v", ["x"]).collect()
    assert panel.repeated_keys(df, ["tid", "m"]).count() == 0
    dim = spark.createDataFrame([(1, 2000, 2010, "old"), (1, 2011, 2014, "new"), (2, 2000, 2030, "on")], "k int, a int, b int, v string")
    assert {r.k: r.v for r in panel.latest_active(dim, "k", "a", "b", 2020).collect()} == {1: "new", 2: "on"}


def test_context_keeps_missing_mass(spark):
    g = features.context_groups([F.col("gov"), F.col("edu"), F.col("ict")], F.col("ok"))
    got = spark.createDataFrame([(0.3, 0.2, None, True), (0.8, 0.4, 0.0, True), (0.1, 0.1, 0.1, False)], "gov double, edu double, ict double, ok boolean").select(g.alias("g")).collect()
    assert got[0].g == pytest.approx([0.3, 0.2, 0.0, 0.5]) and sum(got[1].g) == pytest.approx(1) and got[1].g[3] == 0 and got[2].g is None


def test_scaling_uses_training_rows_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(3).tolist() if i < 7 else [100.0] * 3) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = {r.i: r.x for r in features.scaled(df, "x", 3, train=F.col("i") < 7).collect()}
    x = np.array([r[1] for r in rows[:7]])
    want = np.clip((x - x.mean(0)) / x.std(0), -4, 4) / math.sqrt(3)
    assert np.allclose([got[i] for i in range(7)], want) and np.allclose(got[7], 4 / math.sqrt(3))
    assert features.scaled(spark.createDataFrame([(1, [5.0]), (2, [5.0])], "i int, x array<double>"), "x", 1).first().x == [0.0]


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "q int, id int, x array<double>")
    for metric in ("cosine", "euclid", "correlation"):
        want = {}
        for i in range(40):
            c = (x - x.mean(1, keepdims=True)) if metric == "correlation" else x
            d = [np.linalg.norm(x[i] - x[j]) if metric == "euclid" else 1 - c[i] @ c[j] / np.linalg.norm(c[i]) / np.linalg.norm(c[j]) for j in range(40)]
            want[i] = [j for _, j in sorted((round(float(v), 10), j) for j, v in enumerate(d) if j != i)[:4]]
        for size in (1000, 9):
            got = {}
            for r in graph.nearest(df, "q", "id", "x", 4, metric, size).orderBy("src", "rank").collect():
                got.setdefault(r.src, []).append(r.dst)
            assert got == want
    e = graph.weighted_knn(graph.nearest(df, "q", "id", "x", 4), "q", 4, 1)
    rows = {(r.src, r.dst): r.w for r in e.collect()}
    assert all(rows[b, a] == w for (a, b), w in rows.items()) and np.mean(list(rows.values())) == pytest.approx(1)
    assert {a for a, _ in rows} == set(range(40))


def test_viterbi_is_optimal(spark):
    rng = np.random.default_rng(3)
    d = np.round(rng.random((6, 5, 3)), 3)
    df = spark.createDataFrame([(i, t, d[i, t].tolist()) for i in range(6) for t in range(5)], "tid int, q int, d array<double>")
    for pen in (0.0, 0.2, 5.0):
        got = {}
        for r in model.viterbi(df, "tid", "q", pen, 3).orderBy("tid", "q").collect():
            got.setdefault(r.tid, []).append((r.type, r.cost))
        for i in range(6):
            cost = lambda p: sum(d[i, t, k] for t, k in enumerate(p)) + pen * sum(a != b for a, b in zip(p, p[1:]))
            best = min(itertools.product(range(3), repeat=5), key=cost)
            assert cost([k for k, _ in got[i]]) == pytest.approx(cost(best)) == pytest.approx(got[i][0][1], abs=1e-6)


def test_margin_is_signed(spark):
    r = model.assigned_margin(spark.createDataFrame([([1.0, 4.0, 9.0], 1)], "d array<double>, ty int"), "ty").first()
    assert r.margin == pytest.approx(-0.6) and r.alternative == 0


def test_lag_and_dtw(spark):
    t = np.arange(16)
    s = np.sin(t * 0.7) + 0.01 * t
    shifted = np.r_[0.3, -0.2, s[:-2]]
    df = spark.createDataFrame([(i, int(k), float(v)) for i, x in enumerate((s, shifted)) for k, v in enumerate(x)], "id int, s int, v double")
    r = graph.lag_correlation(df, "id", "s", "v", 3).first()
    assert abs(r.lag) == 2 and r.r > 0.999
    series = spark.createDataFrame([(0, [[float(v)] for v in s]), (1, [[float(v)] for v in shifted]), (2, [[float(-v)] for v in s])], "id int, v array<array<double>>")
    got = {(r.src, r.dst): r.d for r in graph.dtw_pairs(series, "id", "v").collect()}
    acc = np.full((17, 17), np.inf)
    acc[0, 0] = 0
    for i in range(16):
        for j in range(16):
            if abs(i - j) <= 3:
                acc[i + 1, j + 1] = (s[i] - shifted[j]) ** 2 + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    assert got[0, 1] == pytest.approx(math.sqrt(acc[16, 16] / 32)) and got[0, 1] < got[0, 2]


def test_permutations_and_subsamples(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "id int, label int, place int")
    for within in (None, "place"):
        rows = stats.permuted(df, "id", "label", 3, 5, within).collect()
        for rep in (1, 2, 3):
            own = {r.id: r.label for r in rows if r.replicate == rep}
            assert sorted(own.values()) == sorted(i % 3 for i in range(30))
            if within:
                assert sorted(own[i] for i in range(0, 30, 2)) == sorted(i % 3 for i in range(0, 30, 2))
    sub = stats.subsamples(df, "id", 4, 0.8, 1).groupBy("replicate").count().collect()
    assert all(r["count"] == 24 for r in sub) and len(sub) == 4


def test_censored_transitions(spark):
    rows = [("a", t, x, 0.9) for t, x in enumerate([0, 0, 0, 1, 1])] + [("b", t, x, 1.0) for t, x in enumerate([0, 1, 1, 1, 1])]
    got = {r.tid: r for r in stats.transitions(spark.createDataFrame(rows, "tid string, q int, ty int, c double"), "tid", "q", "ty", "c").collect()}
    assert got["a"].censored and not got["a"].persists and not got["a"].robust
    assert got["b"].persists and got["b"].support == 1.0 and got["b"].robust


def test_ward_spectral_mixture(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((12, 3)) * 0.2 + c for c in ([0, 0, 0], [3, 0, 0], [0, 3, 0])])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "q int, id int, x array<double>")
    truth = np.repeat([0, 1, 2], 12)

    def same(rows):
        got = np.array([t for _, t in sorted((r.id, r.type) for r in rows)])
        return all((got[i] == got[j]) == (truth[i] == truth[j]) for i in range(36) for j in range(36))

    assert same(partitions.ward(df, "q", "id", "x", 3).collect())
    e = graph.weighted_knn(graph.nearest(df, "q", "id", "x", 5, "euclid"), "q", 5, 1)
    assert same(partitions.spectral(df, e, "q", "id", 3).collect())
    # A start with one row of each cluster.
    first = lambda salt: sorted(range(36), key=lambda i: hashlib.md5(f"42|{i}{salt}".encode()).hexdigest())[:3]
    salt = next(s for s in map(str, range(99)) if {i // 12 for i in first(s)} == {0, 1, 2})
    key = F.concat(F.col("id").cast("string"), F.lit(salt))
    assert same(partitions.diagonal_mixture(df, "x", 3, 3, key, 8).collect())
    # Ward against the definition: the merge that adds the least within-cluster sum of squares.
    y = rng.standard_normal((9, 2))
    groups = [[i] for i in range(9)]
    sse = lambda g: ((y[g] - y[g].mean(0)) ** 2).sum()
    while len(groups) > 3:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: sse(groups[p[0]] + groups[p[1]]) - sse(groups[p[0]]) - sse(groups[p[1]]))
        groups[a] += groups.pop(b)
    code = partitions._ward(y, 3)
    assert {tuple(sorted(g)) for g in groups} == {tuple(np.flatnonzero(code == c)) for c in range(3)}


def test_spectral_without_a_dense_matrix(spark):
    """The leading vectors of a list of edges are those of the whole matrix, in a part of its memory; so are the types."""
    rng = np.random.default_rng(8)
    n, k = 1500, 5
    x = rng.standard_normal((n, 3)) + 3 * np.eye(3)[np.arange(n) % 3]
    near = ((x[:, None] - x[None]) ** 2).sum(2).argsort(1)[:, 1:7]
    key = np.unique(np.r_[(np.arange(n)[:, None] * n + near).ravel(), (near * n + np.arange(n)[:, None]).ravel()])
    src, dst = key // n, key % n
    w = 1 / (1e-3 + np.sqrt(((x[src] - x[dst]) ** 2).sum(1)))
    a = np.zeros((n, n))
    a[src, dst] = w
    d = np.sqrt(a.sum(1))
    want = np.linalg.eigh(a / d[:, None] / d[None, :])[1][:, -k:]
    tracemalloc.start()
    got = partitions._leading(src, dst, w, n, k)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.linalg.svd(want.T @ got)[1].min() > 1 - 1e-6 and most < 8 * n * n
    # More components than vectors: orthonormal, the same direction for all of a component.
    far = np.repeat(np.arange(0, 600, 2), 2)
    many = partitions._leading(far + np.tile([0, 1], 300), far + np.tile([1, 0], 300), np.ones(600), 601, k)
    assert np.allclose(many.T @ many, np.eye(k)) and np.allclose(many[0:600:2], many[1:600:2]) and not many[600].any()
    nodes = spark.createDataFrame([(0, i) for i in range(n)], "q int, id int")
    edges = spark.createDataFrame(pd.DataFrame({"q": 0, "src": src, "dst": dst, "w": w}))
    types = [[r.type for r in partitions.spectral(nodes, edges, "q", "id", k, dense).orderBy("id").collect()] for dense in (0, n)]
    assert len(types[0]) == n and types[0] == types[1]


def test_diffusion_of_repeated_edges_in_many_blocks(spark):
    """Neighbours count once however often their edge comes, and in all blocks of either side."""
    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2)) if a != b], "src long, dst long")
    labels = spark.createDataFrame([(i, t, int(v)) for i in range(60) for t, v in enumerate(rng.integers(0, 3, 6)) if (i + t) % 7], "id long, t int, ty int")
    rows = lambda df: sorted(((r["from"], r.to, r.n, round(r.seen, 9), round(r.expected, 9), r.z and round(r.z, 6)) for r in df.collect()), key=str)
    want = rows(dynamics.diffusion(edges.distinct(), labels, "id", "t", "ty"))
    assert len(want) == 7 and rows(dynamics.diffusion(edges, labels, "id", "t", "ty")) == want
    ids = {r.id for r in labels.collect()}
    have = {(r.id, r.t): r.ty for r in labels.collect()}
    pairs = {(r.src, r.dst) for r in edges.collect()}
    for size, right in ((1024, 16384), (16, 16)):
        got = {(r.src, r.t): list(r.ks) for r in dynamics._neighbour_counts(edges, labels.select(F.col("id").alias("dst"), "t", F.col("ty").alias("to")), "t", "to", [0, 1, 2], size, right).collect()}
        assert got == {(i, t): k for i in ids for t in range(6) if sum(k := [sum(have.get((b, t)) == v for a, b in pairs if a == i) for v in range(3)])}


def test_communities_and_rewiring(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, j) for i in range(30) for j in range(i) if rng.random() < (0.7 if i // 10 == j // 10 else 0.04)]
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    e = spark.createDataFrame(rows, "src int, dst int, w double").persist()
    got = {r.node: r.type for r in partitions.communities(e).collect()}
    labels = spark.createDataFrame([(i, i // 10, got[i]) for i in range(30)], "id int, a int, b int")
    assert indices.adjusted_rand(labels, "a", "b").first().ARI > 0.8
    assert indices.graph_vertex(e, labels, "id", "b").first().Q > 0.3
    assert partitions.calibrated(e, 3, rounds=6, ways=4, depth=1) < partitions.calibrated(e, 25, rounds=6, ways=4, depth=1)
    two = labels.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select("id", "v", F.when(F.col("v") == 0, F.col("a")).otherwise(F.col("id") % 2).alias("c"))
    for f in (indices.graph_vertex, indices.graph_blocks):
        by = {r.v: r for r in f(e, two, "id", "c", ["v"]).collect()}
        both = {r.v: r for r in f(e.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))), two, "id", "c", ["v"]).collect()}
        for v in (0, 1):
            one = f(e, two.where(f"v = {v}"), "id", "c").first().asDict()
            assert all(by[v][c] == pytest.approx(x, abs=1e-12) and both[v][c] == pytest.approx(x, abs=1e-12) for c, x in one.items())
    points = labels.withColumn("x", F.array(F.col("a").cast("double"), (F.col("id") % 7).cast("double")))
    whole = indices.all_indices(points, e, "id", "x", "a", 2).first()
    assert set(whole.asDict()) == set(indices.DIRECTION) and whole.SW == pytest.approx(indices.silhouette(points, "id", "x", "a").first().SW)
    alone = indices.all_indices(points.withColumn("a", F.lit(0)), e, "id", "x", "a", 2).first()
    assert alone.SW is None and alone.CH is None and alone.S_Dbw is None and alone.AVI == pytest.approx(1.0)
    layers = e.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2))))
    both = partitions.multilayer(layers, "q", 0.5).groupBy("node").agg(F.countDistinct("type").alias("n")).where("n > 1").count()
    assert both <= 3
    degree = {r.src: r.n for r in e.groupBy("src").agg(F.count("*").alias("n")).collect()}
    for rep in (1, 2):
        r = partitions.rewired(e, 2, 1).where(f"replicate = {rep}").collect()
        assert len({(x.src, x.dst) for x in r}) == len(rows) and all(x.src != x.dst for x in r)
        assert {s: sum(x.src == s for x in r) for s in degree} == degree
        assert {(x.src, x.dst) for x in r} != {(a, b) for a, b, _ in rows}


def test_null_beats_chance(spark):
    rng = np.random.default_rng(6)
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)], "id int, label int")
    score = spark.createDataFrame([(float(rng.normal()),) for _ in range(19)], "v double")
    r = stats.null_score(spark.createDataFrame([(9.0,)], "v double"), score, "v", 1).first()
    assert r.p == pytest.approx(1 / 20) and r.z > 3 and labels.count() == 60


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 2))
    y = x @ [1.0, -2.0] + 0.5 + 0.1 * rng.standard_normal(80)
    fold = np.arange(80) % 4
    df = spark.createDataFrame([(float(b), *map(float, a), int(f)) for a, b, f in zip(x, y, fold)], "y double, a double, b double, f int")
    got = {r.fold: r for r in validation.ridge_cv(df, "y", ["a", "b"], "f", alpha=10.0).collect()}
    for f in range(4):
        t = fold != f
        xc, yc = x[t] - x[t].mean(0), y[t] - y[t].mean()
        w = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc)
        e = np.abs(y[~t] - (x[~t] - x[t].mean(0)) @ w - y[t].mean()).mean()
        assert got[f].mae == pytest.approx(e, rel=1e-9) and got[f].n == 20


def test_threshold_tree_and_planted(spark):
    rows = validation.planted(spark, 120, 3, 2, 4, 5, migrants=0.2, event=1, noise=0.3).persist()
    again = {(r.id, r.t): r.truth for r in validation.planted(spark, 120, 3, 2, 4, 5, migrants=0.2, event=1, noise=0.3).collect()}
    assert again == {(r.id, r.t): r.truth for r in rows.collect()}
    moved = sum(again[i, 0] != again[i, 1] for i in range(120))
    assert 10 <= moved <= 40
    centers = {k: [2.0 if i == k else 0.0 for i in range(4)] for k in range(3)}
    tree = validation.threshold_tree(rows, "x", 4, "truth", centers, 19)
    assert len(tree) == 2 and sum(m for *_, m in tree) <= 12
    leaf = rows.select("truth", validation.tree_type("x", tree, centers).alias("leaf")).collect()
    assert sum(r.truth != r.leaf for r in leaf) <= sum(m for *_, m in tree)


def test_within_effects_by_least_squares(spark):
    from tessera.operators import dynamics

    rng = np.random.default_rng(8)
    n = 120
    g, t, z = rng.integers(0, 5, n), rng.integers(0, 3, n), rng.standard_normal(n)
    y = g + 0.8 * t + 0.5 * z + rng.standard_normal(n)
    df = spark.createDataFrame([(int(i), int(a), int(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(g, t, z, y))], "id int, g int, t int, z double, y double")
    r = dynamics.within_effects(df, "id", "y", "t", "g", ["z"], 19, 3).first()

    def adjusted(*blocks):
        x = np.column_stack([np.eye(5)[g], *blocks])
        rss = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
        return 1 - rss / (n - np.linalg.matrix_rank(x)) / (y.var() * n / (n - 1))

    types = np.eye(3)[t][:, 1:]
    assert r.gain == pytest.approx(adjusted(types) - adjusted()) and r.controlled == pytest.approx(adjusted(types, z) - adjusted(z))
    assert 1 / 20 <= r.p <= 0.15


def test_lifecycle_and_uncertainty(spark):
    from tessera.operators import dynamics

    rows = [(i, 0, 0 if i < 6 else 1) for i in range(10)] + [(i, 1, 0 if i < 3 else 2 if i < 6 else 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, q int, ty int")
    got = {(r["from"], r.to): r.event for r in dynamics.lifecycle(df, "id", "q", "ty").collect()}
    assert got == {(0, 0): "split", (0, 2): "split", (1, 1): "stays"}
    u = {r.id: r for r in dynamics.uncertainty(df, "id", "ty").collect()}
    assert u[0].modal == 0 and u[0].share == 1.0 and not u[0].borderline
    assert u[4].modal == 0 and u[4].second == 2 and u[4].borderline


def test_interpolation_ends(spark):
    from tessera.functions import scalar

    got = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 11.0, None)], "v double").select(scalar.interpolate(F.col("v"), [(0.0, 1.0), (10.0, 3.0)]).alias("y")).collect()
    assert [r.y for r in got] == [1.0, 1.0, 2.0, 3.0, 3.0, None]
