import numpy as np

from tessera.llm import embeddings


def brute(rows, threshold):
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    return [(r[0], links[i], least.get(root(i), r[0])) for i, r in enumerate(rows)]


def made(n_groups=30, size=8, dim=16, spread=0.12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = rng.standard_normal(dim)
        for _ in range(size):
            v = base + spread * rng.standard_normal(dim) * rng.random() * 2
            rows.append((len(rows), v.astype(np.float32).tolist(), g % 3))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, key string").repartition(4)


def test_links_and_components(spark):
    rows = made()
    rows += [rows[3], (900, rows[3][1], 0), (901, [2 * x for x in rows[3][1]], 0), (902, rows[3][1], 1), (None, rows[5][1], 0)]
    rows += [(903, None, 1), (904, [0.0] * 16, 1), (905, [float("nan")] + [1.0] * 15, 1), (906, [None] + [1.0] * 15, 1), (907, rows[0][1], None), (908, [], 1), (909, [1.0, 2.0], 1), (910, [1.0, 2.0], 1), (911, [float("inf")] * 16, 1)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(brute(rows, 0.93), key=key)
    assert max(w[1] for w in want) > 3
    for hot in (2048, 3):
        got = embeddings.near_vectors(frame(spark, rows), recall=0.999999, hot=hot).collect()
        assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_and_precision(spark):
    rows = made(60, 10, 32, 0.17, 4)
    want = {w[0]: w[1] for w in brute(rows, 0.93)}
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame(spark, rows)).collect()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 0


def test_empty(spark):
    assert embeddings.near_vectors(frame(spark, made(1)).limit(0)).count() == 0
