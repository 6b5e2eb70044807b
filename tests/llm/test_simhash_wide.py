import random

import numpy as np

from tessera.llm import simhash_wide


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_fingerprint_distance_follows_similarity():
    rng = random.Random(4)
    gaps = {}
    for edits in (0, 4, 80):
        ds = []
        for _ in range(20):
            a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
            b = list(a)
            for i in rng.sample(range(400), edits):
                b[i] = "x"
            x, y = (np.frombuffer(simhash_wide.wide_fingerprint(" ".join(t).encode(), 5), np.uint8) for t in (a, b))
            ds.append(int(np.unpackbits(x ^ y).sum()))
        gaps[edits] = np.mean(ds)
    assert gaps[0] == 0 and gaps[4] < 40 < gaps[80]
    radius, bits, tables = simhash_wide.settings(10**6, 0.8)
    assert 38 < radius < 46 and 1 - (1 - simhash_wide.agreement(0.8) ** bits) ** tables >= 0.95


def corpus():
    rng = random.Random(6)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(g % 4):
            t = list(base)
            for i in rng.sample(range(300), 2):
                t[i] = "changed"
            rows.append((len(rows), " ".join(t)))
    return rows


def test_one_of_each_group_stays(spark):
    rows = corpus()
    extra = [(1000, None), (1001, ""), (1002, " \n"), rows[0], rows[0], (None, rows[3][1]), (None, "alone here now"), (None, "alone here now"), (1003, "long " * 40000)]
    df = spark.createDataFrame([(*r, "en", 7, "k") for r in rows + extra], "doc_id long, text string, r string, k1 int, act string").repartition(5)
    # Brute force: components at the exact similarity; pairs here are far over or far under it.
    texts = sorted({t or "" for _, t in rows + extra})
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
            if s >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, t in rows + extra:
        k = root(texts.index(t or ""))
        low[k] = min(low.get(k, (True, 0)), (i is None, i or 0))
    want = sorted((none, i) for none, i in low.values())
    for hot in (8192, 2):
        got = simhash_wide.one_of_each(df, hot=hot)
        assert got.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert simhash_wide.one_of_each(df.limit(0)).count() == 0


def test_links_have_the_similarity_and_are_found(spark):
    """Two texts of shared and own words: (shared - 4) / (shared - 4 + 2 own) of their shingles are equal."""
    rng = random.Random(8)
    rows, sizes = [], {0.7: (424, 90), 0.75: (364, 60), 0.8: (404, 50)}
    for similarity, (shared, own) in sizes.items():
        for _ in range(150):
            w = [f"w{rng.randrange(10**9)}" for _ in range(shared + 2 * own)]
            a, b = " ".join(w[: shared + own]), " ".join(w[:shared] + w[shared + own :])
            x, y = shingles(a), shingles(b)
            assert len(x & y) / len(x | y) == similarity
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in simhash_wide.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    gone = [sum(i not in kept for i in range(at, at + 300)) for at in (0, 300, 600)]
    assert gone[:2] == [0, 0] and gone[2] >= 138
    for n in (10**3, 10**6, 10**8):
        _, bits, tables = simhash_wide.settings(n, 0.8)
        assert simhash_wide.recall(0.8, simhash_wide.reach(0.8), bits, tables) >= 0.95


def test_links_that_no_spanning_pair_shows(spark):
    """Versions of one text in a crowd, judged against all pairs."""
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        for _ in range(40):
            at, n = rng.randrange(250), rng.randrange(10, 45)
            rows.append((len(rows), " ".join(base[:at] + [f"x{rng.randrange(10**9)}" for _ in range(n)] + base[at + n :])))
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    got = {r.doc_id for r in simhash_wide.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(set(up) - got) == 0 and len(got - set(up)) <= 2


def test_recall_and_precision_about_the_similarity(spark):
    """Pairs of texts at similarities of 0.75 to 0.85: at least nine in ten of those at 0.8 or more lose one, the others none."""
    rng = random.Random(77)
    rows, at = [], {}
    for i in range(240):
        words = [f"{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        other = list(words)
        for k in sorted(rng.sample(range(40), rng.randint(3, 6))):
            other[5 * k + 2] = f"x{rng.randrange(10**6)}"  # changes five shingles
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = (simhash_wide.shingle_set(t.encode(), 5) for _, t in rows[-2:])
        both = len(np.intersect1d(a, b))
        at[i] = both / (len(a) + len(b) - both)
    assert min(at.values()) < 0.78 and max(at.values()) > 0.83
    kept = {r.doc_id for r in simhash_wide.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    found = {i for i in at if not {2 * i, 2 * i + 1} <= kept}
    near = {i for i, s in at.items() if s >= 0.8}
    assert found <= near and len(found) >= 0.9 * len(near)


def test_parts_meet_by_their_sets():
    """Against all pairs: the links join what the pairs at the similarity join, and no other."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        sets = [np.unique(rng.choice(60, rng.integers(20, 40)).astype(np.uint64)) for _ in range(24)]
        fp, part = np.zeros((24, simhash_wide.WORDS), np.uint64), rng.integers(0, 9, 24)
        got = simhash_wide.between(fp, sets, part, 4, 0.5)
        assert all(simhash_wide.similar(sets[i], sets[j], 0.5) for i, j in got)
        ends = lambda pairs: classes(24, [*pairs, *((i, j) for i in range(24) for j in range(i) if part[i] == part[j])])
        assert ends(got) == ends([(i, j) for i in range(24) for j in range(i) if simhash_wide.similar(sets[i], sets[j], 0.5)])


def classes(n, pairs):
    up = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    return up
