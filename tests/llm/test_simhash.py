import random

import numpy as np
import xxhash

from tessera.llm import simhash


def brute(fps, radius):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def planted(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return np.array(out, np.uint64)


def test_links_in_runs_span_classes():
    rng = random.Random(1)
    for size, radius in ((3, 4), (40, 4), (200, 2), (30, 0), (25, 7)):
        fp = planted(rng, 6, size, 5)
        run = np.sort(np.array([rng.randint(0, 2) for _ in fp]))
        links = simhash.links_in_runs(run, fp, radius)
        for i, j in links:
            assert run[i] == run[j] and bin(int(fp[i]) ^ int(fp[j])).count("1") <= radius
        want = {}
        for r in set(run.tolist()):
            at = np.flatnonzero(run == r)
            for i, c in zip(at, brute(fp[at], radius)):
                want[i] = at[c]
        got = list(range(len(fp)))

        def root(x):
            while got[x] != x:
                x = got[x]
            return x

        for i, j in links:
            a, b = root(i), root(j)
            got[max(a, b)] = min(a, b)
        assert all(root(i) == want[i] for i in range(len(fp)))


def test_fingerprint_by_definition():
    text = "A b\tC d é  f A b C D".encode()
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text, 4) == want
    assert simhash.fingerprint(b" \n", 4) == 0
    assert simhash.fingerprint(b"One", 4) == xxhash.xxh64_intdigest(b"one", 42)


def test_near_duplicates_whole(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        t = rng.choices(words, k=300)
        texts.append(" ".join(t))
        for _ in range(3):
            u = list(t)
            u[rng.randrange(300)] = "x"
            texts.append(" ".join(u))
    texts += [None, "", "same", "same", "long " * 50000]
    rows = [(i if i != 5 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, fingerprint int").repartition(5)
    got = simhash.near_duplicates(df, 4, 4).collect()
    assert len(got) == len(rows) + 2
    fps = sorted({r.fingerprint for r in got})
    c = brute(np.array(fps, np.int64).view(np.uint64), 4)
    least = {}
    for r in got:
        k = c[fps.index(r.fingerprint)]
        if r.doc_id is not None:
            least[k] = min(least.get(k, 1 << 60), r.doc_id)
    assert all(r.component_id == least.get(c[fps.index(r.fingerprint)]) for r in got)
    assert simhash.near_duplicates(df.limit(0), 4, 4).count() == 0


def test_hot_keys_are_split(spark):
    rng = random.Random(5)
    fp = np.unique(np.r_[planted(rng, 4, 60, 3), planted(rng, 100, 1, 0)])
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fingerprint long")
    from tessera.llm.components import connected_components

    comp = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, 4, hot=16)).collect()}
    c = brute(fp, 4)
    groups = {}
    for x, k in zip(fp.view(np.int64).tolist(), c):
        groups.setdefault(k, []).append(x)
    for xs in groups.values():
        assert {comp.get(x, x) for x in xs} == {min(xs)}


def test_keys_grow_with_the_table():
    assert simhash.spare_blocks(10**6, 4) == 2
    for n in (10**9, 10**10, 10**11, 10**12):
        spare = simhash.spare_blocks(n, 4)
        assert n <= simhash.CROWD << (64 * spare // (4 + spare)) and spare <= 8
