import random

from tessera.llm import substring


def brute(rows, w=13):
    first = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for p in range(len(x) - w + 1):
            if i is not None:
                k = tuple(x[p : p + w])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        x = (t or "").encode().split()
        gone = set()
        for p in range(len(x) - w + 1):
            if i is not None and first[tuple(x[p : p + w])] < i:
                gone.update(range(p, p + w))
        out.append((i, len(x), len(gone), b" ".join(v for j, v in enumerate(x) if j not in gone).decode()))
    return out


def texts(rng, n):
    words = [f"w{i}" for i in range(300)]
    passages = [rng.choices(words, k=rng.choice((12, 13, 14, 30))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        out.append(" \n".join(t))
    return out + out[:5]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(None if i % 17 == 5 else i * 3 % 101, t) for i, t in enumerate(texts(rng, 90))]
    rows += [(7, None), (8, ""), rows[3], rows[3], (200, "long " * 6000), (201, "long " * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, shard int").repartition(4)
    for size in (1 << 20, 12000):
        got = substring.parse(df, block_bytes=size)
        assert got.columns == ["doc_id", "text", "shard", "n_words", "n_removed", "kept", "factors"]
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        have = got.collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in have], key=key) == sorted(brute(rows), key=key)
        by = {}
        for i, t in rows:
            by.setdefault(i, []).append((t or "").split())
        for r in have:
            for f in r.factors:
                assert f.source_id < r.doc_id and f.end - f.start >= 13
                assert any(r.text.split()[f.start : f.end] == x[f.source_start : f.source_start + f.end - f.start] for x in by[f.source_id])


def test_empty(spark):
    assert substring.parse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
