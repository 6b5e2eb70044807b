import random
import re
import time

from tessera.llm import pii


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def samples():
    rng = random.Random(9)
    parts = ["a", "é", "😀", " ", "\n", "@", ".", "..", "-", "+", "a@b.c", "x.y@z-1.co.uk", "@a.b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (555) 555-1234", "+12", "+1 555", "00.00.000.0000", "٣", "12", "()", "%"]
    return ["", "@", "+", "a@", "@b.c", "a@b@c.d", "a@b.c@d.e"] + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(5000)]


def test_base_spans_as_the_patterns():
    for t in samples():
        assert pii.base_spans(t) == brute(t), repr(t)


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=30)
        if i % 2 == 0:
            d = "4" + "".join(rng.choices("0123456789", k=14))
            d += next(c for c in "0123456789" if pii.luhn(d + c))
            words[10:10] = ["card:", d, "expires"]
        elif i % 40 == 1:
            d = "4" + "".join(rng.choices("0123456789", k=14))
            d += next(c for c in "0123456789" if not pii.luhn(d + c))
            words[10:10] = ["card:", d, "expires"]
        elif i % 40 == 3:
            words[10:10] = ["order", "".join(rng.choices("0123456789", k=9)), "shipped"]
        rows.append((i, " ".join(words), "en", i))
    return rows


def test_contexts_discover(spark):
    rows = corpus() + [(900, None, None, None), (901, "", "x", 0), (None, "a@b.c " + "long " * 30000, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long").repartition(4)
    for r in pii.find(df).collect():
        text = dict((i, t) for i, t, *_ in rows)[r.doc_id] or ""
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.base]
        assert base == brute(text)
        added = [s for s in r.spans if s not in r.base]
        if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 40 == 1:
            assert [s.kind for s in added] == ["card"] and text[added[0].start : added[0].end].isdigit()
        else:
            assert not added
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert len(out) == len(rows) and out[900].text is None and out[901].text == ""
    assert "[CARD] expires" in out[0].text and "[CARD]" in out[1].text and out[0].n_chars == len(out[0].text)
    assert out[3].text == rows[3][1] and out[3].n_chars == 3 and out[None].text.startswith("[EMAIL] long")
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).columns == df.columns


def test_a_context_holds_whatever_else_is_there(spark):
    """Ten thousands of other numeric stretches neither take the rare context away nor get one."""
    rng = random.Random(12)
    rare = [r for r in corpus() if r[0] % 2 == 0][:4] + [r for r in corpus() if r[0] % 40 == 1][:3]
    other = [(10000 + i, f"row {i % 97} has {rng.randrange(10**8, 10**9)} units of {rng.randrange(10**8, 10**9)} pieces", "x", 0) for i in range(30000)]
    found = []
    for more in ([], other):
        df = spark.createDataFrame([(i, t) for i, t, *_ in rare + more], "doc_id long, text string").repartition(4)
        found.append({r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()})
    assert all(found[0][i] == found[1][i] and [s[0] for s in found[0][i]] == ["card"] for i, *_ in rare)
    assert not any(found[1][i] for i, *_ in other)


def brute_patterns(texts, rounds=pii.ROUNDS):
    """The scores by dictionaries over all distinct (pattern, instance) edges."""
    edges = {(p, pii._name(t[a:b]), k) for t in texts if t for a, b, k, own in pii.instances(t, pii.base_spans(t)) for p in own}
    held = {p: [(i, k) for q, i, k in edges if q == p] for p in {e[0] for e in edges}}
    held = {p: own for p, own in held.items() if any(k < 0 for _, k in own)}
    kinds = range(len(pii.KINDS))
    score = {p: [sum(k == x for _, k in own) / (len(own) + 1) for x in kinds] for p, own in held.items()}
    for _ in range(rounds):
        of = {}
        for p, own in held.items():
            for i, k in own:
                if k < 0:
                    of.setdefault(i, []).append(p)
        mean = {i: [sum(score[p][x] for p in ps) / len(ps) for x in kinds] for i, ps in of.items()}
        score = {p: [sum((k == x) if k >= 0 else mean[i][x] for i, k in own) / (len(own) + 1) for x in kinds] for p, own in held.items()}
    return {(p, max(kinds, key=lambda x: (score[p][x], -x))) for p, own in held.items() if len(own) >= pii.SUPPORT and max(score[p]) >= pii.CONFIDENCE}


def varied():
    """Seeds of every kind in contexts of their own, forms that no base pattern takes in these contexts, and plain numbers elsewhere."""
    rng = random.Random(21)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(60):
        fill = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=6))
        form = [f"please call +49 {d(3)} {d(6)} today", f"write to n{i}.x@host{i}.org now", f"host at 10.{i}.{rng.randrange(256)}.7 answers"][i % 3]
        rows.append((i, f"{fill()} {form} {fill()} page {rng.randrange(40)} {fill()}"))
    rows += [(100, "please call 555-019-9 today"), (101, "write to root@localhost now"), (102, "host at 10.300.1.7 answers"), (103, "in 1987 there were 555-019-9 of them"), (104, "call +1 " + "2 " * 40 + "today")]
    return rows


def test_contexts_find_other_forms(spark):
    rows = varied()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    patterns = pii.learn_patterns(df)
    got = {(r.pattern, r.kind) for r in patterns.collect()}
    assert got == brute_patterns([t for _, t in rows])
    text, found = dict(rows), {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s not in r.base] for r in pii.find(df, patterns=patterns).collect()}
    said = {i: [(k, text[i][a:b]) for k, a, b in own] for i, own in found.items() if own}
    assert said[100] == [("phone", "555-019-9")] and said[101] == [("email", "root@localhost")] and said[102] == [("ip", "10.300.1.7")]
    assert 103 not in said and all(i >= 100 for i in said)


def test_patterns_by_brute_force(spark):
    """A hub of a context, repeated rows, and instances in several contexts."""
    rng = random.Random(4)
    texts = [f"{rng.choice(['id', 'no', 'the'])} {rng.choice(['4111 1111 1111 1111', '4111111111111111', '5500 0000 0000 0004', '12-34', '9_a', 'x@y', '1234567'])} {rng.choice(['of', 'for'])}" for _ in range(300)]
    texts += ["the 7 of"] * 500 + [None, "", "id 340000000000009 of", "no 30000000000004 of"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for rounds in (0, 1, 3):
        assert {(r.pattern, r.kind) for r in pii.learn_patterns(df, rounds=rounds).collect()} == brute_patterns(texts, rounds)


def test_stretches():
    cut = lambda t: [t[a:b] for a, b in pii._stretches(t)]
    assert cut("call (555) 019 now, a_b. x@y e.g 12 no") == ["555) 019", "a_b", "x@y", "e.g", "12"]
    assert cut(" ".join(["12345678"] * 9)) == ["12345678"] * 9
    assert cut("9" * 200) == ["9" * 200] and len(pii._name("9" * 200)) == 34
    assert cut("") == [] and cut("plain words only.") == []


def test_very_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "1.2." * 250_000, "a@" * 500_000, "+1 " * 300_000, "4111 1111 1111 1111 " * 50_000, "x_1 y(2 " * 100_000, "0" * 999_990 + ".1.1.1"):
        began = time.time()
        base = pii.base_spans(text)
        pii.instances(text, base)
        assert time.time() - began < 15  # quadratic search takes hours
    assert pii.base_spans("0" * 9000 + ".1.1.1") == [(0, 1, 9006)]
