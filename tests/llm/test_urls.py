import math
import random
import re
from collections import Counter
from itertools import combinations
from urllib.parse import urlsplit

from tessera.llm import urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_viterbi_is_best():
    m = urls.Unigram({"the": 5, "spam": 3, "farm": 3, "s": 1, "pam": 1, "far": 2, "m": 1})

    def cost(words):
        return sum(m.log.get(w, -math.log(m.total) - 2.5 * len(w)) for w in words)

    for name in ("thespamfarm", "farms", "xyz", "spamx"):
        got = m.segment(name)
        assert "".join(got) == name
        every = [[name[i:j] for i, j in zip((0, *c), (*c, len(name)))] for k in range(len(name)) for c in combinations(range(1, len(name)), k)]
        assert abs(cost(got) - max(map(cost, every))) < 1e-9


def test_rules_and_parts(spark):
    cases = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://x.net", "x.net", "", None, None),
        (3, "https://x.net/", "x.net", "/", "net/", "block"),
        (4, "https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        (5, "https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        (6, "https://y.org/fr/1#a/b", "y.org", "/fr/1", "org/fr/", "allow"),
        (7, "no scheme", "", "", None, None),
        (8, None, "", "", None, None),
        (9, "x://?a://b/c", "", "", None, None),
        (10, "a://B?c/d", "b", "", None, None),
        (None, "http://x.net/a\nb", "x.net", "/a\nb", "net/", "block"),
    ]
    df = spark.createDataFrame([(c[0], c[1], "h") for c in cases] * 2, "page_id long, url string, host string")
    got = urls.judge(df, RULES).collect()
    assert len(got) == 2 * len(cases)
    want = {c[0]: c[2:] for c in cases}
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_learns_from_words(spark):
    rows = [f"https://{a}{b}.example.net/{c}/1" for a in ("cheap", "spam") for b in ("pills", "farm", "casino") for c in ("en", "de", "es")] * 4
    rows += [f"https://{a}{b}.example.org/fr/{a}" for a in ("garden", "river") for b in ("news", "school")] * 8
    rows += ["https://spampills.example.com/x", "https://gardenschool.example.com/x"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = {"net/": "block", "org/": "allow"}
    got = {urlsplit(u).hostname: r.verdict for u, r in zip(rows, sorted(urls.judge(df, rules).collect(), key=lambda r: r.page_id))}
    assert got["spampills.example.com"] == "block" and got["gardenschool.example.com"] == "allow"


def brute(rows, rules):
    """Verdicts by dictionaries; ASCII urls that are in order."""

    def parts(u):
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")
        return (m.group(1).lower(), m.group(2)) if m else ("", "")

    def rule(h, p):
        fit = [r for r in rules if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=len, default=None)

    def names(h, p):
        cut = lambda t: [f"#{len(x)}" if x[0].isdigit() else x for x in re.findall(r"[A-Za-z]{1,63}|[0-9]+", t)]
        return [("h", x) for x in cut(h)] + [("p", x) for x in cut(p.lower())]

    pages = [(parts(u), rule(*parts(u))) for u in rows]
    bare = sorted({x for (h, p), _ in pages for _, x in names(h, p) if x[0] != "#"})
    occurs = Counter(x[i:j] for x in bare for i in range(len(x)) for j in range(i + 1, min(len(x), i + urls.LONGEST) + 1))
    words = {w: c * len(w) for w, c in occurs.items() if len(w) > 1 and sum(w in x for x in bare) >= urls.SUPPORT}
    for k in range(urls.ROUNDS + 1):
        split = {x: urls.Unigram(words).segment(x) for x in bare}
        if k < urls.ROUNDS:
            words = {w: c for w, c in Counter(w for ws in split.values() for w in ws).items() if c > 1}
    tokens = lambda h, p: [s + w for s, x in names(h, p) for w in split.get(x, [x])]
    n, counts = Counter(rules[r] for _, r in pages if r), {"allow": Counter(), "block": Counter()}
    for hp, r in pages:
        if r:
            counts[rules[r]].update(tokens(*hp))
    known = set(counts["allow"]) | set(counts["block"])
    chance = lambda v, t: math.log((counts[v][t] + 1) / (sum(counts[v].values()) + len(known)))
    score = lambda hp: math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(chance("block", t) - chance("allow", t) for t in tokens(*hp) if t in known)
    return [rules[r] if r else "block" if score(hp) > 0 else "allow" for hp, r in pages]


def test_verdicts_by_brute_force(spark):
    """A hub of a name, distinct paths, repeated rows, and a name in host and path."""
    rng = random.Random(8)
    some = ["cheap", "pills", "news", "river", "casino", "bank", "garden"]
    rows = [f"http://{rng.choice(['www.', 'm.', ''])}{''.join(rng.choices(some, k=rng.randint(1, 3)))}.{rng.choice(['example.net', 'example.com', 'a.org', 'b.io'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(some)}{rng.randrange(300)}" for _ in range(250)]
    rows += rows[:60] + ["http://www.cheap.b.io/x"] * 100 + ["http://b.io/" + "spam" * 500, "none", "http://b.io/" + "7" * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(6)
    got = sorted(urls.judge(df, RULES).collect(), key=lambda r: r.page_id)
    want = brute(rows, RULES)
    assert [r.verdict for r in got] == want and {"allow", "block"} <= {w for w, r in zip(want, got) if r.rule is None}


def test_ten_copies_are_judged_alike(spark):
    """More of the same pages take no word and no token away."""
    rng = random.Random(5)
    rows = [f"http://{rng.choice('abcdef')}{rng.choice(['spam', 'good', 'odd'])}.{rng.choice(['x.net', 'y.org', 'z.io'])}/fr/{rng.randrange(50)}" for _ in range(120)]
    once = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    more = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] * 10, "page_id long, url string")
    rules = {"net/": "block", "org/": "allow"}
    a = {r.page_id: r.verdict for r in urls.judge(once, rules).collect()}
    b = {(r.page_id, r.verdict) for r in urls.judge(more, rules).collect()}
    assert b == set(a.items())


def test_very_long_urls(spark):
    df = spark.createDataFrame([(1, "http://x.net/" + "ab" * 300_000), (2, "http://" + "q" * 200_000 + ".org/fr/"), (3, "http://z.io/" + "9" * 500_000)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert len(got[1].path) == 600_001 and got[2].rule == "org/fr/" and got[3].verdict in ("allow", "block")
