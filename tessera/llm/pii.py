"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base matches are the seed entities. Each identifier-like stretch of text (an instance) stands in three lexical patterns:
its class after the word on its left, before the word on its right, and between both. The class tells only whether it holds
an @, letters and digits, digits or neither, so a context learnt from seeds finds identifiers of forms that no base pattern
has. Over all documents patterns and instances form a bipartite graph, scored by turns in Spark: a pattern by the mean
of its instances, an instance by the mean of its patterns, seeds fixed at their kind. Ordinary numbers in a context have
other contexts too, score low, and so keep it from being trusted. Patterns of enough distinct instances and confidence then
mark instances that no base pattern takes. Neither bar depends on the size of the corpus, so accepted patterns stay a table,
which meets the patterns of each text in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise

KINDS = ("email", "ip", "card", "phone")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, and takes runs whole, which keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What makes a word identifier-like: a digit, an @ or an underscore, or letters joined by a dot or a bracket.
_LIKE = re.compile(r"[0-9@_]|[^\W_][.(\[][^\W_]")
#: Code points of the widest joined stretch (a wider one falls into its words) and of a context word (the end next to the
#: instance counts); longer instances are known by a digest.
WIDE = 64
#: Patterns: distinct instances and confidence needed, rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.6, 3
#: Equal texts meet their patterns in so many groups.
SALTS = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: a local part reaches left from its @, not into the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    first = _DIGIT.search(text)
    if first:
        at = first.start()
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, at) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text, at):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if (plus := text.rfind("+", 0, at + 1)) >= 0 or "+" in text:
            for m in _PHONE.finditer(text, max(0, plus)):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def kind_of_stretch(s: str) -> str:
    """E: holds an @; M: digits and letters; N: digits; W: neither."""
    if "@" in s:
        return "E"
    if not _DIGIT.search(s):
        return "W"
    return "M" if any(map(str.isalpha, s)) else "N"


def _apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``found`` that overlap none of ``taken``; both come by start."""
    i, reach = 0, 0  # the furthest end of those that start before the stretch ends
    for a, b in found:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            yield a, b


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[str, str, str]]]:
    """(start, end, kind's number or -1, patterns): base spans, and identifier-like stretches apart from them."""
    found = [(a, b, k) for a, k, b in base]
    found += [(a, b, -1) for a, b in _apart(list(_stretches(text)), [(a, b) for a, _, b in base])]
    out = []
    for a, b, k in found:
        left, right = text[max(0, a - WIDE) : a].split()[-1:], text[b : b + WIDE].split()[:1]
        before, after, c = left[0].lower() if left else "^", right[0].lower() if right else "$", kind_of_stretch(text[a:b])
        out.append((a, b, k, (f"B {before} {c} {after}", f"L {before} {c}", f"R {c} {after}")))
    return out


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Identifier-like words without the punctuation around them. Numbers joined by single spaces are one stretch, if it isn't too wide."""
    n, at = len(text), 0
    while m := _LIKE.search(text, at):
        a = b = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        words, start = [], a
        while True:
            while b < n and not text[b].isspace():
                b += 1
            words.append((start, b))
            if not (b + 1 < n and text[b - 1] in "0123456789)-" and text[b] == " " and text[b + 1] in "(0123456789"):
                break
            start = b = b + 1
        at = b
        for x, y in [(a, b)] if b - a <= WIDE else words:
            while y > x and text[y - 1] in ".,;:!?)\"'":
                y -= 1
            while y > x and text[x] in "(\"'":
                x += 1
            if _LIKE.search(text, x, y):
                yield x, y


def _name(s: str) -> str:
    return s if len(s) <= WIDE else f"# {xxhash.xxh3_128_hexdigest(s.encode())}"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column(0).to_pylist():
            if t:
                base = base_spans(t)
                for a, z, k, own in instances(t, base):
                    name = _name(t[a:z])
                    rows += [(p, name, k) for p in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["pattern", "instance", "kind"])


def learn_patterns(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind): accepted patterns with the number of their kind."""
    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(_edges, "pattern string, instance string, kind int")
    edges = materialise(seen.distinct(), "edges")
    names = [f"s{k}" for k in range(len(KINDS))]
    open_ = F.col("kind") < 0
    # Seeds keep their scores, so of them each pattern needs only the sums; patterns without an open instance mark nothing,
    # and those without a seed score zero in the first round.
    sums = [F.sum((F.col("kind") == k).cast("double")).alias(f"base{k}") for k in range(len(KINDS))]
    base = edges.groupBy("pattern").agg(F.count("*").alias("m"), F.sum(open_.cast("long")).alias("o"), *sums).where("o > 0")
    base = materialise(base, "base")
    opens = edges.where(open_).select("pattern", "instance")
    total = opens.count()
    graph = materialise(hub_join(opens, base, "pattern", "o", total), "graph")
    # A mean over one more instance of score zero, so that few instances don't make a sure pattern.
    pattern = base.select("pattern", "m", "o", *[(F.col(f"base{k}") / (F.col("m") + 1)).alias(s) for k, s in enumerate(names)])
    for _ in range(rounds):
        scored = hub_join(graph.select("pattern", "instance"), pattern.select("pattern", "o", *names), "pattern", "o", total)
        mean = materialise(scored.groupBy("instance").agg(F.count("*").alias("c"), *[F.avg(s).alias(s) for s in names]), "instances")
        again = hub_join(graph, mean, "instance", "c", total).groupBy("pattern").agg(F.first("m").alias("m"), F.first("o").alias("o"), *[((F.first(f"base{k}") + F.sum(s)) / (F.first("m") + 1)).alias(s) for k, s in enumerate(names)])
        pattern = materialise(again, "patterns")
    best = F.greatest(*[F.col(s) for s in names])
    sure = pattern.where((F.col("m") >= support) & (best >= confidence))
    kind = F.coalesce(*[F.when(F.col(s) == best, k) for k, s in enumerate(names)])
    return materialise(sure.select("pattern", kind.alias("kind")), "accepted")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of the instances apart from base spans, beside the key of their text."""
    for b in batches:
        rows = []
        for k1, k2, salt, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            rows += [(k1, k2, salt, p) for p in {p for _, _, k, own in instances(t, base_spans(t)) if k < 0 for p in own}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "salt", "pattern"])


def _with_patterns(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(r: the row, found: accepted patterns that its text holds, as entries or null). Texts without a stretch hold none and don't move."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{text_col}`")
    like = F.coalesce(text.rlike(r"[0-9@_]|[\p{L}\p{N}][.(\[][\p{L}\p{N}]"), F.lit(False))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not _map(docs, c)]), F.lit(SALTS))
    keyed = docs.where(like).select(row, F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2"), salt.cast("long").alias("salt"))
    asked = keyed.select("k1", "k2", "salt", F.col("r").getField(text_col).alias("text")).mapInArrow(_asked, "k1 long, k2 long, salt long, pattern string").distinct()
    asked = materialise(asked, "asked")
    of = asked.groupBy("pattern").agg(F.count("*").alias("n")).join(patterns, "pattern")
    found = hub_join(asked, of, "pattern", "n", asked.count()).groupBy("k1", "k2", "salt").agg(F.collect_list(F.struct("pattern", "kind")).alias("found"))
    found = materialise(found, "found")
    none = F.lit(None).cast(found.schema["found"].dataType).alias("found")
    return keyed.join(found, ["k1", "k2", "salt"], "left").select("r", "found").unionByName(docs.where(~like).select(row, none))


def _map(docs: DataFrame, column: str) -> bool:
    """Whether a column holds maps, which have no hash."""
    return "map<" in docs.schema[column].dataType.simpleString()


def _held(column: pa.Array) -> Iterator[dict[str, int]]:
    for entries in column.to_pylist():
        yield {e["pattern"]: e["kind"] for e in entries or ()}


def spans(text: str, patterns: dict[str, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with what patterns add; (start, kind's number, end), sorted."""
    base = base_spans(text)
    if not patterns:
        return base, base
    added = []
    for a, b, k, own in instances(text, base):
        if k < 0 and (kind := next((patterns[p] for p in own if p in patterns), None)) is not None:
            added.append((a, kind, b))
    return base, sorted(base + added)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _structs(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive, by start, then kind.

    ``base`` holds the matches of the fixed patterns, ``spans`` also what the learnt contexts add (learnt here from all rows, unless
    given). Null and empty texts have none; repeated rows are judged alike; an empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    met = _with_patterns(texts, "text", learn_patterns(docs, text_col) if patterns is None else patterns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t or "", held) for t, held in zip(b.column(1).to_pylist(), _held(b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([_structs(g[i]) for g in got], kind) for i in (0, 1)]], ["doc_id", "base", "spans"])

    return met.select("r.doc_id", "r.text", "found").mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with each span of the text replaced by its kind in brackets, and the size brought up to date."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    met = _with_patterns(docs, text_col, learn_patterns(docs, text_col))
    text_at, size_at = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def clean(t: str | None, held: dict[str, int]) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, k, b in spans(t, held)[1]:
            if a >= at:
                out += [t[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, old = b.column(0).flatten(), b.column(0).field(text_at).to_pylist()
            new = [clean(t, held) for t, held in zip(old, _held(b.column(1)), strict=True)]
            cols[text_at] = pa.array(new, schema.field(text_at).type)
            if size_at is not None:
                sizes = [len(y) if x != y else z for x, y, z in zip(old, new, cols[size_at].to_pylist(), strict=True)]
                cols[size_at] = pa.array(sizes, schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return met.mapInArrow(run, docs.schema)
