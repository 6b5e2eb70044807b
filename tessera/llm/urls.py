"""URL filter: host word segmentation and multinomial naive Bayes, under longest-match rules.

Rules name a host, its subdomains and a path prefix. Pages that a rule judges are the labelled examples. Their tokens
and those of all other pages come from a unigram Viterbi segmentation of host and path names, whose word counts are
taken over the distinct names of all pages by a few rounds of re-estimation, then naive Bayes gives the verdict where no rule fits.

Names, their pieces, word counts and token weights are tables throughout: each distinct name meets the words that it
holds in a join, is split alone, and gets the sum of its tokens' weights, which its pages add up. Names and words that a large
share of the rows hold are joined apart (``hub_join``). No count is held against a share of the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise

#: Letters of a word at most, rounds, and distinct names that a word of the first round needs.
LONGEST, ROUNDS, SUPPORT = 24, 2, 2
#: A longer run of letters falls into names of this many (no host label may be longer).
LABEL = 63
_NAME = rf"[A-Za-z]{{1,{LABEL}}}|[0-9]+|[^\x00-\x7f]{{1,{LABEL}}}"
#: Names whose pieces are held at once.
SLICE = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, prefix = rule.partition("/")
    return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + prefix)


def longest_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        out = F.when(fits(rule, host, path), rule).otherwise(out)
    return out


class Unigram:
    """Log probabilities of words from their counts, ``total`` being that of all words; unknown words cost by their length."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1.0
        self.log = {w: math.log(c / self.total) for w, c in counts.items() if c > 0}

    def segment(self, name: str) -> list[str]:
        """Viterbi: the split of the largest probability; the fewest words, then the longest last one, among equals."""
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        get, unknown = self.log.get, -math.log(self.total)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                p = get(name[i:j])
                if p is None:
                    p = unknown - 2.5 * (j - i)
                if best[i] + p > best[j] + 1e-12:
                    best[j], back[j] = best[i] + p, i
        out, j = [], n
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]


def pieces(name: str) -> Counter[str]:
    """How often each substring up to LONGEST letters occurs."""
    return Counter(name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + LONGEST) + 1))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            rows = [(i, w, k) for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w, k in pieces(name).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["nid", "word", "k"])


def _split(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [Unigram({e["word"]: e["n"] for e in known or ()}, total).segment(name) for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def segmented(names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(name, words) of distinct ``names`` (name), split by unigram counts that are taken over all of them: first the letters of
    all substrings that SUPPORT names hold, then those of the words of the split before, without words that occur once."""
    known = materialise(names.withColumn("nid", F.monotonically_increasing_id()), "names")
    parts = materialise(known.select("nid", "name").mapInArrow(_pieces, "nid long, word string, k long"), "pieces")
    held = materialise(parts.groupBy("word").agg(F.count("*").alias("rows"), F.sum("k").alias("occurs")), "held")
    rows = held.agg(F.sum("rows")).first()[0] or 0
    words = held.where((F.length("word") > 1) & (F.col("rows") >= SUPPORT)).select("word", "rows", (F.col("occurs") * F.length("word")).cast("double").alias("n"))
    for k in range(rounds + 1):
        total = words.agg(F.sum("n")).first()[0] or 0.0
        own = hub_join(parts.select("nid", "word"), words, "word", "rows", rows).groupBy("nid").agg(F.collect_list(F.struct("word", "n")).alias("known"))
        split = materialise(known.join(own, "nid", "left").select("name", "known").mapInArrow(_split(total), "name string, words array<string>"), "split")
        if k < rounds:
            counted = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("n")).where("n > 1")
            words = materialise(counted.join(held, "word").select("word", "rows", "n"), "words")
    return split


def name_columns(host: Column, path: Column) -> Column:
    """Names of a host (h:) and a path (p:), each as often as it stands there; a number is known by its length."""

    def found(side: str, text: Column) -> Column:
        some = F.regexp_extract_all(text, F.lit(_NAME), F.lit(0))
        return F.transform(some, lambda x: F.concat(F.lit(f"{side}:"), F.when(x.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)))

    return F.concat(found("h", host), found("p", F.lower(path)))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row.

    The verdict is that of the longest rule that fits (a rule like ``net/``: its host or a subdomain, path by prefix), else
    that of naive Bayes fitted on all pages that rules judge. A null url, and one without ``://``, have empty host and
    path; without any token, or without examples of both verdicts, the more frequent verdict holds, ``allow`` on a tie.
    Repeated rows count as often as they stand there; urls of any length are taken whole; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path"))).withColumn("rid", F.monotonically_increasing_id())
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    parts = materialise(parts.withColumn("said", said), "parts")
    sides = {v: F.sum(F.coalesce((F.col("said") == v).cast("long"), F.lit(0))) for v in ("allow", "block")}
    n = parts.agg(*[F.coalesce(c, F.lit(0)).alias(v) for v, c in sides.items()]).first()
    prior = math.log(n.block + 1) - math.log(n.allow + 1)
    score = F.lit(prior)
    if n.block and n.allow:
        places = materialise(parts.select("rid", "said", F.explode(name_columns(F.col("host"), F.col("path"))).alias("name")), "places")
        named = places.groupBy("name").agg(F.sum(F.col("said").isNull().cast("long")).alias("open"), *[c.alias(v) for v, c in sides.items()])
        named = materialise(named.withColumn("side", F.substring("name", 1, 2)).withColumn("bare", F.expr("substring(name, 3)")), "named")
        number = F.col("bare").startswith("#")
        split = segmented(named.where(~number).select(F.col("bare").alias("name")).distinct()).withColumnRenamed("name", "bare")
        cut = named.join(split, "bare", "left").select("name", "open", "allow", "block", "side", F.explode(F.when(number, F.array("bare")).otherwise(F.col("words"))).alias("word"))
        cut = materialise(cut.withColumn("token", F.concat("side", "word")), "cut")
        counts = materialise(cut.groupBy("token").agg(F.count("*").alias("c"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).where("allow + block > 0"), "tokens")
        all_ = counts.agg(F.count("*").alias("v"), F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.sum("c").alias("c")).first()
        log = lambda v: F.log((F.col(v) + 1) / F.lit((all_[v] or 0) + all_.v))
        # Fixed-point weights, so that no sum depends on its order.
        weights = counts.select("token", "c", (log("block") - log("allow")).cast("decimal(24,12)").alias("w"))
        of_name = hub_join(cut.where("open > 0").select("name", "open", "token"), weights, "token", "c", all_.c or 0).groupBy("name").agg(F.first("open").alias("open"), F.sum("w").alias("s"))
        of_name = materialise(of_name, "of_name")
        asked = of_name.agg(F.sum("open")).first()[0] or 0
        of_page = hub_join(places.where("said is null").select("rid", "name"), of_name, "name", "open", asked).groupBy("rid").agg(F.sum("s").cast("double").alias("s"))
        parts = parts.join(of_page, "rid", "left")
        score = F.lit(prior) + F.coalesce("s", F.lit(0.0))
    return parts.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(score > 0, "block").otherwise("allow")).alias("verdict"))
