"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives P; labelled rows drawn without regard to their label are the unlabelled U, so
that the whole fit rests on a bounded sample of labelled rows. A linear classifier on how often words and their beginnings occur, in steps, is trained in numpy on the class-prior-corrected risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P)),

whose second part is the risk on negatives; where it falls below zero the step goes the other way, as the estimate has
then been overfitted. The class prior is the share of toxic ones among all training labels, unless given.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes

#: The bounded sample of labelled rows that the classifier is fitted on: positives, and rows whose label is not looked at.
POSITIVES, UNLABELLED = 4000, 8000
#: Texts whose marks are held at once while the sample is counted.
SLICE = 50
#: Bytes of a beginning, which stands behind a caret (inflected and compounded forms share it), and the counts that make a
#: step: a mark is a word or a beginning with a step that it reaches in the text.
BEGINNINGS, LEVELS = (4, 5, 6, 7, 8, 10), (1, 2, 3, 5)
#: Documents of the sample that must hold a word, and how many standard errors its rates must lie apart.
LEAST, Z = 5, 4.0
_TABLE = bytes(32 if 33 <= i < 127 and not chr(i).isalnum() and chr(i) != "'" else i for i in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs apart from ASCII white space and punctuation."""
    return text.translate(_TABLE).split()


def occurrences(text: bytes, known: frozenset[bytes] | None = None) -> dict[bytes, int]:
    """How often each word and each beginning occurs; of ``known`` ones only, if given."""
    own = Counter(words(text))
    out = dict(own) if known is None else {w: n for w, n in own.items() if w in known}
    for w, n in own.items():
        for size in BEGINNINGS:
            if size > len(w):
                break
            b = b"^" + w[:size]
            if known is None or b in known:
                out[b] = out.get(b, 0) + n
    return out


def marks(text: bytes) -> set[tuple[bytes, int]]:
    return {(x, level) for x, n in occurrences(text).items() for level in LEVELS if n >= level}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, weights: dict[tuple[bytes, int], float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = frozenset(x for x, _ in weights)
        steps: dict[bytes, list[tuple[int, float]]] = {}
        for (x, level), w in sorted(weights.items()):
            steps.setdefault(x, []).append((level, w))
        #: Of each word or beginning: the sum of the steps that a count reaches.
        self.sums = {x: [sum(w for level, w in own if n >= level) for n in range(max(LEVELS) + 1)] for x, own in steps.items()}

    def score(self, text: bytes) -> float:
        found, top = occurrences(text, self.known), max(LEVELS)
        z = self.bias + sum(self.sums[x][min(found[x], top)] for x in sorted(found))
        return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))


def risk_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk under the logistic loss, and the gradient (by z) of the step to take."""
    loss = lambda x: np.logaddexp(0, -x)
    slope = lambda x: -1 / (1 + np.exp(np.clip(x, -500, 500)))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    negative = loss(-z[~positive]).sum() / n_u - prior * loss(-z[positive]).sum() / n_p
    grad = np.zeros(len(z))
    if negative < 0:  # overfitted: step back along the negative part alone
        grad[~positive] = slope(-z[~positive]) / n_u
        grad[positive] = -prior * slope(-z[positive]) / n_p
        return prior * loss(z[positive]).sum() / n_p, grad
    grad[~positive] = -slope(-z[~positive]) / n_u
    grad[positive] = prior * (slope(z[positive]) + slope(-z[positive])) / n_p
    return prior * loss(z[positive]).sum() / n_p + negative, grad


def fit_linear(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by Adam over the whole sample; ``rows`` are indexes of the features present. The bias stays at the log odds of the
    prior, so a text without any known mark scores the prior, however few positives there are."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(at, w[feature], len(rows)) + w[-1]
        _, g = risk_gradient(z, positive, prior)
        grad = np.r_[np.bincount(feature, g[at], n_features) + decay * w[:-1], 0.0]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def marked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, text) -> (word, level, p) of every mark; SLICE texts at a time, as each has thousands of marks."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b, held, flags = whole.slice(at, SLICE), [], []
            for t, p in zip(text_bytes(b.column(1)), b.column(0).to_pylist(), strict=True):
                own = marks(t)
                held += own
                flags += [p] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int32()), pa.array(flags, pa.bool_())], ["word", "level", "p"])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labels whose documents are not held out. Fitted on POSITIVES and UNLABELLED of these rows at most, the first
    by a hash of the id; the prior counts all training labels. Every mark of the sample that passes LEAST and Z is a feature.
    Without a positive example every text scores under one half.
    """
    marked = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).alias("p"))
    n, toxic = marked.agg(F.count("*"), F.sum(F.col("p").cast("long"))).first()
    if not toxic:
        return Model({}, -3.0)
    if prior is None:
        prior = toxic / n if toxic < n else 0.1
    order = F.xxhash64("id", F.lit(5))
    chosen = marked.where("p").select("id").distinct().orderBy(order, "id").limit(POSITIVES).withColumn("p", F.lit(True))
    others = marked.where("id is not null").select("id").distinct().orderBy(order, "id").limit(UNLABELLED).withColumn("p", F.lit(False))
    chosen = materialise(chosen.unionByName(others), "chosen")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # POSITIVES + UNLABELLED ids at most; rows that repeat an id count once.
    sample = materialise(text.join(F.broadcast(chosen), "id").groupBy("id", "p").agg(F.min("text").alias("text")), "sample")

    n_p, n_u = (sample.where(c).count() for c in ("p", "not p"))
    a, b = F.col("a") / max(1, n_p), F.col("b") / max(1, n_u)
    mean = (F.col("a") + F.col("b")) / (n_p + n_u)
    z = (a - b) / F.sqrt(mean * (1 - mean) * (1 / max(1, n_p) + 1 / max(1, n_u)) + 1e-12)
    counted = sample.select("p", "text").mapInArrow(marked_words, "word binary, level int, p boolean").groupBy("word", "level").agg(F.sum(F.col("p").cast("long")).alias("a"), F.sum((~F.col("p")).cast("long")).alias("b"))
    counted = counted.where((F.col("a") + F.col("b") >= LEAST)).select("word", "level", z.alias("z")).where(F.abs("z") >= Z).orderBy(F.desc(F.abs("z")), "word", "level")
    names = [(bytes(r.word), r.level) for r in counted.collect()]
    if not names:
        return Model({}, -3.0)
    index = {w: i for i, w in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(index[w] for w in index.keys() & marks(t)) for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], ["id", "p", "f"])

    rows = sorted(((r.id, r.p, r.f) for r in sample.mapInArrow(present, "id long, p boolean, f array<int>").collect()), key=lambda r: (r[0], r[1], r[2]))
    w, bias = fit_linear([np.array(r[2], np.int64) for r in rows], np.array([r[1] for r in rows], bool), len(names), min(max(prior, 1e-3), 0.999))
    return Model(dict(zip(names, w.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row, over whole texts. Null and empty texts score as a text without any
    known word or beginning; repeated rows score alike; an empty table gives an empty table; only the text is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t) for t in text_bytes(b.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < 0.5 for t in text_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
