import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices([f"w{k}" for k in range(80)], k=rng.randint(5, 60))
        toxic = rng.random() < 0.2
        if toxic:
            words[2:2] = rng.choices(["Scum!", "vile", "FOUL,"], k=2)
        rows.append((i, " ".join(words), "x", 0.5))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, p string, score double").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(None, None, "x", 0.0), (9001, "", "x", 0.0), (9001, "", "x", 0.0), (9002, "fine " * 50000 + "scum vile foul", "x", 0.0)]
    docs, marks = frames(spark, rows, [*labels, (None, 1, 1), (12345, 0, 1), (3, 0, None)])
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [i for i in truth if by[i].held_out]
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.97 and len(held) > 30
    assert by[None].predicted == by[9001].predicted == 0 and by[9002].predicted == 1
    kept = toxicity.keep_clean(docs, toxicity.train(docs, marks))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_no_positives_and_empty(spark):
    rows, labels = corpus(50)
    docs, marks = frames(spark, rows, [(i, q, 0) for i, q, _ in labels])
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.train(docs, marks)).collect())
    model = toxicity.train(docs.limit(0), marks.limit(0))
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_risk_is_class_prior_corrected():
    rng = np.random.default_rng(2)
    z, positive, prior = rng.standard_normal(50) - 1, np.arange(50) < 20, 0.3
    loss = lambda x: np.log1p(np.exp(-x))
    negative = loss(-z[20:]).mean() - prior * loss(-z[:20]).mean()
    risk, grad = toxicity.risk_gradient(z, positive, prior)
    assert negative > 0 and np.isclose(risk, prior * loss(z[:20]).mean() + negative)
    for i in (0, 30):
        up = z.copy()
        up[i] += 1e-6
        assert np.isclose((toxicity.risk_gradient(up, positive, prior)[0] - risk) / 1e-6, grad[i], atol=1e-4)
    z = np.where(positive, 8.0, -9.0)
    risk, grad = toxicity.risk_gradient(z, positive, 0.5)
    assert risk >= 0 and (grad[~positive] <= 0).all()


def test_the_sample_is_counted_in_slices():
    """A batch of 120 texts leaves in three parts, whose marks are those of the texts one by one."""
    texts = [f"a{i % 7} word word stays {i}" for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 3 == 0 for i in range(120)]), pa.array(texts)], ["p", "text"])
    parts = list(toxicity.marked_words(iter([batch])))
    assert len(parts) == 3
    got = Counter((w, n, p) for b in parts for w, n, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    assert got == Counter((w, n, i % 3 == 0) for i, t in enumerate(texts) for w, n in toxicity.marks(t.encode()))


def test_scores_by_brute_force(spark):
    """The score is the logistic of the bias and the weights of the marks that the text holds, found one by one."""
    rows, labels = corpus(300)
    docs, marks = frames(spark, rows, labels)
    model = toxicity.train(docs, marks)
    assert model.weights
    for r in toxicity.score(docs, model).collect():
        text = rows[r.doc_id][1].encode().lower().replace(b"!", b" ").replace(b",", b" ").split()
        z = model.bias
        for (x, level), w in model.weights.items():
            n = sum(t[: len(x) - 1] == x[1:] for t in text) if x.startswith(b"^") else text.count(x)
            z += w * (n >= level)
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)))


def test_a_fit_rests_on_labelled_rows_alone(spark):
    """Documents without a label move no weight."""
    rows, labels = corpus(300)
    docs, marks = frames(spark, rows, labels)
    more = docs.unionByName(spark.createDataFrame([(50000 + i, "scum vile other words", "x", 0.0) for i in range(200)], docs.schema))
    a, b = toxicity.train(docs, marks), toxicity.train(more, marks)
    assert a.weights == b.weights and a.bias == b.bias
