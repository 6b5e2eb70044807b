import random

import pytest

import corpus_pipeline
from tessera.llm.common import materialise

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA), name))
    return out


def test_stages(spark, stages):
    first, clean, unique, cut, private, packed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "personal_data", "packing"]
    assert all(s.columns == first.columns for s in stages[:5])
    assert first.count() >= clean.count() >= unique.count() == cut.count() == private.count() > 100
    ids = [r.doc_id for r in unique.collect()]
    assert len(ids) == len(set(ids))
    texts = {r.doc_id: r.text for r in unique.collect()}
    seen = set()
    for i in sorted(texts):  # brute force of the third stage
        words, gone = texts[i].encode().split(), set()
        own = [tuple(words[p : p + 13]) for p in range(len(words) - 12)]
        for p, w in enumerate(own):
            if w in seen:
                gone.update(range(p, p + 13))
        seen.update(own)
        want = " ".join(w.decode() for p, w in enumerate(words) if p not in gone) if gone else texts[i]
        assert cut.where(f"doc_id = {i}").first().text == want if random.Random(i).random() < 0.05 or gone else True
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_and_extra_columns(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1].count()
    docs = stages[0].limit(20).selectExpr("*", "'a' as kept", "1 as n_words", "2 as block_", "3 as factors")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, DATA), "wide")
    assert docs.columns[-4:] == ["kept", "n_words", "block_", "factors"] and docs.where("kept = 'a' and block_ = 2").count() == docs.count()


def test_empty(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
