import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def samples(n=300):
    rng = random.Random(8)
    parts = ["the", "The", "thtion", "é", "é", "É", "don't", "ΑΣ", "Σ", "İ", "12", "日本", "\xa0", "x y", "!?", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|>", "́a", "|", "\x1c", "a\x85b"]
    return ["", None, " ", "\n\t"] + [rng.choice((" ", "  ", "\n")).join(rng.choices(parts, k=rng.randint(1, 900))) for _ in range(n)]


def test_encoder_is_exact():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzthenadioéèñüß"
    texts = samples(60) + [" ".join("".join(rng.choices(letters, k=rng.randint(1, 60))) + rng.choice(("", ".", ",", "'s", "!?", "…")) for _ in range(200)) for _ in range(40)]
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read(), 1)
    for size in (1, 7, 1000):
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            ids, offsets = enc.encode(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(some)
    ids, offsets = enc.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]


def check(rows, want, window):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences)


def test_every_id_once_and_little_padding(spark):
    texts = [*samples(), "word " * 9000]
    ids = reference(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(5)
    n = check(packing.pack(df, PATH, window=256).collect(), dict(enumerate(ids)), 256)
    assert n == -(-sum(map(len, ids)) // 256)
    n = check(packing.pack(df, PATH, window=256, shard_tokens=20000).collect(), dict(enumerate(ids)), 256)
    assert n * 256 < 1.05 * sum(map(len, ids))


def test_repeats_nulls_empty(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(None, None)] * 2, "doc_id long, text string")
    rows = packing.pack(df, PATH, with_ids=False).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 1), (-1, 1), (1, 3), (1, 3), (1, 3)]
    assert "ids" not in rows[0]
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_neighbours_are_lexical():
    docs = [np.array([10, 11, 12, 13] * 10), np.array([20, 21, 22, 23] * 10), np.array([10, 11, 12, 14] * 9), np.array([20, 21, 22, 24] * 9)]
    placed = {i: s for i, _, _, s, _ in packing.pack_shard(docs, np.ones(30), 40, 76)}
    assert placed[0] == placed[2] != placed[1] == placed[3]


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 20, rng.integers(1, 30)) for _ in range(12)]
    idf = rng.random(20)
    index = packing.Index(docs, idf, 15.0)
    for i, d in enumerate(docs):
        want = [sum(idf[t] * (tf := (e == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(e) / 15.0)) for t in set(d.tolist())) for e in docs]
        assert np.allclose(index.scores(i), want)


def test_added_tokens_as_the_tokenizer():
    """One text of three holds them, so both ways meet in a batch."""
    enc = packing.WordEncoder(open(PATH, encoding="utf-8").read(), 1)
    texts = ["see <|endoftext|> here", "see here", None, "a<|endoftext|><|startoftext|>b\n", "", "< |endoftext|>"]
    ids, offsets = enc.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == reference(texts) and got[0] == [862, 49407, 763, 1]


def test_shards_are_dealt_by_content(spark):
    """Over many shards nearly all of a document's best neighbours are in its own, against one in 16 under random dealing."""
    rng = np.random.default_rng(3)
    topics = [rng.choice(3000, 30, replace=False) + 500 for _ in range(120)]
    rows = []
    for i in range(960):
        own = np.r_[rng.choice(topics[i % 120], 40), rng.integers(0, 500, 60)].astype("<u2")
        rows.append((i, i, own.tobytes()))
    df = spark.createDataFrame(rows, "rid long, doc_id long, ids binary").repartition(4)
    docs = [np.frombuffer(r[2], "<u2") for r in rows]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=3500)
    idf = np.log1p((len(docs) - held + 0.5) / (held + 0.5))
    placed = packing.dealt(df, spark.sparkContext.broadcast(idf), 2, 16).select("doc_id", F.spark_partition_id().alias("shard")).collect()
    shard = {r.doc_id: r.shard for r in placed}
    sizes = np.bincount(list(shard.values()), minlength=16)
    assert len(shard) == 960 and sizes.max() <= 2.5 * sizes.mean()
    index = packing.Index(docs, idf, 100.0)
    hits = []
    for i in range(0, 960, 7):
        s = index.scores(i)
        s[i] = -1
        hits.append(np.mean([shard[j] == shard[i] for j in np.argsort(-s)[:3].tolist()]))
    assert np.mean(hits) > 4 / 16


def test_a_crowd_of_copies_fills_several_shards(spark):
    df = spark.createDataFrame([(7, "the same words again and again " * 20)] * 600 + [(1000 + i, f"other text {i}") for i in range(100)], "doc_id long, text string").repartition(6)
    ids = len(reference(["the same words again and again " * 20])[0])
    rows = packing.pack(df, PATH, window=256, shard_tokens=8000, with_ids=False).collect()
    assert sum(r.length for r in rows if r.doc_id == 7) == 600 * ids
    assert len({r.sequence_id >> 32 for r in rows if r.doc_id == 7}) >= 5


def test_words_are_merged_once_for_many_batches():
    """Words of earlier batches come from the memo, which is bounded, and ids stay those of the tokenizer."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    encoder, tokenizer, merged = packing.WordEncoder(spec, 1), Tokenizer.from_str(spec), []
    words = encoder._words
    encoder._words = lambda new: merged.extend(new.to_pylist()) or words(new)
    texts = [["Él paga 2,5 it's naïveté", None, "", "q" * 99], ["it's él 2,5 " + "q" * 99, " \n", "new İstanbul"], ["NEW él 2,5 naïveté"]]
    for batch in texts:
        ids, ends = encoder.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in batch]
    again = [w for w in merged if merged.count(w) > 1]
    assert set(again) <= {b"q" * 99} and len(encoder.known) == len(encoder.coded) == len(set(merged)) - 1


def test_terms_of_documents_at_once():
    rng = np.random.default_rng(9)
    for kind in (np.uint16, np.uint32, np.int64):
        docs = [rng.integers(0, 300, n).astype(kind) for n in (1, 700, 3, 40)]
        rows, terms, times = packing._terms(docs)
        for i, d in enumerate(docs):
            want, n = np.unique(d, return_counts=True)
            assert (terms[rows == i] == want).all() and (times[rows == i] == n).all()
