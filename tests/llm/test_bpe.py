import base64
import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(4)
    parts = ["the", "The", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "straße", "don't", "we'll", "123", "12a", "...", "!?", "-", "日本語", "😀", "é", "\x00", "²", "ndthtion", " | ", "A'S", "<|endoftext|>", "​"]
    out = ["", " ", "\n", "a", " a", "a ", "  a", "a  b", "a \nb", "a\n b", "x" * 5000, "ab " * 3000]
    return out + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]


def test_as_tiktoken(reference):
    codec = bpe.Codec(bpe.Vocabulary.load(PATH, public_tokenizers.PATTERN), units=500, tokens=300)
    for t in samples():
        ids = codec.encode(t.encode())
        assert ids.tolist() == reference.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_perfect_hash():
    v = bpe.Vocabulary.load(PATH, public_tokenizers.PATTERN)
    assert sorted(v.hash.index(k) for k in v.ranks) == list(range(len(v.ranks)))
    assert all(v.lookup(k) == i for k, i in v.ranks.items())
    assert v.lookup(b"no such entry at all") is None
    small = bpe.MinimalPerfectHash([b"a", b"b"])
    assert {small.index(b"a"), small.index(b"b")} == {0, 1}


def test_frames(spark, reference):
    rows = [(i, t, 0) for i, t in enumerate(samples()[:200])] + [(None, None, 0), (999, "a b", 1), (999, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    enc = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    dec = bpe.decode(enc, PATH, public_tokenizers.PATTERN)
    want = sorted((i is not None, i or 0, (t or "").encode()) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.decoded)) for r in dec.collect()) == want
    texts = {i: t for i, t, _ in rows}
    for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(t.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
