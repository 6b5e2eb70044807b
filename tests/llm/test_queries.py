"""Each registered query at the smallest size, against its contract read word by word or against SQL."""

import hashlib
import itertools
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import compare  # noqa: E402
from test_pii import brute as base_of  # noqa: E402
from test_urls import brute as verdicts_of  # noqa: E402

from tessera.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    assert df.dtypes[: len(columns.split(", "))] == [tuple(c.split(" ")) for c in columns.split(", ")]
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    cur = compare.duck(SF).execute(queries.ORACLE_SQL[name])
    want = ([d[0] for d in cur.description], cur.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert not compare.differences(name, (df.columns, df.collect()), want) and want[1]


def test_op1(spark, docs):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = rows(spark, "op1_bpe", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_op2(spark, docs):
    got = rows(spark, "op2_toxicity", "doc_id bigint, held_out boolean, score double, predicted int")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean(held) > 0.85


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in docs.items()}
    got = rows(spark, "op3_packing", "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        ends = list(itertools.accumulate((r.length for r in sorted(s, key=lambda r: r.offset)), initial=0))
        assert [r.offset for r in sorted(s, key=lambda r: r.offset)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(map(len, want.values())) // 2048) + 1


def test_op4(spark, docs):
    got = rows(spark, "op4_sharding", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = {}
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, ())) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_op5(spark, docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {d: fingerprint(t) for d, t in docs.items()}
    up = {d: d for d in want}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(want), 2):
        if (want[a] ^ want[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = rows(spark, "op5_simhash", "doc_id bigint, fingerprint string, component_id bigint")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", root(d)) for d, f in want.items()} and len(got) == len(docs)


def test_op6(spark, docs):
    got = rows(spark, "op6_pii", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base_of(docs[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        key = lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0]))
        assert spans == sorted(spans, key=key)


def test_op7(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    got = sorted(rows(spark, "op7_urls", "page_id bigint, host string, path string, rule string, verdict string"), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [p.page_id for p in pages]
    for p, r in zip(pages, got, strict=True):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", p.url or "")
        assert (r.host, r.path) == ((m.group(1).lower(), m.group(2)) if m else ("", ""))
        fit = [x for x in queries.URL_RULES if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith(x[x.index("/") :])]
        assert r.rule == max(fit, key=len, default=None)
    assert [r.verdict for r in got] == verdicts_of([p.url for p in pages], queries.URL_RULES)


def test_op8(spark, docs):
    got = rows(spark, "op8_jpeg", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    same = {}
    for r in got:
        raw = docs[r.doc_id].encode()
        back = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]))
        assert same.setdefault(raw, r[1:]) == r[1:] and r.feature
