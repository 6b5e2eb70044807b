"""The thin queries over the operators of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jpeg, packing, pii, sharding, simhash, substring, toxicity, urls
from .common import read_table, tune


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048, with_ids=False)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts, as the law ``rows`` asks."""
    docs = read_table(spark, sf_dir, "documents")
    utf8 = F.encode(F.col("text"), "UTF-8")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(utf8, F.encode(F.lit(""), "UTF-8"))).cast("long").alias("text_crc32"))
    return sharding.shard(sized, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=4, radius=4).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: The rules that judge urls, by host and path.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jpeg.digests(jpeg.stored(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.parse(docs, window=13).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_toxicity, op3_packing, op4_sharding, op5_simhash, op6_pii, op7_urls, op8_jpeg, op9_embeddings, op10_substring)
}

#: SQL where the result follows from the contract alone. The SQL of op9 takes every pair of a label, so it holds where the
#: recall of the tables is whole, as on the small tables.
ORACLE_SQL: dict[str, str] = {
    "op9_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
        reach(s, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, l.y FROM reach r JOIN links l ON r.t = l.x),
        component AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s),
        counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept
        FROM embeddings m JOIN component c ON m.vec_id = c.s LEFT JOIN counted k ON m.vec_id = k.x
    """,
    "op10_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM starts),
        firsts AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words HAVING count(*) > 1),
        covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (words) WHERE first < doc_id),
        single AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        kept AS (
            SELECT e.doc_id, count(c.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
            FROM single e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
}
