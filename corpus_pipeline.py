"""A corpus pipeline over the operators of ``tessera.llm``: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one reads it.
All but the last return the columns of ``docs``. No SQL expresses fitted models, so the stages are tested against brute
force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, simhash_wide, substring
from tessera.llm import toxicity as tox
from tessera.llm.common import materialise, read_table, tune


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on these documents and the labels of ``sf_dir``."""
    tune(spark)
    return tox.keep_clean(docs, tox.train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, a similarity of 0.8 or more."""
    tune(spark)
    return simhash_wide.one_of_each(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 13 that a smaller doc_id has too go. A text that loses none stays as it is, one that loses all is empty."""
    tune(spark)
    own = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(own)}  # so that no column clashes with those of the operator
    parsed = substring.parse(docs.toDF(*at.values()), window=13, id_col=at["doc_id"], text_col=at["text"])
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return parsed.select(*[(F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(x)) if c in new else F.col(x)).alias(c) for c, x in at.items()])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets."""
    tune(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048, with_ids=False)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("personal_data", personal_data), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
