"""Sources and sinks: typed and free-form CSV, checked files, JSON and CSV tables, order-free table hashes, lineage.

Everything is read and written by Spark's own readers, so any store that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import json
import math
import platform
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def typed_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema, plain or gzip: codes stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


def wide_csv(spark: SparkSession, path: str, wanted: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Semicolon-separated CSV, all strings, of which ``wanted`` columns are kept; one that is missing gets its default."""
    raw = spark.read.option("header", True).option("sep", ";").option("inferSchema", False).csv(path)
    defaults = defaults or {}
    missing = [c for c in wanted if c not in raw.columns and c not in defaults]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit(defaults[c]).alias(c) for c in wanted])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (name, sha256) whose file is absent or differs: empty if all is well."""
    have = manifest(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return expected.join(have, "name", "left").where("found is null or found <> sha256")


def roads(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(src, dst, d), both directions, of edges of one kind with both ends among ``nodes`` and no loops; the shortest counts."""
    own = edges.where((F.col("type") == kind) & (F.col("src") != F.col("dst"))).select("src", "dst", "d")
    for end in ("src", "dst"):
        own = own.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    both = own.select("src", "dst", "d").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))
    return both.groupBy("src", "dst").agg(F.min("d").alias("d"))


def write_csv(df: DataFrame, path: str) -> None:
    """One report table with a header. Report tables are small; a large one is better written as Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row; a value that isn't finite becomes null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c) for c, t in ((f.name, f.dataType) for f in df.schema)]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def cleaned(value):
    """Plain values for a JSON document, null for what isn't finite."""
    if isinstance(value, dict):
        return {str(k): cleaned(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [cleaned(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value.item() if hasattr(value, "item") else value


def table_hash(df: DataFrame) -> DataFrame:
    """(rows, hash) that don't depend on the order of rows, but on columns, values and repeats."""
    h = F.xxhash64(*[F.lit(c) for c in df.columns], *df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("hash"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lineage(inputs: dict[str, str], packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict:
    """Versions, and a run id of 16 characters over the inputs' names and digests."""
    h = hashlib.sha256(json.dumps(sorted(inputs.items())).encode())
    found = {}
    for p in packages:
        try:
            found[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            found[p] = None
    return {"run_id": h.hexdigest()[:16], "python": platform.python_version(), "dependencies": found, "inputs": dict(inputs)}


def render(template: str, values: dict[str, str]) -> str:
    """``<<NAME>>`` placeholders filled; fails where one is left."""
    for k, v in values.items():
        template = template.replace(f"<<{k}>>", v)
    if "<<" in template:
        raise ValueError(f"placeholder left: {template[template.index('<<') :][:40]}")
    return template
