"""What the corpus operators share: written intermediate tables, Arrow helpers, bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_dir
from tessera.sources.scratch import written as materialise

__all__ = ["hub_join", "materialise", "read_table", "shared_dir", "spread_join", "text_bytes", "tune"]


#: A key is a hub if more than one in so many rows hold it, so there are fewer hubs than that.
HUBS = 1000


def hub_join(many: DataFrame, one: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """``many`` joined to ``one``, which has one row for each ``key`` and says in ``n`` how many rows of ``many`` hold it.

    The rows of ``one`` for hubs, HUBS at most, are broadcast, so a hub's rows stay in the tasks where they lie; the others
    meet by a shuffle. ``total`` is the number of rows of ``many``, or a bound of its order.
    """
    hub = F.col(n) * HUBS > F.lit(total)
    hubs, rest = one.where(hub), one.where(~hub)
    few = many.join(F.broadcast(hubs), key)
    return few.unionByName(many.join(F.broadcast(hubs.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rest, key))


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``many`` joined to ``one``, whose single row for a ``key`` may be too wide to broadcast.

    A hub's row is copied, so that each copy meets 1/HUBS of the ``total`` rows of ``many`` at most; there are 2 * HUBS copies
    beside the rows themselves at most. What is broadcast is the hubs' keys and numbers of copies.
    """
    hubs = many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HUBS > F.lit(total)).select(key, F.ceil(F.col("n") * HUBS / F.lit(max(1, total))).cast("int").alias("copies_"))
    hubs = F.broadcast(materialise(hubs, "hubs"))
    copies = F.coalesce("copies_", F.lit(1))
    left = many.join(hubs, key, "left").withColumn("salt_", F.pmod(F.xxhash64(*many.columns), copies).cast("int")).drop("copies_")
    right = one.join(hubs, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies_")
    return left.join(right, [key, "salt_"]).drop("salt_")


def tune(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and bytes, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""
