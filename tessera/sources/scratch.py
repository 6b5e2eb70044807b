"""Tables written on the way: lineage is cut by writing to the folder that all executors share, so that a lost executor costs a
re-read and a long iteration's plan stays short. They are removed when the session's driver ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, a local folder of our own, in local mode only: executors on
    other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master, own = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if own not in _OWN:
        _OWN[own] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN[own], ignore_errors=True)
    return _OWN[own]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as read back from a table of its own. It stays as long as the driver runs, since frames made of it may be run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_at_end(spark: SparkSession, path: str) -> None:
    """Removes the table when the JVM ends in order, whatever store it is in."""
    with contextlib.suppress(AttributeError):  # a client without a JVM of its own leaves that to the folder's owner
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
