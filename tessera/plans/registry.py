"""All queries: importing this module fills the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import context, custom, dynamics, evaluation, extended, models, panels, refits  # noqa: F401  they register their queries
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["window_level_clr"](spark, sf_dir)
