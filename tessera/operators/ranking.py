"""Rank aggregation of alternatives by several criteria: places, grades, threshold and Borda orders, fronts, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(df: DataFrame, key: str, criteria: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """(by, key, one place for each criterion): 1 is best, ties share the smaller; a criterion maps to 1 (larger is better) or -1."""
    w = Window.partitionBy(*(by or []))
    return df.select(*(by or []), key, *[F.rank().over(w.orderBy((F.col(c) * s).desc())).alias(c) for c, s in criteria.items()])


def threshold_and_borda(df: DataFrame, key: str, criteria: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Grades by thirds, then order by fewest bad (3), most good (1), sum of places, key; and the rank of that sum."""
    by, names = by or [], list(criteria)
    p = places(df, key, criteria, by)
    n = F.count("*").over(Window.partitionBy(*by))
    grade = lambda c: F.when(F.col(c) <= F.ceil(n / 3), 1).when(F.col(c) <= F.ceil(2 * n / 3), 2).otherwise(3)
    g = p.select(*by, key, *names, *[grade(c).alias(f"g_{c}") for c in names])
    total = lambda f: reduce(lambda a, b: a + b, [f(c) for c in names])
    g = g.withColumn("n3", total(lambda c: (F.col(f"g_{c}") == 3).cast("int"))).withColumn("n1", total(lambda c: (F.col(f"g_{c}") == 1).cast("int"))).withColumn("sum", total(F.col))
    w = Window.partitionBy(*by)
    return g.select(*by, key, F.concat(*[F.col(f"g_{c}").cast("string") for c in names]).alias("grades"), F.row_number().over(w.orderBy("n3", F.desc("n1"), "sum", key)).alias("threshold"), F.rank().over(w.orderBy("sum")).alias("borda"))


def pareto_front(df: DataFrame, key: str, criteria: dict[str, int]) -> DataFrame:
    """Rows that no other row matches or beats in all criteria and beats in one."""
    other = df.select(*[F.col(c).alias(f"{c}_o") for c in criteria])
    pairs = [(F.col(f"{c}_o") * s, F.col(c) * s) for c, s in criteria.items()]
    beats = reduce(lambda a, b: a & b, [o >= x for o, x in pairs]) & reduce(lambda a, b: a | b, [o > x for o, x in pairs])
    return df.join(other, beats, "left_anti").select(key, *criteria)


def rank_intervals(df: DataFrame, key: str, replicate: str, value: str, sign: int) -> DataFrame:
    """Median, least and largest place of each key over replicates."""
    w = Window.partitionBy(replicate).orderBy((F.col(value) * sign).desc())
    return df.select(key, F.rank().over(w).alias("r")).groupBy(key).agg(F.median("r").alias("median"), F.min("r").alias("best"), F.max("r").alias("worst"))


def drawn_seeds(df: DataFrame, key: str, seed: str, replicates: int, salt: int) -> DataFrame:
    """Of each key one of its seeds' rows, drawn by MD5, for each replicate ``r``."""
    reps = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    h = F.md5(F.concat_ws("|", F.lit(str(salt)), F.col("r").cast("string"), F.col(key).cast("string"), F.col(seed).cast("string")))
    return reps.withColumn("rn_", F.row_number().over(Window.partitionBy("r", key).orderBy(h, seed))).where("rn_ = 1").drop("rn_")
