"""Panels of entities, periods and categories: pivots, gates, weighted roll-ups and keyed clean-up.

Every operator is a DataFrame plan of built-in expressions, so filters and columns are pushed to the scan, aggregates are
partial before they are exchanged, and small dimensions are broadcast by size when Spark plans the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_levels(long: DataFrame, keys: list[str], category: str, value: str, categories: dict[str, str], total: str | None = None) -> DataFrame:
    """Sum of ``value`` for each key, one column for each category (name -> column), 0 where it has no row."""
    v = F.col(value)
    parts = [F.sum(F.when(F.col(category) == c, v).otherwise(0.0)).alias(n) for c, n in categories.items()]
    return long.groupBy(*keys).agg(*([F.sum(v).alias(total)] if total else []), *parts)


def strict_pivot(long: DataFrame, key: str, category: str, value: str, categories: list[str]) -> DataFrame:
    """Pivot that fails on a repeated (key, category); a missing cell stays null."""
    one = lambda c: F.when(F.count(F.when(F.col(category) == c, 1)) > 1, F.raise_error(F.lit(f"repeated {c}"))).otherwise(F.max(F.when(F.col(category) == c, F.col(value))))
    return long.groupBy(key).agg(*[one(c).alias(c) for c in categories])


def all_present(columns: list[str], positive: str | None = None) -> Column:
    """All columns non-null and, if named, one of them over 0."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return ok & (F.col(positive) > 0) if positive else ok


def observed_periods(panel: DataFrame, entity: str, period: str, good: Column) -> DataFrame:
    return panel.groupBy(entity).agg(F.countDistinct(F.when(good, F.col(period))).alias("observed"))


def complete_entities(panel: DataFrame, entity: str, period: str, good: Column, minimum: int) -> DataFrame:
    """Rows of entities with at least ``minimum`` distinct good periods."""
    return panel.join(observed_periods(panel, entity, period, good).where(F.col("observed") >= minimum).select(entity), entity, "left_semi")


def excluded_entities(panel: DataFrame, entity: str, period: str, good: Column, minimum: int) -> DataFrame:
    return observed_periods(panel, entity, period, good).where(F.col("observed") < minimum)


def with_remainder(panel: DataFrame, total: str, parts: list[str], name: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds total minus parts; fails where that is under -tolerance."""
    rest = F.col(total) - reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return panel.withColumn(name, F.when(rest < -tolerance, F.raise_error(F.lit(f"negative {name}"))).otherwise(rest))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: empty on a clean panel."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def weighted_mean(value: str, weight: str) -> Column:
    """Over rows where both are present; null if there is none."""
    ok = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def aggregate_members(panel: DataFrame, group: str, entity: str, period: str, levels: list[str], weight: str, coverage: float = 0.99) -> DataFrame:
    """Members of a group as one entity for each period: weighted levels over members with all of them, and the observed
    share of the group's weight. Periods under ``coverage`` are dropped; the weight is that of all members."""
    members = panel.groupBy(group, entity).agg(F.max(weight).alias("w"))
    whole = members.groupBy(group).agg(F.sum("w").alias("whole"), F.count("*").alias("members"))
    seen = panel.where(all_present(levels)).groupBy(group, period).agg(*[weighted_mean(c, weight).alias(c) for c in levels], F.sum(weight).alias("seen"))
    joined = seen.join(whole, group).withColumn("observed", F.col("seen") / F.col("whole"))
    return joined.where(F.col("observed") >= coverage).select(group, period, *levels, F.col("whole").alias(weight), "members", "observed")


def aggregate_static(static: DataFrame, group: str, by_weight: list[str], weight: str, by_employment: list[str], employment: str) -> DataFrame:
    """Static columns of a group: means by ``weight``, and shares over the employment of all valid members."""
    valid = F.col(employment) > 0
    total = F.sum(F.when(valid, F.col(employment)))
    shares = [F.try_divide(F.sum(F.when(valid & F.col(c).isNotNull(), F.col(c) * F.col(employment))), total).alias(c) for c in by_employment]
    return static.groupBy(group).agg(F.sum(weight).alias(weight), *[weighted_mean(c, weight).alias(c) for c in by_weight], *shares, total.alias(employment))


def latest_active(dim: DataFrame, key: str, start: str, end: str, at: Column | int) -> DataFrame:
    """For each key the row valid at ``at``; where none is, its latest row."""
    active = F.lit(at).between(F.col(start), F.col(end)).cast("int")
    order = Window.partitionBy(key).orderBy(active.desc(), F.col(end).desc(), F.col(start).desc())
    return dim.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands once."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("n_")).where("n_ = 1").select(key), key, "left_semi")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share of rows that are not null), in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("share")) for c in columns])).alias("r")).select("r.name", "r.share")


def overwrite(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of ``df`` replaced by those of ``other``, null where the key has no row there."""
    right = other.select(key, *[F.col(c).alias(f"{c}_new") for c in columns])
    return df.join(right, key, "left").select(*[F.col(f"{c}_new").alias(c) if c in columns else F.col(c) for c in df.columns])


def mapped(df: DataFrame, mapping: DataFrame, source: str, target: str, column: str) -> DataFrame:
    """``column`` through a two-column mapping, itself where that has no row."""
    return df.join(mapping.select(F.col(source).alias("m_"), F.col(target).alias("t_")), F.col(column) == F.col("m_"), "left").withColumn(column, F.coalesce("t_", column)).drop("m_", "t_")
