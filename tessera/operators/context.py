"""Static context beside windows of levels, and what compares fits: scaled arrays of both, centres of each period, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S

from . import features

#: Blocks of coordinates that a lens keeps.
LENSES = ("spend", "context", "combined")


def sum_or_null(columns: list[Column]) -> Column:
    """Sum of the columns that have a value; null if none has."""
    known = F.coalesce(*columns)
    return F.when(known.isNotNull(), S.array_sum(F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns])))


def context_vector(population: Column, wage: Column, groups: list[Column], valid: Column) -> Column:
    """Logs of population and wage (null where not over 0), shares of groups and of what is unreported (null where not valid)."""
    none = F.array(*[F.lit(None).cast("double")] * (len(groups) + 1))
    return F.concat(F.array(S.log_positive(population), S.log_positive(wage)), F.coalesce(features.context_groups(groups, valid), none))


def scaled_arrays(windows: DataFrame, context: DataFrame, entity: str, vector: str, size: int, context_size: int, weight: float = 0.5, lens: str = "combined", train: Column | None = None) -> DataFrame:
    """``vector`` of each window beside the entity's context, both standardised over the training entities and clipped.

    Nulls of the context become the training median, a coordinate without any value is 0. Spending weighs ``weight`` and
    context the rest, whatever their numbers of coordinates. The lens ``spend`` or ``context`` keeps one block at full
    weight. An entity without a row of context counts as one whose context is null.
    """
    if lens not in LENSES:
        raise ValueError(f"lens is one of {', '.join(LENSES)}")
    spend = features.scaled(windows, vector, size, weight=1.0 if lens == "spend" else weight, train=train)
    if lens == "spend":
        return spend
    names = [f"k{i}" for i in range(context_size)]
    known = windows.select(entity).distinct().join(context.select(entity, *[F.col("x")[i].alias(n) for i, n in enumerate(names)]), entity, "left")
    filled = features.median_imputed(known, names, train).select(entity, F.array(*names).alias("context"))
    static = features.scaled(filled, "context", context_size, weight=1.0 if lens == "context" else 1 - weight, train=train)
    joined = F.col("context") if lens == "context" else F.concat(vector, "context")
    return spend.join(static, entity).withColumn(vector, joined).drop("context")


def period_centers(df: DataFrame, period: str, vector: str, size: int, k: int, key: Column, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(period, centers): k-means of each period for itself, in all periods at once. A period starts from the k rows of the
    smallest MD5 of ``key``; means are rounded to nine digits; an empty cluster keeps its centre. Rows are aggregated before
    they are shuffled, and k x size numbers a period are joined back."""
    order = Window.partitionBy(period).orderBy("h")
    first = df.select(period, F.col(vector).alias("v"), F.md5(F.concat_ws("|", F.lit(str(seed)), key)).alias("h")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    centers = first.groupBy(period).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: s["v"]).alias("centers"))
    for _ in range(iterations):
        near = df.join(centers, period).withColumn("code", nearest_center(vector, "centers"))
        means = near.groupBy(period, "code").agg(F.array(*[F.round(F.avg(F.col(vector)[i]), 9) for i in range(size)]).alias("v"), F.first("centers").alias("old"))
        found = means.groupBy(period).agg(F.map_from_entries(F.collect_list(F.struct("code", "v"))).alias("m"), F.first("old").alias("old"))
        centers = found.select(period, F.transform("old", lambda c, i: F.coalesce(F.col("m")[i], c)).alias("centers"))
    return centers


def nearest_center(vector: str, centers: str) -> Column:
    """Code of the nearest of an array of centres, the lowest among equals."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.round(S.squared_distance(F.col(vector), c), 9).alias("d"), i.alias("c"))))["c"]


def gaussian(*keys: Column) -> Column:
    """Standard normal noise keyed by hashes."""
    u, v = S.md5_uniform(F.lit("r"), *keys), S.md5_uniform(F.lit("a"), *keys)
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * F.pi() * v)


def profile_z(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, column, mean, z): means of each label, and how many population deviations they lie off the mean of labels."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("mean")) for c in columns])).alias("r")).select(label, "r.name", "r.mean")
    over = Window.partitionBy("name")  # one row a label
    return long.withColumn("z", F.coalesce(F.try_divide(F.col("mean") - F.avg("mean").over(over), F.stddev_pop("mean").over(over)), F.lit(0.0)))


def switches(paths: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(entity, switches): changes of label along an entity's periods."""
    before = F.lag(label).over(Window.partitionBy(entity).orderBy(period))
    return paths.select(entity, F.coalesce((F.col(label) != before).cast("long"), F.lit(0)).alias("s")).groupBy(entity).agg(F.sum("s").alias("switches"))
