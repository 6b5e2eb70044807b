"""Features of panels: trailing windows, compositions, pooled scaling, centring, interpolation, trends, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def window_features(panel: DataFrame, entity: str, period: str, total: str, parts: list[str], window: int) -> DataFrame:
    """(entity, period, x): log of the mean level and the CLR of the summed parts over ``window`` trailing periods, full frames only."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(1 - window, 0)
    framed = panel.select(entity, period, F.avg(total).over(w).alias("level"), F.array(*[F.sum(p).over(w) for p in parts]).alias("parts"), F.count("*").over(w).alias("n"))
    return framed.where(F.col("n") == window).select(entity, period, F.concat(F.array(F.ln("level")), S.clr(F.col("parts"))).alias("x"))


def partial_profile(panel: DataFrame, entity: str, total: str, parts: list[str]) -> DataFrame:
    """(entity, periods, x) over whatever periods an entity has."""
    return panel.groupBy(entity).agg(F.count("*").alias("periods"), F.avg(total).alias("level"), F.array(*[F.sum(p) for p in parts]).alias("parts")).select(entity, "periods", F.concat(F.array(F.ln("level")), S.clr(F.col("parts"))).alias("x"))


def context_groups(groups: list[Column], valid: Column) -> Column:
    """Shares of groups and of what is unreported: nulls count as 0, a sum over 1 is scaled down, all null where not valid."""
    filled = F.array(*[F.coalesce(g, F.lit(0.0)) for g in groups])
    total = S.array_sum(filled)
    shares = F.transform(filled, lambda x: x / F.greatest(total, F.lit(1.0)))
    return F.when(valid, F.concat(shares, F.array(F.greatest(1 - S.array_sum(shares), F.lit(0.0)))))


def vector_stats(df: DataFrame, vector: str, size: int, by: list[str] | None = None) -> DataFrame:
    """mean, sd (population) of each coordinate as arrays; a coordinate without variance has sd 1."""
    x = [F.col(vector)[i] for i in range(size)]
    sd = [F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in x]
    return df.groupBy(*(by or [])).agg(F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*sd).alias("sd"))


def scaled(df: DataFrame, vector: str, size: int, clip: float = 4.0, weight: float = 1.0, train: Column | None = None) -> DataFrame:
    """``vector`` standardised by pooled statistics of the training rows, clipped, times sqrt(weight / size). The
    statistics are one row, so the join is a broadcast of a fixed size."""
    stats = vector_stats(df.where(train) if train is not None else df, vector, size)
    z = F.transform(F.arrays_zip(F.col(vector).alias("v"), F.col("mean").alias("m"), F.col("sd").alias("s")), lambda r: F.greatest(F.lit(-clip), F.least(F.lit(clip), (r["v"] - r["m"]) / r["s"])) * F.lit((weight / size) ** 0.5))
    return df.crossJoin(F.broadcast(stats)).withColumn(vector, z).drop("mean", "sd")


def median_imputed(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Nulls become the training median; a column without any value becomes 0."""
    medians = (df.where(train) if train is not None else df).agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_med") for c in columns])
    return df.crossJoin(F.broadcast(medians)).select(*[F.coalesce(c, f"{c}_med").alias(c) if c in columns else F.col(c) for c in df.columns])


def centred(df: DataFrame, period: str, vector: str, size: int, coordinates: list[int]) -> DataFrame:
    """Chosen coordinates less their median across entities in each period."""
    medians = df.groupBy(period).agg(F.array(*[F.median(F.col(vector)[i]) if i in coordinates else F.lit(0.0) for i in range(size)]).alias("med"))
    return df.join(medians, period).withColumn(vector, F.zip_with(vector, "med", lambda a, b: a - b)).drop("med")


def rolling_z(panel: DataFrame, entity: str, period: str, columns: list[str], window: int, clip: float) -> DataFrame:
    """Rolling means (full frames), then z within each period (population sd), clipped."""
    w, p = Window.partitionBy(entity).orderBy(period).rowsBetween(1 - window, 0), Window.partitionBy(period)
    means = panel.select(entity, period, *[F.when(F.count("*").over(w) == window, F.avg(c).over(w)).alias(c) for c in columns]).where(F.col(columns[0]).isNotNull())
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(c) - F.avg(c).over(p), F.stddev_pop(c).over(p))))
    return means.select(entity, period, *[z(c).alias(c) for c in columns])


def interpolated(df: DataFrame, entity: str, step: str, value: str) -> DataFrame:
    """Nulls between two values on the line through them, at the ends the nearest value. ``step`` is a whole number."""
    w = Window.partitionBy(entity).orderBy(step)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(step).alias("t"), F.col(value).alias("v")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("a_", F.last(known, True).over(back)).withColumn("b_", F.first(known, True).over(ahead))
    line = F.col("a_.v") + (F.col("b_.v") - F.col("a_.v")) * (F.col(step) - F.col("a_.t")) / F.nullif(F.col("b_.t") - F.col("a_.t"), F.lit(0))
    return df.withColumn(value, F.coalesce(F.col(value), line, F.col("a_.v"), F.col("b_.v"))).drop("a_", "b_")


def trend_volatility_season(df: DataFrame, entity: str, step: str, season: str, value: str) -> DataFrame:
    """slope, residual sd (population) and range of the seasonal means of ``value``."""
    line = df.groupBy(entity).agg(F.regr_slope(value, step).alias("slope"), F.avg(value).alias("level"), F.avg(step).alias("mid"))
    rest = df.join(line, entity).groupBy(entity).agg(F.first("slope").alias("slope"), F.stddev_pop(F.col(value) - F.col("level") - F.col("slope") * (F.col(step) - F.col("mid"))).alias("volatility"))
    seasonal = df.groupBy(entity, season).agg(F.avg(value).alias("m")).groupBy(entity).agg((F.max("m") - F.min("m")).alias("season"))
    return rest.join(seasonal, entity)


def knn_imputed(df: DataFrame, entity: str, columns: list[str], k: int) -> DataFrame:
    """Nulls become the mean of the k nearest rows that have the column, by euclidean distance over shared columns,
    scaled up by the share of columns that are shared. Pairs arise for rows with a null alone."""
    rows = df.select(entity, F.array(*columns).alias("v"))
    holes = rows.where(F.exists("v", lambda x: x.isNull())).select(F.col(entity).alias("e"), F.col("v").alias("u"))
    d = F.zip_with("u", "v", lambda a, b: (a - b) * (a - b))
    shared = F.size(F.filter(d, lambda x: x.isNotNull()))
    near = holes.join(rows, F.col("e") != F.col(entity)).where(shared > 0).withColumn("d", F.sqrt(F.lit(len(columns)) / shared * F.aggregate(d, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))))
    cells = near.select("e", entity, "d", F.posexplode("v").alias("i", "y"), "u").where(F.col("y").isNotNull() & F.get("u", F.col("i")).isNull())
    best = cells.withColumn("rn", F.row_number().over(Window.partitionBy("e", "i").orderBy("d", entity))).where(F.col("rn") <= k)
    filled = best.groupBy("e", "i").agg(F.avg("y").alias("y")).groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("i", "y"))).alias("m"))
    return df.join(filled, F.col(entity) == F.col("e"), "left").select(*[F.coalesce(F.col(c), F.col("m")[F.lit(columns.index(c))]).alias(c) if c in columns else F.col(c) for c in df.columns])
