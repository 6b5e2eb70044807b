"""Significance, validation and dynamics of types: corrections, effects, nulls, resampling, transitions, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def bh_qvalues(df: DataFrame, p: str, family: str) -> DataFrame:
    """Adds ``q``: Benjamini-Hochberg over each family, min over the larger p of p m / rank, at most 1."""
    m, up = F.count("*").over(Window.partitionBy(family)), Window.partitionBy(family).orderBy(p)
    ranked = df.withColumn("q_", F.col(p) * m / F.row_number().over(up))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min("q_").over(up.rowsBetween(0, Window.unboundedFollowing)))).drop("q_")


def omega_squared(df: DataFrame, value: str, label: str) -> DataFrame:
    """One row: max(0, (SSB - (k - 1) MSW) / (SST + MSW)), from the moments of each group."""
    g = df.where(F.col(value).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    ssb, msw = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    return one.select(F.greatest(F.lit(0.0), F.try_divide(ssb - (F.col("k") - 1) * msw, ssb + F.col("ssw") + msw)).alias("omega2"))


def factor_r2(df: DataFrame, value: str, factors: list[str], name: str) -> DataFrame:
    """Adjusted R2 of the means of one factor (or a crossing of several), by moments."""
    g = df.where(F.col(value).isNotNull()).groupBy(*factors).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("rss"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    sst = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n") + F.col("rss")
    return one.select((1 - F.try_divide(F.try_divide(F.col("rss"), F.col("n") - F.col("k")), F.try_divide(sst, F.col("n") - 1))).alias(name))


def within_means(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns less their mean in the group."""
    w = Window.partitionBy(group)
    return df.select(*[(F.col(c) - F.avg(c).over(w)).alias(c) if c in columns else F.col(c) for c in df.columns])


def permuted(df: DataFrame, entity: str, label: str, replicates: int, seed: int, within: str | None = None) -> DataFrame:
    """(replicate, entity, label): labels dealt anew, over all entities or inside each value of ``within``, by MD5 order."""
    key = [within] if within else []
    places = df.select(entity, label, *key)
    reps = places.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy("replicate", *key)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(entity).cast("string")))
    to = reps.select("replicate", *key, entity, F.row_number().over(w.orderBy(entity)).alias("i"))
    of = reps.select("replicate", *key, label, F.row_number().over(w.orderBy(h, entity)).alias("i"))
    return to.join(of, ["replicate", *key, "i"]).select("replicate", entity, label)


def null_score(observed: DataFrame, null: DataFrame, value: str, sign: int) -> DataFrame:
    """One row: value, null_mean, null_sd (population), z with direction, one-sided p. The table of replicates is small."""
    s = null.crossJoin(F.broadcast(observed.select(F.col(value).alias("obs")))).agg(F.first("obs").alias("value"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"), F.sum((sign * F.col(value) >= sign * F.col("obs")).cast("int")).alias("over"), F.count("*").alias("n"))
    return s.select("value", "null_mean", "null_sd", (sign * (F.col("value") - F.col("null_mean")) / (F.col("null_sd") + 1e-12)).alias("z"), ((1 + F.col("over")) / (F.col("n") + 1)).alias("p"))


def subsamples(df: DataFrame, entity: str, replicates: int, share: float, seed: int) -> DataFrame:
    """(replicate, entity): the first floor(share n) by MD5 order, for each replicate."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(entity).cast("string")))
    reps = df.select(entity).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy("replicate")
    return reps.withColumn("i", F.row_number().over(w.orderBy(h, entity))).withColumn("n", F.count("*").over(w)).where(F.col("i") <= F.floor(F.col("n") * share)).select("replicate", entity)


def transitions(labels: DataFrame, entity: str, period: str, label: str, confidence: str, horizon: int = 3) -> DataFrame:
    """Changes of type with ``censored`` (fewer than ``horizon`` periods from it on), ``persists`` (it holds for them), the lower
    bound ``support`` = max(0, sum of confidences from the period before to horizon - 1 after, less horizon), and ``robust``."""
    w = Window.partitionBy(entity).orderBy(period)
    ahead = w.rowsBetween(0, horizon - 1)
    out = labels.select(
        entity, period, F.lag(label).over(w).alias("from"), F.col(label).alias("to"), (F.count("*").over(ahead) < horizon).alias("censored"),
        (F.min(label).over(ahead) == F.max(label).over(ahead)).alias("same"), F.greatest(F.lit(0.0), F.sum(confidence).over(w.rowsBetween(-1, horizon - 1)) - horizon).alias("sum"),
    )
    out = out.where(F.col("from") != F.col("to"))
    persists = F.col("same") & ~F.col("censored")
    support = F.when(~F.col("censored"), F.col("sum")).otherwise(0.0)
    return out.select(entity, period, "from", "to", "censored", persists.alias("persists"), support.alias("support"), (persists & (support >= 0.5)).alias("robust"))


def transition_matrix(labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(from, to, n, p): counts of successive types, and their share of the row."""
    w = Window.partitionBy(entity).orderBy(period)
    steps = labels.select(F.lag(label).over(w).alias("from"), F.col(label).alias("to")).where(F.col("from").isNotNull())
    counts = steps.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def dwell_times(matrix: DataFrame, periods: int) -> DataFrame:
    """Expected stay 1 / (1 - p), at most ``periods``."""
    stay = matrix.groupBy("from").agg(F.coalesce(F.max(F.when(F.col("from") == F.col("to"), F.col("p"))), F.lit(0.0)).alias("p"))
    return stay.select(F.col("from").alias("type"), F.least(F.lit(float(periods)), F.coalesce(F.try_divide(F.lit(1.0), 1 - F.col("p")), F.lit(float(periods)))).alias("dwell"))


def start_end_flow(labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    ends = labels.groupBy(entity).agg(F.min_by(label, period).alias("start"), F.max_by(label, period).alias("end"))
    return ends.groupBy("start", "end").agg(F.count("*").alias("n"))


def churn(labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """One row: mean over steps of the share that changes, share changed from first to last, share that never changes."""
    w = Window.partitionBy(entity).orderBy(period)
    steps = labels.select(period, (F.lag(label).over(w) != F.col(label)).cast("double").alias("c")).where("c is not null")
    mean = steps.groupBy(period).agg(F.avg("c").alias("c")).agg(F.avg("c").alias("churn"))
    ends = labels.groupBy(entity).agg((F.min_by(label, period) != F.max_by(label, period)).cast("double").alias("x"), (F.countDistinct(label) == 1).cast("double").alias("y"))
    return mean.crossJoin(ends.agg(F.avg("x").alias("changed"), F.avg("y").alias("never")))


def neighbour_mode(edges: DataFrame, labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """(entity, period, mode): the most frequent type among neighbours, the lowest code among equals."""
    far = labels.select(F.col(entity).alias("dst"), period, F.col(label).alias("t"))
    counts = edges.select("src", "dst").join(far, "dst").groupBy(F.col("src").alias(entity), period, "t").agg(F.count("*").alias("n"))
    return counts.groupBy(entity, period).agg(F.max_by("t", F.struct(F.col("n"), -F.col("t"))).alias("mode"))


def spatial_markov(edges: DataFrame, labels: DataFrame, entity: str, period: str, label: str) -> DataFrame:
    """One row: probability of a change where the neighbours' modal type is one's own and where it isn't, the z of their difference,
    and the share of changes that go to the neighbours' type."""
    w = Window.partitionBy(entity).orderBy(period)
    steps = labels.select(entity, period, F.col(label).alias("now"), F.lead(label).over(w).alias("next")).where("next is not null")
    met = steps.join(neighbour_mode(edges, labels, entity, period, label), [entity, period]).withColumn("same", F.col("now") == F.col("mode")).withColumn("moved", (F.col("now") != F.col("next")).cast("double"))
    one = met.agg(*[f for s, n in ((F.col("same"), "same"), (~F.col("same"), "other")) for f in (F.avg(F.when(s, F.col("moved"))).alias(f"p_{n}"), F.count(F.when(s, 1)).alias(f"n_{n}"))], F.avg("moved").alias("p"), F.avg(F.when(F.col("moved") == 1, (F.col("next") == F.col("mode")).cast("double"))).alias("to_mode"))
    z = F.try_divide(F.col("p_other") - F.col("p_same"), F.sqrt(F.col("p") * (1 - F.col("p")) * (F.try_divide(F.lit(1.0), "n_same") + F.try_divide(F.lit(1.0), "n_other"))))
    return one.select("p_same", "p_other", z.alias("z"), "to_mode")


def durable_events(labels: DataFrame, entity: str, period: str, label: str, horizon: int = 3) -> DataFrame:
    """(to, durable, blinking): changes that hold for ``horizon`` periods, and those that don't, of uncensored ones."""
    t = transitions(labels.withColumn("c_", F.lit(1.0)), entity, period, label, "c_", horizon).where(~F.col("censored"))
    return t.groupBy("to").agg(F.sum(F.col("persists").cast("long")).alias("durable"), F.sum((~F.col("persists")).cast("long")).alias("blinking"))


def contrasts(df: DataFrame, label: str, columns: list[str], top: int) -> DataFrame:
    """(label, name, z, low, high): the ``top`` columns of each type by absolute mean z (sample sd), with their 10-90 % interval."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns])
    own = df.groupBy(label).agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}_a"), F.percentile(c, F.lit(0.1)).alias(f"{c}_l"), F.percentile(c, F.lit(0.9)).alias(f"{c}_h"))])
    cell = lambda c: F.struct(F.lit(c).alias("name"), F.try_divide(F.col(f"{c}_a") - F.col(f"{c}_m"), F.col(f"{c}_s")).alias("z"), F.col(f"{c}_l").alias("low"), F.col(f"{c}_h").alias("high"))
    rows = own.crossJoin(F.broadcast(stats)).select(label, F.explode(F.array(*[cell(c) for c in columns])).alias("r")).select(label, "r.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.round(F.abs("z"), 9).desc(), "name"))).where(F.col("rank") <= top)


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Rank correlation (ties averaged) for each value of ``by``."""
    ranks = df.select(by, S.average_rank(Window.partitionBy(by).orderBy(a)).alias("ra"), S.average_rank(Window.partitionBy(by).orderBy(b)).alias("rb"))
    return ranks.groupBy(by).agg(F.corr("ra", "rb").alias("rho"))


def item_f1(df: DataFrame, label: str, value: Column, items: dict[str, Column]) -> DataFrame:
    """(item, precision, recall, f1) of boolean items for one type."""
    hit = df.select((F.col(label) == value).alias("y"), *[c.alias(n) for n, c in items.items()])
    one = hit.agg(F.sum(F.col("y").cast("double")).alias("pos"), *[f for n in items for f in (F.sum(F.col(n).cast("double")).alias(f"{n}_n"), F.sum((F.col(n) & F.col("y")).cast("double")).alias(f"{n}_tp"))])
    cell = lambda n: F.struct(F.lit(n).alias("item"), F.try_divide(f"{n}_tp", f"{n}_n").alias("precision"), F.try_divide(f"{n}_tp", "pos").alias("recall"), F.try_divide(2 * F.col(f"{n}_tp"), F.col(f"{n}_n") + F.col("pos")).alias("f1"))
    return one.select(F.explode(F.array(*[cell(n) for n in items])).alias("r")).select("r.*")
