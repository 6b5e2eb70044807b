"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix, in DataFrame functions only.

1. Rows are dealt to virtual partitions by a keyed hash, with their position in the input as part of the key.
2. How many rows of partition p go to shard s is drawn exactly: a matrix with the partitions' counts as row sums and
   the shards' sizes as column sums, hypergeometric as the counts of a uniform permutation are. A tree of groups of FAN
   partitions keeps each chain of draws short: a group's share of every shard is drawn first, then that of its FAN parts, all
   groups of a level in parallel.
3. Rows are permuted inside their partition and cut by the matrix (``local permutation``), exchanged, and permuted
   again inside the shard: by buckets of a second key, whose counts give each bucket its first slot, so that no
   shard has to fit into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a virtual partition, and of a bucket inside a shard.
ROWS_PER_PART = 20_000
#: Children of a node in the tree of partitions.
FAN = 8
#: Half width, in standard deviations, of the support that a draw walks; beyond it lies less than a double resolves.
REACH = 9


def _uniform(*keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(draws: Column, good: Column, total: Column, u: Column) -> Column:
    """Good ones among ``draws`` from ``total`` of which ``good`` are good, by inversion at ``u``.

    Weights follow the ratio of neighbouring probabilities outwards from the mode, so no factorial is needed.
    """
    n, g, t = draws.cast("double"), good.cast("double"), total.cast("double")
    lo, hi = F.greatest(F.lit(0.0), n + g - t), F.least(n, g)
    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * (g + 1) / (t + 2)).cast("double")))
    sd = F.sqrt(F.greatest(F.lit(0.0), n * (g / F.greatest(t, F.lit(1.0))) * (1 - g / F.greatest(t, F.lit(1.0)))))
    reach = (F.lit(REACH) * sd).cast("long") + 12
    low, high = F.greatest(lo, mode - reach).cast("long"), F.least(hi, mode + reach).cast("long")

    def walk(ks: Column, ratio, before: Column, goal: Column) -> Column:
        """(sum of ``before`` and the weights at ``ks``, first of ``ks`` at which it reaches ``goal``)."""
        start = F.struct(F.lit(1.0).alias("w"), before.alias("sum"), F.lit(None).cast("bigint").alias("k"))

        def step(acc: Column, k: Column) -> Column:
            w = acc["w"] * ratio(k.cast("double"))
            return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.coalesce(acc["k"], F.when(acc["sum"] + w >= goal, k.cast("bigint"))).alias("k"))

        return F.aggregate(ks, start, step, lambda acc: F.struct(acc["sum"].alias("sum"), acc["k"].alias("k")))

    none = F.array().cast("array<bigint>")
    m = mode.cast("long")
    up = F.when(high > m, F.sequence(m + 1, high)).otherwise(none)
    down = F.when(low < m, F.sequence(m - 1, low, F.lit(-1).cast("long"))).otherwise(none)
    rise = lambda k: (g - k + 1) * (n - k + 1) / (k * (t - g - n + k))
    fall = lambda k: (k + 1) * (t - g - n + k + 1) / ((g - k) * (n - k))

    def draw(total: Column) -> Column:
        """From the mode up, then from the mode down: any fixed order of the support will do for inversion."""
        goal = u * total
        over = walk(up, rise, F.lit(1.0), goal)
        under = walk(down, fall, over["sum"], goal)
        return F.when(goal <= 1, m).otherwise(F.coalesce(over["k"], under["k"], m))

    never = F.lit(float("inf"))
    total = walk(down, fall, walk(up, rise, F.lit(1.0), never)["sum"], never)["sum"]
    return F.aggregate(F.array(total), F.lit(0).cast("bigint"), lambda _, x: draw(x))


def communication_matrix(df: DataFrame, rows: str, columns: str, key: str, seed: int) -> DataFrame:
    """Adds ``matrix``: for each entry of ``rows`` an array with how many go to each of ``columns``.

    ``rows`` array<struct<p bigint, n bigint>>, ``columns`` array<bigint>; both sum to the same total. Each row of
    the matrix is a multivariate hypergeometric draw from what the rows before it left of the columns.
    """

    def one(acc: Column, row: Column) -> Column:
        left = acc["left"]
        start = F.struct(row["n"].alias("n"), F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("t"), F.array().cast("array<bigint>").alias("got"))

        def cell(a: Column, g: Column) -> Column:
            x = hypergeometric(a["n"], g, a["t"], _uniform(F.col(key), row["p"], F.size(a["got"]), F.lit(seed)))
            return F.aggregate(F.array(x), a, lambda a, x: F.struct((a["n"] - x).alias("n"), (a["t"] - g).alias("t"), F.array_append(a["got"], x).alias("got")))

        got = F.aggregate(left, start, cell, lambda a: a["got"])
        return F.aggregate(F.array(got), acc, lambda acc, got: F.struct(F.zip_with(acc["left"], got, lambda a, b: a - b).alias("left"), F.array_append(acc["all"], F.struct(row["p"].alias("p"), got.alias("to"))).alias("all")))

    start = F.struct(F.col(columns).alias("left"), F.array().cast("array<struct<p:bigint,to:array<bigint>>>").alias("all"))
    return df.withColumn("matrix", F.aggregate(F.col(rows), start, one, lambda a: a["all"]))


def shard(df: DataFrame, n_shards: int, seed: int = 7, rows_per_part: int = ROWS_PER_PART, fan: int = FAN) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one at most, the first ones being larger. Nulls, repeated rows and ties need no care, as a
    row is known by its position. An empty table gives an empty table. Columns of the input named ``shard`` or
    ``slot`` are replaced; other names are kept, whatever they are.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    base = materialise(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r"), F.monotonically_increasing_id().alias("id")), "numbered")
    total = base.count()
    parts = max(1, math.ceil(total / rows_per_part))
    dealt = base.select("r", "id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).alias("p"), F.xxhash64("id", F.lit(seed + 1)).alias("u"))
    counts = materialise(dealt.groupBy("p").agg(F.count("*").cast("bigint").alias("n")), "counts")

    sizes = F.array(*[F.lit(total // n_shards + (s < total % n_shards)).cast("bigint") for s in range(n_shards)])
    to = spark.range(1).select(F.col("id").alias("p"), sizes.alias("to"))
    levels = next(k for k in range(1, 64) if fan**k >= parts)
    for level in range(1, levels + 1):
        # One row for each node of the level above, with its children's counts and its own share of the shards.
        node = counts.groupBy(F.expr(f"p div {fan ** (levels - level)}").alias("p")).agg(F.sum("n").cast("bigint").alias("n"))
        entry = F.struct("p", "n")
        above = node.groupBy(F.expr(f"p div {fan}").alias("key")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        above = above.join(to.select(F.col("p").alias("key"), F.col("to").alias("cols")), "key")
        above = above.repartition(max(1, min(fan ** (level - 1), parts // fan)), "key")  # small rows, long draws: not to be coalesced
        drawn = communication_matrix(above, "rows", "cols", "key", seed + 16 + level)
        to = materialise(drawn.select(F.explode("matrix").alias("m")).select(F.col("m.p").alias("p"), F.col("m.to").alias("to")), "matrix")
    ends = F.aggregate(F.col("to"), F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint"))))
    cuts = materialise(to.select("p", ends.alias("ends")), "cuts")

    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy("u", "id")) - 1)
    buckets = max(1, math.ceil(total / n_shards / rows_per_part))
    sent = ranked.join(cuts, "p").select("r", "id", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("s"), F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(buckets)).alias("b"), F.xxhash64("id", F.lit(seed + 5)).alias("v"))
    sent = materialise(sent, "sent")
    firsts = sent.groupBy("s", "b").agg(F.count("*").alias("n"))
    firsts = firsts.select("s", "b", (F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).alias("first"))
    placed = sent.withColumn("at", F.row_number().over(Window.partitionBy("s", "b").orderBy("v", "id")) - 1).join(firsts, ["s", "b"])
    return placed.select(*[F.col("r").getField(c).alias(c) for c in kept], F.col("s").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot"))
