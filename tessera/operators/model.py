"""Types shared by all periods: pooled k-means, penalised paths, renumbering, margins, matching, inductive and cold-start assignment."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def _nearest(vector: str, centers: list[list[float]]) -> Column:
    """Code of the nearest centre, the lowest among equals. Centres are few and short: literals of the plan."""
    ds = [F.struct(F.round(S.squared_distance(F.col(vector), F.array(*[F.lit(v) for v in c])), 9).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)]
    return F.array_min(F.array(*ds))["c"]


def lloyd(df: DataFrame, vector: str, size: int, k: int, key: Column, iterations: int = 5, seed: int = 42) -> list[list[float]]:
    """Centres of pooled k-means from a fixed start: the k rows of the smallest MD5 of ``key``. Means are rounded to nine
    digits each round; an empty cluster keeps its centre. k x size numbers reach the driver."""
    rows = df.select(F.col(vector).alias("v"), F.md5(F.concat_ws("|", F.lit(str(seed)), key)).alias("h")).orderBy("h").limit(k).collect()
    centers = [[float(x) for x in r.v] for r in sorted(rows, key=lambda r: r.h)]
    for _ in range(iterations):
        means = df.groupBy(_nearest(vector, centers).alias("c")).agg(F.array(*[F.round(F.avg(F.col(vector)[i]), 9) for i in range(size)]).alias("v")).collect()
        found = {r.c: list(r.v) for r in means}
        centers = [found.get(i, c) for i, c in enumerate(centers)]
    return centers


def center_distances(df: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """Adds ``d``: squared distances to all centres, rounded to nine digits."""
    return df.withColumn("d", F.array(*[F.round(S.squared_distance(F.col(vector), F.array(*[F.lit(v) for v in c])), 9) for c in centers]))


def switch_penalty(df: DataFrame, weight: float) -> float:
    """``weight`` times the median of the nearest distances."""
    return round(weight * (df.agg(F.median(F.array_min("d"))).first()[0] or 0.0), 9)


def viterbi(df: DataFrame, entity: str, period: str, penalty: float, k: int) -> DataFrame:
    """(entity, period, type, cost): the path that minimises distances plus ``penalty`` for each switch, one fold forth and one
    back over an entity's sorted periods. A path stays where that is not dearer; it switches from the lowest of the cheapest codes."""
    pen, codes = F.lit(float(penalty)), F.sequence(F.lit(0), F.lit(k - 1))
    seq = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(period, "d"))).alias("s"))
    first = F.struct(F.col("s")[0]["d"].alias("cost"), F.array().cast("array<array<int>>").alias("back"))

    def step(acc: Column, x: Column) -> Column:
        best = F.array_min(acc["cost"])
        source = (F.array_position(acc["cost"], best) - 1).cast("int")
        cost = F.zip_with(x["d"], acc["cost"], lambda d, c: d + F.least(c, best + pen))
        back = F.transform(codes, lambda i: F.when(F.get(acc["cost"], i) <= best + pen, i).otherwise(source).cast("int"))
        return F.struct(cost.alias("cost"), F.array_append(acc["back"], back).alias("back"))

    folded = seq.withColumn("f", F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), first, step))
    total = F.array_min("f.cost")
    last = (F.array_position(F.col("f.cost"), total) - 1).cast("int")
    path = F.reverse(F.aggregate(F.reverse("f.back"), F.array(last), lambda p, b: F.array_append(p, F.get(b, F.element_at(p, -1)))))
    return folded.select(entity, F.explode(F.arrays_zip(F.transform("s", lambda x: x[period]).alias("p"), path.alias("t"))).alias("r"), F.round(total, 6).alias("cost")).select(entity, F.col("r.p").alias(period), F.col("r.t").alias("type"), "cost")


def renumbered(labels: DataFrame, period: str, label: str, k: int) -> DataFrame:
    """Codes by size in the last period, larger first, then by code; empty codes last."""
    last = labels.agg(F.max(period).alias("m"))
    sizes = labels.join(F.broadcast(last), F.col(period) == F.col("m")).groupBy(label).count()
    codes = labels.sparkSession.range(k).select(F.col("id").cast("int").alias(label)).join(sizes, label, "left")
    order = codes.select(label, (F.row_number().over(Window.orderBy(F.coalesce("count", F.lit(0)).desc(), label)) - 1).cast("int").alias("new_"))  # k rows
    return labels.join(F.broadcast(order), label).withColumn(label, F.col("new_")).drop("new_")


def assigned_margin(df: DataFrame, label: str) -> DataFrame:
    """Adds ``margin`` = (alternative - own) / (sum), signed, and ``alternative``, the nearest other code."""
    others = F.filter(F.transform("d", lambda d, i: F.struct(d.alias("d"), i.alias("c"))), lambda s: s["c"] != F.col(label))
    own, alt = F.get("d", F.col(label)), F.array_min(others)
    return df.withColumn("alternative", alt["c"]).withColumn("margin", (alt["d"] - own) / (alt["d"] + own + 1e-12))


def assignment(cost: list[list]) -> list[int]:
    """The column of each row so that columns differ and the sum of costs is least. Rows are taken in one by one, each along the
    cheapest alternating path, found with prices that keep reduced costs from falling under zero; rows may not outnumber columns.
    Costs may be whole numbers of any size, so that ties can be broken in them."""
    n, m = len(cost), len(cost[0]) if cost else 0
    row_price, col_price, holder = [0] * n, [0] * m, [-1] * m
    for new in range(n):
        reach: list = [None] * m  # (distance, column before) of each column
        done, row, at, far = set(), new, -1, 0
        while True:
            for j in range(m):
                if j not in done:
                    d = far + cost[row][j] - row_price[row] - col_price[j]
                    if reach[j] is None or d < reach[j][0]:
                        reach[j] = (d, at)
            at = min((j for j in range(m) if j not in done), key=lambda j: reach[j][0])
            far = reach[at][0]
            if holder[at] < 0:
                break
            done.add(at)
            row = holder[at]
        row_price[new] += far
        for j in done:
            row_price[holder[j]] += far - reach[j][0]
            col_price[j] -= far - reach[j][0]
        while at >= 0:
            before = reach[at][1]
            holder[at] = holder[before] if before >= 0 else new
            at = before
    return [holder.index(i) for i in range(n)]


def canonical(labels: DataFrame, entity: str, period: str, label: str, least: float = 0.3) -> DataFrame:
    """(entity, period, label) with one code for a type through time: a period's types take the codes of the period before by the
    one-to-one map of the largest sum of Jaccard overlaps; where its overlap is under ``least``, or where there are more types than
    before, a type gets a new code. Counts of pairs of types by period reach the driver, never entities."""
    w = Window.partitionBy(entity).orderBy(period)
    steps = labels.select(entity, F.col(period).alias("p"), F.col(label).alias("c"), F.lag(label).over(w).alias("b"), F.lag(period).over(w).alias("pb"))
    counts = steps.groupBy("p", "c", "pb", "b").agg(F.count("*").alias("n")).collect()
    periods = sorted({r.p for r in counts})
    codes: dict = {}
    fresh = 0
    for before, p in zip([None, *periods], periods, strict=False):
        here = sorted({r.c for r in counts if r.p == p})
        past = sorted({c for q, c in codes if q == before}, key=lambda c: codes[before, c]) if before is not None else []
        size = lambda q, c: sum(r.n for r in counts if r.p == q and r.c == c)
        both = {(r.c, r.b): r.n for r in counts if r.p == p and r.pb == before}
        j = [[(n := both.get((c, b), 0)) / (size(p, c) + size(before, b) - n) for b in past] + [0.0] * len(here) for c in here]
        found = assignment([[-x for x in row] for row in j]) if past else [0] * len(here)
        for i, c in enumerate(here):
            if p == periods[0]:
                codes[p, c] = c
            elif found[i] < len(past) and j[i][found[i]] >= least:
                codes[p, c] = codes[before, past[found[i]]]
            else:
                codes[p, c], fresh = fresh, fresh + 1
        if p == periods[0]:
            fresh = max(here) + 1
    kinds = {c: labels.schema[c].dataType.simpleString() for c in (period, label)}
    table = labels.sparkSession.createDataFrame([(p, c, n) for (p, c), n in codes.items()], f"{period} {kinds[period]}, {label} {kinds[label]}, code_ int")
    return labels.join(F.broadcast(table), [period, label]).select(entity, period, F.col("code_").alias(label))


def match_labels(pairs: DataFrame, reference: str, candidate: str, k: int) -> DataFrame:
    """(candidate, reference): the one-to-one map of the largest overlap, the lexicographically first among equals; the k x k
    counts reach the driver."""
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy(reference, candidate).count().collect()}
    first = lambda c, p: p * k ** (k - 1 - c)  # noqa: E731  less than one unit of overlap in all
    best = assignment([[first(c, p) - counts.get((p, c), 0) * k ** (k + 1) for p in range(k)] for c in range(k)])
    return pairs.sparkSession.createDataFrame(list(enumerate(best)), f"{candidate} int, {reference} int")


def pattern_labels(df: DataFrame, vector: str, size: int, label: str = "pattern") -> DataFrame:
    """Dense code of which coordinates' percentile ranks (over all rows, ties averaged) exceed which others'."""
    ranked = df
    for i in range(size):
        ranked = ranked.withColumn(f"r{i}", S.average_rank(Window.orderBy(F.col(vector)[i])))
    code = F.lit(0)
    bit = 0
    for a in range(size):
        for b in range(a + 1, size):
            code = code + F.shiftleft((F.col(f"r{a}") > F.col(f"r{b}")).cast("int"), bit)
            bit += 1
    return ranked.withColumn("code_", code).withColumn(label, F.dense_rank().over(Window.orderBy("code_")) - 1).drop("code_", *[f"r{i}" for i in range(size)])


def select_k(table: DataFrame, min_share: float = 0.03, min_ari: float = 0.85) -> DataFrame:
    """The largest eligible K; where none is, that of the best ARI."""
    ok = (F.col("min_share") >= min_share) & (F.col("ari") >= min_ari)
    return table.agg(F.coalesce(F.max(F.when(ok, F.col("k"))), F.max_by("k", "ari")).alias("k"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("eligible"))
