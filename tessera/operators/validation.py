"""Cross-validated prediction, threshold trees, and planted networks with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def folds(key: Column, k: int, seed: int = 42) -> Column:
    """0 to k - 1 by a hash: of the row's id, or of its group for folds that keep groups whole."""
    return F.floor(S.md5_uniform(F.lit(str(seed)), key.cast("string")) * k).cast("int")


def ridge_cv(df: DataFrame, target: str, columns: list[str], fold: str, alpha: float = 10.0) -> DataFrame:
    """(fold, n, mae, r2) of ridge regression with penalty ``alpha`` on unscaled columns and a free intercept.

    One aggregate gives each fold's sums of products; a training set is all folds less one, so it is solved on the driver
    from (columns + 2)^2 numbers. r2 is against the training mean.
    """
    import numpy as np

    z = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(target).cast("double")]
    n = len(z)
    sums = [F.sum(z[i] * z[j]) for i in range(n) for j in range(i, n)]
    grams = {}
    for row in df.groupBy(fold).agg(*sums).collect():
        g = np.zeros((n, n))
        g[np.triu_indices(n)] = row[1:]
        grams[row[0]] = g + np.triu(g, 1).T
    total = sum(grams.values())
    guess, mean = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f, g in grams.items():
        g = total - g
        if g[0, 0] == 0:
            continue
        m = g[0, 1:] / g[0, 0]
        c = g[1:, 1:] - g[0, 0] * np.outer(m, m)
        w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(n - 2), c[:-1, -1])
        here = F.col(fold) == f
        guess = F.when(here, sum((z[i + 1] * float(v) for i, v in enumerate(w)), F.lit(float(m[-1] - w @ m[:-1])))).otherwise(guess)
        mean = F.when(here, float(m[-1])).otherwise(mean)
    return _scores(df.withColumn("guess_", guess).withColumn("mean_", mean), target, fold)


def _scores(df: DataFrame, target: str, fold: str) -> DataFrame:
    e, d = F.col(target) - F.col("guess_"), F.col(target) - F.col("mean_")
    return df.groupBy(F.col(fold).alias("fold")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.sum(d * d))).alias("r2"))


def boosted_cv(df: DataFrame, target: str, columns: list[str], fold: str, k: int) -> DataFrame:
    """(fold, n, mae, r2) of boosted trees, one model for each fold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.select(fold, target, *columns)).select(fold, target, "features").persist()
    out = None
    for f in range(k):
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        mean = train.agg(F.avg(target)).first()[0]
        if mean is None:
            continue
        model = GBTRegressor(labelCol=target, predictionCol="guess_", maxDepth=3, maxIter=10, seed=42).fit(train)
        one = _scores(model.transform(test).withColumn("mean_", F.lit(mean)), target, fold)
        out = one if out is None else out.unionByName(one)
    return out


def threshold_tree(df: DataFrame, vector: str, size: int, label: str, centers: dict[int, list[float]], steps: int = 97) -> list[tuple]:
    """Splits (node, coordinate, threshold, mistakes) of a tree with one leaf for each centre: at each node, of the thresholds
    that part its centres, the one with fewest of the node's rows on the other side than their own centre. Thresholds are quantiles
    of the node's rows, 0.02 to 0.98. A node takes two aggregates; size x steps x centres counts reach the driver."""
    qs = [0.02 + 0.96 * i / (steps - 1) for i in range(steps)]
    out: list[tuple] = []

    def split(node: str, codes: list[int], where: Column) -> None:
        if len(codes) < 2:
            return
        rows = df.where(where)
        found = rows.agg(*[F.percentile(F.col(vector)[i], F.array(*[F.lit(q) for q in qs])).alias(f"q{i}") for i in range(size)]).first()
        cuts = [sorted(set(found[i] or [])) for i in range(size)]
        options = [(i, t) for i in range(size) for t in cuts[i] if 0 < sum(centers[c][i] <= t for c in codes) < len(codes)]
        if not options:
            return
        known = F.array(*[F.array(*[F.lit(float(t)) for t in c]) for c in cuts])
        binned = rows.select(label, F.posexplode(vector).alias("i", "v")).where(F.col("i") < size).withColumn("b", F.size(F.filter(F.get(known, F.col("i")), lambda c: c < F.col("v"))))
        counts: dict[tuple, int] = {(r.i, r[label], r.b): r.n for r in binned.groupBy("i", label, "b").agg(F.count("*").alias("n")).collect()}

        def wrong(i: int, t: float) -> int:
            upto = cuts[i].index(t)
            return sum(n for (at, c, b), n in counts.items() if at == i and (centers[c][i] <= t) != (b <= upto))

        row = [wrong(i, t) for i, t in options]
        best = min(range(len(options)), key=lambda j: (row[j], options[j]))
        i, t = options[best]
        out.append((node, i, t, row[best]))
        below = F.col(vector)[i] <= t
        split(f"{node}0", [c for c in codes if centers[c][i] <= t], where & below)
        split(f"{node}1", [c for c in codes if centers[c][i] > t], where & ~below)

    split("", sorted(centers), F.lit(True))
    return out


def tree_type(vector: str, splits: list[tuple], centers: dict[int, list[float]]) -> Column:
    """The code at the leaf of a ``threshold_tree`` that a row falls into; the lowest where centres could not be parted."""
    at = {n: (i, t) for n, i, t, _ in splits}

    def leaf(node: str, codes: list[int]) -> Column:
        if node not in at:
            return F.lit(codes[0])
        i, t = at[node]
        return F.when(F.col(vector)[i] <= t, leaf(f"{node}0", [c for c in codes if centers[c][i] <= t])).otherwise(leaf(f"{node}1", [c for c in codes if centers[c][i] > t]))

    return leaf("", sorted(centers))


def planted(spark: SparkSession, n: int, k: int, periods: int, size: int, seed: int, migrants: float = 0.1, event: int = 2, noise: float = 0.6) -> DataFrame:
    """(id, t, x, truth): entities of k types with Gaussian features around type means; from ``event`` on a share of them is of the
    next type. All draws are hashes, so a partition can be made again alone."""
    s = str(seed)
    u = lambda *key: S.md5_uniform(F.lit(s), *[x if isinstance(x, Column) else F.lit(str(x)) for x in key])
    rows = spark.range(n).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    ident = F.col("id").cast("string")
    first = F.floor(u("type", ident) * k).cast("int")
    truth = F.when((u("move", ident) < migrants) & (F.col("t") >= event), (first + 1) % k).otherwise(first)
    rows = rows.withColumn("truth", truth)
    when = F.concat_ws("/", ident, F.col("t").cast("string"))

    def gauss(i: int) -> Column:
        a, b = u(f"a{i}", when), u(f"b{i}", when)
        return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * 3.141592653589793 * b)

    centre = [F.when(F.col("truth") % size == i, 2.0).otherwise(0.0) for i in range(size)]
    return rows.select("id", "t", F.array(*[centre[i] + noise * gauss(i) for i in range(size)]).alias("x"), "truth")
