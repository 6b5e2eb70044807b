"""Queries of the model layer: pooled centres, penalised paths, margins, matching, patterns, selection rules, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import graph, model
from tessera.sources.scratch import written

from . import base as B
from .catalogue import query

K = B.TYPES
PENALTY = 0.3
RAW, SMOOTH = B.kmeans("km", "sc"), B.kmeans("ks", "sm")
DAY = "CAST(q AS VARCHAR) AS q"


def fitted(rows: DataFrame) -> DataFrame:
    """(tid, q, x, d) of pooled k-means on ``rows``, which are written first, as every round reads them."""
    rows = written(rows, "rows")
    centers = model.lloyd(rows, "x", B.SIZE, K, F.concat_ws("|", F.col("tid").cast("string"), F.date_format("q", "yyyy-MM-dd")))
    return model.center_distances(rows, "x", centers)


def paths_sql(d: str) -> str:
    """Recursive steps: pn (penalty), sq (sequence), fw (forward), bk (tid, i, t from 1, total), rn (new codes)."""
    return f"""pn AS (SELECT round({PENALTY} * median(list_min(d)), 9) AS pen FROM {d}),
    sq AS (SELECT tid, q, d, row_number() OVER (PARTITION BY tid ORDER BY q) AS i FROM {d}),
    fw AS (SELECT tid, i, d AS cost, CAST([] AS BIGINT[]) AS back FROM sq WHERE i = 1 UNION ALL
      SELECT s.tid, s.i, [s.d[k] + least(f.cost[k], list_min(f.cost) + pen) for k in range(1, {K + 1})], [CASE WHEN f.cost[k] <= list_min(f.cost) + pen THEN k ELSE CAST(list_position(f.cost, list_min(f.cost)) AS BIGINT) END for k in range(1, {K + 1})]
      FROM fw f JOIN sq s ON s.tid = f.tid AND s.i = f.i + 1, pn),
    bk AS (SELECT tid, i, CAST(list_position(cost, list_min(cost)) AS BIGINT) AS t, list_min(cost) AS total FROM fw WHERE i = (SELECT max(i) FROM sq) UNION ALL
      SELECT b.tid, b.i - 1, f.back[b.t], b.total FROM bk b JOIN fw f ON f.tid = b.tid AND f.i = b.i WHERE b.i > 1),
    rn AS (SELECT code, row_number() OVER (ORDER BY coalesce(n, 0) DESC, code) - 1 AS new FROM range(0, {K}) r(code) LEFT JOIN (SELECT t - 1 AS code, count(*) AS n FROM bk WHERE i = (SELECT max(i) FROM sq) GROUP BY 1) USING (code))"""


@query(B.steps(f"SELECT code, n, round(m, 6) AS mean_distance FROM (SELECT list_position(d, list_min(d)) - 1 AS code, count(*) AS n, avg(list_min(d)) AS m FROM {RAW} GROUP BY 1)", RAW))
def kmeans_lloyd_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fitted(B.scaled(spark, sf_dir))
    low = F.array_min("d")
    return d.groupBy((F.array_position("d", low) - 1).cast("int").alias("code")).agg(F.count("*").alias("n"), B.r(F.avg(low)).alias("mean_distance"))


@query(B.steps(f"SELECT tid, {DAY}, {', '.join(f'round(d[{i + 1}], 6) AS d{i}' for i in range(K))} FROM {RAW}", RAW))
def center_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(B.scaled(spark, sf_dir)).select("tid", B.day("q"), *[B.r(F.col("d")[i]).alias(f"d{i}") for i in range(K)])


@query(B.steps(f"SELECT tid, {DAY}, CAST(t - 1 AS INTEGER) AS type, round(total, 6) AS cost FROM bk JOIN sq USING (tid, i)", RAW, recursive=paths_sql(RAW)))
def viterbi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fitted(B.scaled(spark, sf_dir))
    return model.viterbi(d, "tid", "q", model.switch_penalty(d, PENALTY), K).select("tid", B.day("q"), "type", "cost")


def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, q, d, type): smoothed features, pooled centres, penalised paths, codes by size in the last window."""
    plain = B.scaled(spark, sf_dir)
    return fit_rows(graph.smoothed(plain, B.edges(spark, sf_dir, rows=plain), "q", "tid", "x", B.SIZE))


def fit_rows(rows: DataFrame) -> DataFrame:
    """The fit of features (tid, q, x) as they are."""
    d = written(fitted(rows), "distances")
    paths = model.viterbi(d, "tid", "q", model.switch_penalty(d, PENALTY), K).select("tid", "q", F.col("type").alias("old"), "type")
    return model.renumbered(paths, "q", "type", K).join(d.select("tid", "q", "d"), ["tid", "q"])


FIT = paths_sql(SMOOTH)


@query(B.steps(f"SELECT tid, {DAY}, CAST(rn.new AS INTEGER) AS type FROM bk JOIN sq USING (tid, i) JOIN rn ON rn.code = t - 1", SMOOTH, recursive=FIT))
def fit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir).select("tid", B.day("q"), "type")


@query(
    B.steps(
        f"""SELECT tid, {DAY}, round((alt.d - own) / (alt.d + own + 1e-12), 6) AS margin, CAST(alt.c AS INTEGER) AS alternative FROM
        (SELECT tid, q, d[t] AS own, list_min(list_filter([{{'d': d[k], 'c': k - 1}} for k in range(1, {K + 1})], lambda s: s.c <> t - 1)) AS alt FROM bk JOIN sq USING (tid, i))""",
        SMOOTH, recursive=FIT,
    )
)
def assigned_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.assigned_margin(fit(spark, sf_dir), "old").select("tid", B.day("q"), B.r("margin").alias("margin"), F.col("alternative").cast("int").alias("alternative"))


@query(
    B.steps(
        f"""SELECT CAST(c AS INTEGER) AS candidate, CAST(p[c + 1] AS INTEGER) AS reference FROM (SELECT p FROM (SELECT p, sum(coalesce(n, 0)) AS s FROM perms, range(0, 3) r(c) LEFT JOIN cnt ON cnt.a = p[c + 1] AND cnt.b = c GROUP BY p) ORDER BY s DESC, p LIMIT 1), range(0, 3) r(c)""",
        "ty",
        recursive="cnt AS (SELECT a, b, count(*) AS n FROM (SELECT ty % 3 AS a, lag(ty % 3) OVER (PARTITION BY tid ORDER BY q) AS b FROM ty) WHERE b IS NOT NULL GROUP BY ALL), perms AS (SELECT [x, y, z] AS p FROM range(0, 3) a(x), range(0, 3) b(y), range(0, 3) c(z) WHERE x <> y AND y <> z AND x <> z)",
    )
)
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tid").orderBy("q")
    code = (F.col("ty") % 3).cast("int")
    pairs = B.types(spark, sf_dir).select(code.alias("reference"), F.lag(code).over(w).alias("candidate")).where("candidate is not null")
    return model.match_labels(pairs, "reference", "candidate", 3)


_RANK = ", ".join(f"rank() OVER (ORDER BY x[{i}]) + (count(*) OVER (PARTITION BY x[{i}]) - 1) / 2.0 AS r{i}" for i in range(2, 6))
_BITS = " + ".join(f"CAST(r{a} > r{b} AS INTEGER) * {1 << n}" for n, (a, b) in enumerate((a, b) for a in range(2, 6) for b in range(a + 1, 6)))


@query(B.steps(f"SELECT tid, {DAY}, CAST(dense_rank() OVER (ORDER BY code) - 1 AS INTEGER) AS pattern FROM (SELECT tid, q, {_BITS} AS code FROM (SELECT tid, q, {_RANK} FROM wf))", "wf"))
def pattern_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.windows(spark, sf_dir).withColumn("v", F.slice("x", 2, 4))
    return model.pattern_labels(parts, "v", 4).select("tid", B.day("q"), F.col("pattern").cast("int").alias("pattern"))


@query(
    """SELECT coalesce(max(CASE WHEN min_share >= 0.03 AND ari >= 0.85 THEN k END), arg_max(k, ari)) AS k, CAST(sum(CASE WHEN min_share >= 0.03 AND ari >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS eligible
    FROM (SELECT p_size % 6 + 2 AS k, min(p_retailprice) / max(p_retailprice) AS min_share, 0.8 + (p_size % 6) / 30.0 AS ari FROM part GROUP BY 1, 3)"""
)
def k_selection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("p_size") % 6
    t = B.table(spark, sf_dir, "part").groupBy((g + 2).alias("k"), (0.8 + g / 30.0).alias("ari")).agg((F.min("p_retailprice") / F.max("p_retailprice")).alias("min_share"))
    return model.select_k(t)


@query(
    """SELECT months, n, round(hit / n, 6) AS agreement, round(CASE WHEN n > 0 THEN (hit / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(hit / n * (1 - hit / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) ELSE 0 END, 6) AS wilson_low
    FROM (SELECT user_id % 4 * 3 + 6 AS months, count(*) AS n, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS DOUBLE) AS hit FROM events GROUP BY 1)"""
)
def wilson_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4 * 3 + 6).alias("months")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 20).cast("double")).alias("hit"))
    return e.select("months", "n", B.r(F.col("hit") / F.col("n")).alias("agreement"), B.r(S.wilson_lower(F.col("hit"), F.col("n"))).alias("wilson_low"))


_COLD = f"""lastq AS (SELECT max(q) AS q FROM wf), train AS (SELECT tid, x FROM sc WHERE q = (SELECT q FROM lastq)),
    part_ AS (SELECT tid, [f0, {', '.join(f'l{i} - ({B._LOGS}) / 6.0' for i in range(1, 7))}] AS x FROM (SELECT tid, ln(lvl) AS f0, {', '.join(f'ln(greatest(s{i} / ({B._PLUS}), 1e-6)) AS l{i}' for i in range(1, 7))} FROM
      (SELECT tid, avg(total) AS lvl, {', '.join(f'sum(p{i}) AS s{i}' for i in range(1, 7))} FROM cp WHERE q >= (SELECT q FROM lastq) - INTERVAL 3 MONTH GROUP BY tid))),
    asked AS (SELECT tid, [greatest(-4.0, least(4.0, (x[i] - m[i]) / s[i])) * sqrt(1.0 / 7) for i in range(1, 8)] AS x FROM part_, sl),
    found AS (SELECT a.tid, t.tid AS near, round(list_distance(a.x, t.x), 12) AS d FROM asked a JOIN train t ON a.tid <> t.tid QUALIFY row_number() OVER (PARTITION BY a.tid ORDER BY d, near) <= 5),
    votes AS (SELECT f.tid, ty, count(*) AS n FROM found f JOIN ty ON ty.tid = f.near AND ty.q = (SELECT q FROM lastq) GROUP BY ALL)"""


@query(
    B.steps(
        """SELECT v.tid, v.ty AS guess, v.n AS votes, (v.ty = t.ty) AS agrees FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, ty) AS rn FROM votes) v JOIN ty t ON t.tid = v.tid AND t.q = (SELECT q FROM lastq) WHERE rn = 1""",
        "sc", "ty", "cp", "sl", recursive=_COLD,
    )
)
def cold_start_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of entities from two quarters alone: fitted statistics, five nearest full histories, modal type, lowest code on ties."""
    from tessera.operators import features

    full = B.windows(spark, sf_dir).persist()
    last = full.agg(F.max("q")).first()[0]
    stats = features.vector_stats(full, "x", B.SIZE)

    def fix(df: DataFrame) -> DataFrame:
        z = F.transform(F.arrays_zip(F.col("x").alias("v"), F.col("mean").alias("m"), F.col("sd").alias("s")), lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (c["v"] - c["m"]) / c["s"])) * F.lit((1 / B.SIZE) ** 0.5))
        return df.crossJoin(F.broadcast(stats)).select("tid", z.alias("x"))

    asked = fix(features.partial_profile(B.complete(spark, sf_dir).where(F.col("q") >= F.add_months(F.lit(last), -3)), "tid", "total", B.PARTS))
    train = fix(full.where(F.col("q") == F.lit(last))).withColumnsRenamed({"tid": "near", "x": "y"})
    # Entities to assign are few beside those of the model; their distances go by the same blocks as the graphs'.
    found = cross_nearest(asked, train.select(F.col("near").alias("tid"), F.col("y").alias("x")), 5)
    at = B.types(spark, sf_dir).where(F.col("q") == F.lit(last)).select("tid", "ty")
    votes = found.join(at.withColumnsRenamed({"tid": "near", "ty": "guess"}), "near").groupBy("tid", "guess").agg(F.count("*").alias("votes"))
    best = votes.withColumn("rn", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("votes"), "guess"))).where("rn = 1").drop("rn")
    return best.join(at, "tid").select("tid", "guess", "votes", (F.col("guess") == F.col("ty")).alias("agrees"))


def cross_nearest(asked: DataFrame, known: DataFrame, k: int, metric: str = "euclid") -> DataFrame:
    """(tid, near, d): the k nearest ``known`` (tid, x) of each of ``asked`` (tid, x), itself excluded, by pairs of blocks."""
    import numpy as np
    import pandas as pd

    part = lambda df, role: df.select(F.lit(0).alias("all_"), F.struct(F.lit(role).alias("role"), "tid").alias("e"), "x")
    both = part(asked, 0).unionByName(part(known, 1))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left[left.e.map(lambda e: e["role"]) == 0], right[right.e.map(lambda e: e["role"]) == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"tid": [], "near": [], "d": []})
        d = np.round(graph._distances(np.stack(a.x.to_numpy()), np.stack(b.x.to_numpy()), metric), 12)
        s, t = np.array([e["tid"] for e in a.e]), np.array([e["tid"] for e in b.e])
        d[s[:, None] == t[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(t, d.shape), d), axis=1)[:, :k]
        kept = np.take_along_axis(d, order, 1)
        ok = np.isfinite(kept)
        return pd.DataFrame({"tid": np.repeat(s, order.shape[1])[ok.ravel()], "near": t[order][ok], "d": kept[ok]})

    found = graph.block_pairs(both, "all_", "e", ["x"], run, "tid long, near long, d double")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("tid").orderBy("d", "near"))).where(F.col("rn") <= k).drop("rn", "all_")


@query(
    B.steps(
        """SELECT ty, CASE WHEN ty = (SELECT arg_max(ty, spend) FROM pr) THEN CASE WHEN wage > (SELECT median(wage) FROM pr) * 1.25 THEN 'high spending and balance' ELSE 'high spending' END
        WHEN ty = (SELECT arg_min(ty, spend) FROM pr) THEN 'low spending' WHEN share > 0.2 THEN 'specialised' ELSE 'mixed' END AS name, n, round(spend, 2) AS spend FROM pr""",
        "ty", "cp", "pl",
        recursive="pr AS (SELECT ty, count(*) AS n, median(total) AS spend, median(acctbal) AS wage, median(p1 / total) AS share FROM ty JOIN cp USING (tid, q) JOIN pl USING (tid) WHERE ty.q = (SELECT max(q) FROM ty) GROUP BY ty)",
    )
)
def semantic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of types from their profiles in the last window: extremes of spending first, then a specialised share."""
    t = B.types(spark, sf_dir)
    last = t.agg(F.max("q").alias("q"))
    met = t.join(F.broadcast(last), "q").join(B.complete(spark, sf_dir), ["tid", "q"]).join(B.places(spark, sf_dir), "tid")
    p = met.groupBy("ty").agg(F.count("*").alias("n"), F.median("total").alias("spend"), F.median("acctbal").alias("wage"), F.median(F.col("p1") / F.col("total")).alias("share"))
    one = p.agg(F.max_by("ty", "spend").alias("hi"), F.min_by("ty", "spend").alias("lo"), F.median("wage").alias("mid"))
    name = F.when(F.col("ty") == F.col("hi"), F.when(F.col("wage") > F.col("mid") * 1.25, "high spending and balance").otherwise("high spending")).when(F.col("ty") == F.col("lo"), "low spending").when(F.col("share") > 0.2, "specialised").otherwise("mixed")
    return p.crossJoin(F.broadcast(one)).select("ty", name.alias("name"), "n", B.r("spend", 2).alias("spend"))
