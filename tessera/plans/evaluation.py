"""Queries of quality indices, agreement, significance and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph, indices, stats

from . import base as B
from .catalogue import query

SIZE = 64
B.STEPS["en"] = (["ev"], "SELECT 0 AS q, a.id AS src, b.id AS dst, round(1 - list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 12) AS d FROM ev a JOIN ev b ON a.id <> b.id")
B._graph("eg", "en")
B.STEPS["el"] = (["eg", "ev"], "SELECT src, dst, w, a.label AS a, b.label AS b FROM eg JOIN ev a ON a.id = src JOIN ev b ON b.id = dst")
B.STEPS["es"] = (["ev"], "SELECT id, label, CAST(list_position(x[1:10], list_max(x[1:10])) - 1 AS INTEGER) AS other FROM ev")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vectors(spark, sf_dir).withColumn("q", F.lit(0))
    return graph.weighted_knn(graph.nearest(v, "q", "id", "x", B.NEAR), "q", B.NEAR, B.LEAST)


def two_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, other): the given label, and which of ten coordinates is the largest."""
    ten = F.slice("x", 1, 10)
    return B.vectors(spark, sf_dir).select("id", "label", (F.array_position(ten, F.array_max(ten)) - 1).cast("int").alias("other"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[B.r(c, digits).alias(c) for c in df.columns])


@query(
    B.steps(
        """SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS "SW" FROM (SELECT id, max(n) AS n, max(CASE WHEN own = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> label THEN s / m END) AS b FROM
        (SELECT a.id, a.label AS own, b.label, sum(list_distance(a.x, b.x)) AS s, count(*) AS m FROM ev a, ev b GROUP BY ALL) JOIN (SELECT label, count(*) AS n FROM ev GROUP BY 1) USING (label) GROUP BY id)""".replace("max(n) AS n", "max(CASE WHEN own = label THEN n END) AS n"),
        "ev",
    )
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.silhouette(B.vectors(spark, sf_dir), "id", "x", "label"))


_DIM = f"range(1, {SIZE + 1}) r(i)"


@query(
    B.steps(
        f"""SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS "CH" FROM (SELECT sum(n * (m - mu) * (m - mu)) AS b, sum(n * v) AS w FROM (SELECT label, i, count(*) AS n, avg(x[i]) AS m, var_pop(x[i]) AS v FROM ev, {_DIM} GROUP BY ALL) JOIN (SELECT i, avg(x[i]) AS mu FROM ev, {_DIM} GROUP BY i) USING (i)), (SELECT count(*) AS n, count(DISTINCT label) AS k FROM ev)""",
        "ev",
    )
)
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.calinski_harabasz(B.vectors(spark, sf_dir), "x", "label", SIZE))


@query(
    B.steps(
        f"""SELECT round((SELECT avg(v) FROM cl) / (SELECT sqrt(sum(v * v)) FROM (SELECT var_pop(x[i]) AS v FROM ev, {_DIM} GROUP BY i)) + (SELECT sum(mid / greatest(di, dj, 1)) FROM (SELECT i.label AS i, j.label AS j, di.n AS di, dj.n AS dj,
          (SELECT count(*) FROM ev WHERE label IN (i.label, j.label) AND list_distance(x, [(i.m[t] + j.m[t]) / 2 for t in range(1, {SIZE + 1})]) <= (SELECT std FROM sd)) AS mid FROM cl i JOIN cl j ON i.label <> j.label JOIN de di ON di.label = i.label JOIN de dj ON dj.label = j.label)) / (SELECT count(*) * (count(*) - 1) FROM cl), 6) AS "S_Dbw" """,
        "ev",
        recursive=f"""cl AS MATERIALIZED (SELECT label, list(m ORDER BY i) AS m, sqrt(sum(v * v)) AS v FROM (SELECT label, i, avg(x[i]) AS m, var_pop(x[i]) AS v FROM ev, {_DIM} GROUP BY ALL) GROUP BY label),
        sd AS MATERIALIZED (SELECT sqrt(sum(v)) / count(*) AS std FROM cl), de AS MATERIALIZED (SELECT cl.label, sum(CASE WHEN list_distance(x, m) <= std THEN 1 ELSE 0 END) AS n FROM cl JOIN ev ON ev.label = cl.label, sd GROUP BY cl.label)""",
    )
)
def s_dbw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.s_dbw(B.vectors(spark, sf_dir), "x", "label", SIZE))


@query(
    B.steps(
        """SELECT round(avi, 6) AS "AVI", round(avu, 6) AS "AVU", round(1 / (avu + 1 / avi), 6) AS "ANUI", round(mq, 6) AS "MQ", round(qq, 6) AS "Q" FROM
        (SELECT avg(own / deg) AS avi, avg(out / deg) AS avu FROM (SELECT src, sum(w) AS deg, sum(CASE WHEN a = b THEN w ELSE 0 END) AS own, max(CASE WHEN a <> b THEN w ELSE 0 END) AS out FROM (SELECT src, a, b, sum(w) AS w FROM el GROUP BY ALL) GROUP BY src)),
        (SELECT sum(own / tot) AS mq, sum(own / m2 - (tot / m2) * (tot / m2)) AS qq FROM (SELECT a, sum(w) AS tot, sum(CASE WHEN a = b THEN w ELSE 0 END) AS own FROM el GROUP BY a), (SELECT sum(w) AS m2 FROM el))""",
        "el",
    )
)
def graph_indices_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.graph_vertex(edges(spark, sf_dir), B.vectors(spark, sf_dir), "id", "label"))


@query(
    B.steps(
        """SELECT round(avi, 6) AS "AVI_ref", round(p / k, 6) AS "AVU_ref", round(1 / (p / k + 1 / avi), 6) AS "ANUI_ref", round(mq, 6) AS "MQ_ref" FROM (SELECT avg(own / tot) AS avi, sum(own / tot) AS mq, count(*) AS k FROM bl),
        (SELECT sum(s / (x.tot - x.own + y.tot - y.own - s)) AS p FROM (SELECT a, b, sum(w) AS s FROM el WHERE a <> b GROUP BY ALL) JOIN bl x USING (a) JOIN bl y ON y.a = b)""",
        "el", recursive="bl AS MATERIALIZED (SELECT a, sum(w) AS tot, sum(CASE WHEN a = b THEN w ELSE 0 END) AS own FROM el GROUP BY a)",
    )
)
def graph_indices_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.graph_blocks(edges(spark, sf_dir), B.vectors(spark, sf_dir), "id", "label"))


def _ari(cells: str, by: str = "") -> str:
    g, j = (f"{by}, ", f" USING ({by})") if by else ("", "")
    one = lambda c: f"(SELECT {g}sum(n * (n - 1) / 2.0) AS s{c}, sum(n) AS t FROM (SELECT {g}{c}, sum(n) AS n FROM {cells} GROUP BY ALL) {'GROUP BY ALL' if by else ''}) t{c}"
    join = "JOIN" if by else "CROSS JOIN"
    return f"""SELECT {g}round((s - sa * sb / (ta.t * (ta.t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (ta.t * (ta.t - 1) / 2.0)), 6) AS "ARI" FROM (SELECT {g}sum(n * (n - 1) / 2.0) AS s FROM {cells} {'GROUP BY ALL' if by else ''}) {join} {one('a')}{j} {join} {one('b')}{j}"""


@query(B.steps(_ari("ce"), "es", recursive="ce AS (SELECT label AS a, other AS b, CAST(count(*) AS DOUBLE) AS n FROM es GROUP BY ALL)"))
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.adjusted_rand(two_labels(spark, sf_dir), "label", "other"))


@query(
    B.steps(
        """SELECT round(2 * (ha + hb - hab) / (ha + hb), 6) AS "NMI" FROM (SELECT -sum(n / t * ln(n / t)) AS hab FROM ce, tt), (SELECT -sum(n / t * ln(n / t)) AS ha FROM (SELECT sum(n) AS n FROM ce GROUP BY a), tt), (SELECT -sum(n / t * ln(n / t)) AS hb FROM (SELECT sum(n) AS n FROM ce GROUP BY b), tt)""",
        "es", recursive="ce AS (SELECT label AS a, other AS b, CAST(count(*) AS DOUBLE) AS n FROM es GROUP BY ALL), tt AS (SELECT sum(n) AS t FROM ce)",
    )
)
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.normalised_mutual_information(two_labels(spark, sf_dir), "label", "other"))


@query(
    B.steps(
        """SELECT label, round(max(CASE WHEN label = other THEN j ELSE 0 END), 6) AS same, round(max(j), 6) AS best FROM (SELECT label, other, n / (sum(n) OVER (PARTITION BY label) + sum(n) OVER (PARTITION BY other) - n) AS j FROM (SELECT label, other, count(*) AS n FROM es GROUP BY ALL)) GROUP BY label""",
        "es",
    )
)
def cluster_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.cluster_jaccard(two_labels(spark, sf_dir), "label", "other").select("label", B.r("same").alias("same"), B.r("best").alias("best"))


@query(B.steps("SELECT round(avg(c), 6) AS churn, (SELECT round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END), 6) FROM (SELECT arg_min(ty, q) AS a, arg_max(ty, q) AS b FROM ty GROUP BY tid)) AS changed, (SELECT round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END), 6) FROM (SELECT count(DISTINCT ty) AS k FROM ty GROUP BY tid)) AS never FROM (SELECT q, avg(c) AS c FROM (SELECT q, CASE WHEN lag(ty) OVER w IS NULL THEN NULL WHEN lag(ty) OVER w <> ty THEN 1.0 ELSE 0.0 END AS c FROM ty WINDOW w AS (PARTITION BY tid ORDER BY q)) WHERE c IS NOT NULL GROUP BY q)", "ty"))
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.churn(B.types(spark, sf_dir), "tid", "q", "ty"))


REPS = 200
_Q = "SELECT replicate, sum(own / m2 - (tot / m2) * (tot / m2)) AS v FROM (SELECT replicate, a, sum(w) AS tot, sum(CASE WHEN a = b THEN w ELSE 0 END) AS own FROM (SELECT x.replicate, e.w, x.label AS a, y.label AS b FROM eg e JOIN pm x ON x.id = e.src JOIN pm y ON y.id = e.dst AND y.replicate = x.replicate) GROUP BY ALL), (SELECT sum(w) AS m2 FROM eg) GROUP BY replicate"


def _permuted_sql(rows: str, within: str = "") -> str:
    part = f", {within}" if within else ""
    return f"""pm AS MATERIALIZED (SELECT t.replicate, t.id, o.label FROM (SELECT *, row_number() OVER (PARTITION BY replicate{part} ORDER BY id) AS i FROM {rows}, range(1, {REPS + 1}) r(replicate)) t
    JOIN (SELECT *, row_number() OVER (PARTITION BY replicate{part} ORDER BY md5(concat_ws('|', '7', replicate, id)), id) AS i FROM {rows}, range(1, {REPS + 1}) r(replicate)) o USING (replicate, i{part})
    UNION ALL SELECT 0, id, label FROM {rows}), qs AS MATERIALIZED ({_Q})"""


_NULL = """SELECT round(v, 6) AS value, round(m, 6) AS null_mean, round(s, 6) AS null_sd, round((v - m) / (s + 1e-12), 4) AS z, round((1 + o) / (n + 1), 6) AS p FROM (SELECT v FROM qs WHERE replicate = 0),
(SELECT avg(q.v) AS m, stddev_pop(q.v) AS s, sum(CASE WHEN q.v >= z.v THEN 1 ELSE 0 END) AS o, count(*) AS n FROM qs q, (SELECT v FROM qs WHERE replicate = 0) z WHERE q.replicate > 0)"""


def _modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """(replicate, v): Newman's Q for the labels of each replicate."""
    a, b = labels.select("replicate", F.col("id").alias("src"), F.col("label").alias("a")), labels.select("replicate", F.col("id").alias("dst"), F.col("label").alias("b"))
    met = e.join(a, "src").join(b, ["replicate", "dst"]).groupBy("replicate", "a").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("own"))
    m2 = e.agg(F.sum("w").alias("m2"))
    return met.crossJoin(F.broadcast(m2)).groupBy("replicate").agg(F.sum(F.col("own") / F.col("m2") - (F.col("tot") / F.col("m2")) * (F.col("tot") / F.col("m2"))).alias("v"))


def _null(spark: SparkSession, sf_dir: str, within: str | None) -> DataFrame:
    rows = B.vectors(spark, sf_dir).select("id", "label", (F.col("id") % 5).alias("place"))
    e = edges(spark, sf_dir).select("src", "dst", "w")
    null = stats.permuted(rows, "id", "label", REPS, 7, within)
    got = stats.null_score(_modularity(e, rows.select(F.lit(0).alias("replicate"), "id", "label")), _modularity(e, null), "v", 1)
    return got.select(B.r("value").alias("value"), B.r("null_mean").alias("null_mean"), B.r("null_sd").alias("null_sd"), B.r("z", 4).alias("z"), B.r("p").alias("p"))


@query(B.steps(_NULL, "eg", "ev", recursive=_permuted_sql("(SELECT id, label FROM ev)")))
def perm_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null(spark, sf_dir, None)


@query(B.steps(_NULL, "eg", "ev", recursive=_permuted_sql("(SELECT id, label, id % 5 AS place FROM ev)", "place").replace("SELECT 0, id, label FROM (SELECT id, label, id % 5 AS place FROM ev)", "SELECT 0, id, label FROM ev")))
def perm_null_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null(spark, sf_dir, "place")


@query(
    """WITH p AS (SELECT user_id % 3 AS lens, user_id, 1.0 / (1 + count(*) + user_id / 1000.0) AS p FROM events GROUP BY user_id), k AS (SELECT *, p * count(*) OVER (PARTITION BY lens) / row_number() OVER (PARTITION BY lens ORDER BY p) AS q0 FROM p)
    SELECT lens, user_id, round(p, 9) AS p, round(least(1.0, min(q0) OVER (PARTITION BY lens ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM k"""
)
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select((F.col("user_id") % 3).alias("lens"), "user_id", (1.0 / (1 + F.col("n") + F.col("user_id") / 1000.0)).alias("p"))
    return stats.bh_qvalues(p, "p", "lens").select("lens", "user_id", B.r("p", 9).alias("p"), B.r("q", 9).alias("q"))


@query("SELECT round(greatest(0.0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k))), 9) AS omega2 FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice / 1000) AS m, var_pop(o_totalprice / 1000) AS v FROM orders GROUP BY 1))")
def omega_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.omega_squared(B.table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("y")), "y", "o_orderpriority"), 9)


def _r2(groups: str, name: str) -> str:
    return f"(SELECT 1 - (rss / (n - k)) / (sst / (n - 1)) AS {name} FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS rss, sum(n * v) + sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS sst FROM (SELECT count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM t GROUP BY {groups})))"


@query(f"WITH t AS (SELECT c_acctbal / 1000 AS y, c_mktsegment AS s, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT round(base, 9) AS base, round(fine - base, 9) AS gain FROM {_r2('r', 'base')}, {_r2('r, s', 'fine')}")
def within_region_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_acctbal") / 1000).alias("y"), F.col("c_mktsegment").alias("s"), F.col("n_regionkey").alias("r"))
    both = stats.factor_r2(t, "y", ["r"], "base").crossJoin(stats.factor_r2(t, "y", ["r", "s"], "fine"))
    return both.select(B.r("base", 9).alias("base"), B.r(F.col("fine") - F.col("base"), 9).alias("gain"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS c_acctbal FROM customer")
def within_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return stats.within_means(c, "c_nationkey", ["c_acctbal"]).select("c_custkey", B.r("c_acctbal", 4).alias("c_acctbal"))


@query(B.steps("SELECT CAST(year(b.q) AS INTEGER) AS year, round(avg(abs(ln(b.total) - m)), 6) AS mae, count(*) AS n FROM cp b JOIN (SELECT ty, avg(ln(total)) AS m FROM cp JOIN ty USING (tid, q) WHERE year(q) = 1996 GROUP BY ty) g ON g.ty = (SELECT arg_max(t.ty, t.q) FROM ty t WHERE t.tid = b.tid AND year(t.q) = 1996) WHERE year(b.q) > 1996 GROUP BY 1", "cp", "ty"))
def oot_group_mean_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of time: types and their mean log level frozen on one year, absolute errors in the years after."""
    p, t = B.complete(spark, sf_dir), B.types(spark, sf_dir).where(F.year("q") == 1996)
    means = p.join(t, ["tid", "q"]).groupBy("ty").agg(F.avg(F.ln("total")).alias("m"))
    frozen = t.groupBy("tid").agg(F.max_by("ty", "q").alias("ty")).join(means, "ty")
    later = p.where(F.year("q") > 1996).join(frozen, "tid")
    return later.groupBy(F.year("q").alias("year")).agg(B.r(F.avg(F.abs(F.ln("total") - F.col("m")))).alias("mae"), F.count("*").alias("n"))


@query(
    B.steps(
        _ari("ce", "replicate"), "es",
        recursive=f"ce AS MATERIALIZED (SELECT replicate, label AS a, other AS b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY md5(concat_ws('|', '9', replicate, id)), id) AS i FROM es, range(1, 11) r(replicate)) WHERE i <= floor((SELECT count(*) FROM es) * 0.8) GROUP BY ALL)",
    )
)
def bootstrap_subsample_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = two_labels(spark, sf_dir)
    got = indices.adjusted_rand(stats.subsamples(two, "id", 10, 0.8, 9).join(two, "id"), "label", "other", ["replicate"])
    return got.select(F.col("replicate").cast("long").alias("replicate"), B.r("ARI").alias("ARI"))


@query("WITH k AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, round(corr(a, b), 6) AS rho FROM k GROUP BY event_type")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(B.table(spark, sf_dir, "events"), "value", "user_id", "event_type").select("event_type", B.r("rho").alias("rho"))
