"""Queries of transitions, events, profiles, rankings and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ranking, stats

from . import base as B
from .catalogue import query

DAY = "CAST(q AS VARCHAR) AS q"
_TR = """tr AS (SELECT * FROM (SELECT tid, q, lag(ty) OVER w AS f, ty AS t, count(*) OVER a < 3 AS censored, min(ty) OVER a = max(ty) OVER a AS same, greatest(0.0, sum(conf) OVER b - 3) AS sup FROM ty
WINDOW w AS (PARTITION BY tid ORDER BY q), a AS (PARTITION BY tid ORDER BY q ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY tid ORDER BY q ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)) WHERE f <> t)"""
_TM = """tm AS (SELECT f, t, n, n / sum(n) OVER (PARTITION BY f) AS p FROM (SELECT f, t, count(*) AS n FROM (SELECT lag(ty) OVER (PARTITION BY tid ORDER BY q) AS f, ty AS t FROM ty) WHERE f IS NOT NULL GROUP BY ALL))"""


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.types(spark, sf_dir)


@query(B.steps(f"SELECT tid, {DAY}, f AS \"from\", t AS \"to\", censored, same AND NOT censored AS persists, round(CASE WHEN censored THEN 0.0 ELSE sup END, 6) AS support, same AND NOT censored AND sup >= 0.5 AS robust FROM tr", "ty", recursive=_TR))
def transitions_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.transitions(types(spark, sf_dir), "tid", "q", "ty", "conf")
    return t.select("tid", B.day("q"), "from", "to", "censored", "persists", B.r("support").alias("support"), "robust")


@query(B.steps('SELECT f AS "from", t AS "to", n, round(p, 6) AS p FROM tm', "ty", recursive=_TM))
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.transition_matrix(types(spark, sf_dir), "tid", "q", "ty").withColumn("p", B.r("p"))


@query(B.steps("SELECT f AS type, round(least(25.0, CASE WHEN s < 1 THEN 1 / (1 - s) ELSE 25.0 END), 6) AS dwell FROM (SELECT f, max(CASE WHEN f = t THEN p ELSE 0 END) AS s FROM tm GROUP BY f)", "ty", recursive=_TM))
def dwell_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dwell_times(stats.transition_matrix(types(spark, sf_dir), "tid", "q", "ty"), 25).withColumn("dwell", B.r("dwell"))


@query(B.steps('SELECT a AS start, b AS "end", count(*) AS n FROM (SELECT arg_min(ty, q) AS a, arg_max(ty, q) AS b FROM ty GROUP BY tid) GROUP BY ALL', "ty"))
def start_end_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.start_end_flow(types(spark, sf_dir), "tid", "q", "ty")


def _roads(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Entities that ship for one order are neighbours; a row for each order that they share unless ``once``."""
    i = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    pairs = i.alias("a").join(i.alias("b"), "l_orderkey").where("a.l_suppkey <> b.l_suppkey").select(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst"))
    return pairs.distinct() if once else pairs


@query(
    B.steps(
        """SELECT round(ps, 6) AS p_same, round(po, 6) AS p_other, round((po - ps) / sqrt(p * (1 - p) * (1.0 / ns + 1.0 / no_)), 6) AS z, round(tm, 6) AS to_mode FROM (SELECT avg(CASE WHEN now = mode THEN mv END) AS ps, avg(CASE WHEN now <> mode THEN mv END) AS po, avg(mv) AS p, count(CASE WHEN now = mode THEN 1 END) AS ns, count(CASE WHEN now <> mode THEN 1 END) AS no_, avg(CASE WHEN mv = 1 THEN CASE WHEN nxt = mode THEN 1.0 ELSE 0 END END) AS tm FROM
        (SELECT s.*, mode, CASE WHEN now <> nxt THEN 1.0 ELSE 0.0 END AS mv FROM (SELECT tid, q, ty AS now, lead(ty) OVER (PARTITION BY tid ORDER BY q) AS nxt FROM ty) s JOIN nm USING (tid, q) WHERE nxt IS NOT NULL))""",
        "ty",
        recursive="rd AS MATERIALIZED (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey), nm AS MATERIALIZED (SELECT tid, q, ty AS mode FROM (SELECT src AS tid, q, ty, row_number() OVER (PARTITION BY src, q ORDER BY count(*) DESC, ty) AS rn FROM rd JOIN ty ON ty.tid = dst GROUP BY src, q, ty) WHERE rn = 1)",
    )
)
def spatial_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.spatial_markov(_roads(spark, sf_dir), types(spark, sf_dir), "tid", "q", "ty")
    return out.select(*[B.r(c).alias(c) for c in out.columns])


@query(B.steps('SELECT t AS "to", CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS durable, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS blinking FROM tr WHERE NOT censored GROUP BY t', "ty", recursive=_TR))
def durable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.durable_events(types(spark, sf_dir), "tid", "q", "ty")


_LAST = "la AS MATERIALIZED (SELECT tid, ty, x FROM ty JOIN wf USING (tid, q) WHERE q = (SELECT max(q) FROM ty))"


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = types(spark, sf_dir)
    return t.join(F.broadcast(t.agg(F.max("q").alias("q"))), "q").join(B.windows(spark, sf_dir), ["tid", "q"]).select("tid", "ty", *[F.col("x")[i].alias(f"x{i}") for i in range(B.SIZE)])


@query(
    B.steps(
        "SELECT ty, name, round(z, 6) AS z, round(low, 6) AS low, round(high, 6) AS high, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ty ORDER BY round(abs(z), 9) DESC, name) AS rank FROM (SELECT ty, 'x' || (i - 1) AS name, (avg(x[i]) - m) / s AS z, quantile_cont(x[i], 0.1) AS low, quantile_cont(x[i], 0.9) AS high FROM la, range(1, 8) r(i) JOIN (SELECT j, avg(x[j]) AS m, stddev_samp(x[j]) AS s FROM la, range(1, 8) u(j) GROUP BY j) ON j = i GROUP BY ty, i, m, s)) WHERE rank <= 3",
        "ty", "wf", recursive=_LAST,
    )
)
def contrasts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.contrasts(_last(spark, sf_dir), "ty", [f"x{i}" for i in range(B.SIZE)], 3)
    return c.select("ty", "name", B.r("z").alias("z"), B.r("low").alias("low"), B.r("high").alias("high"), "rank")


@query(B.steps("SELECT ty, count(*) AS n, " + ", ".join(f"round(median(x[{i + 1}]), 6) AS x{i}" for i in range(B.SIZE)) + " FROM la GROUP BY ty", "ty", "wf", recursive=_LAST))
def type_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir).groupBy("ty").agg(F.count("*").alias("n"), *[B.r(F.median(f"x{i}")).alias(f"x{i}") for i in range(B.SIZE)])


@query(
    B.steps(
        "SELECT item, round(tp / nullif(n, 0), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall, round(2 * tp / nullif(n + pos, 0), 6) AS f1 FROM (SELECT 'x' || (i - 1) AS item, sum(CASE WHEN x[i] > cut THEN 1.0 ELSE 0 END) AS n, sum(CASE WHEN x[i] > cut AND ty = 0 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN ty = 0 THEN 1.0 ELSE 0 END) AS pos FROM la, range(1, 8) r(i) JOIN (SELECT j, quantile_cont(x[j], 0.75) AS cut FROM la, range(1, 8) u(j) GROUP BY j) ON j = i GROUP BY i)",
        "ty", "wf", recursive=_LAST,
    )
)
def fca_items_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items "over the upper quartile" and how well each describes one type."""
    rows = _last(spark, sf_dir)
    cuts = rows.agg(*[F.percentile(f"x{i}", F.lit(0.75)).alias(f"c{i}") for i in range(B.SIZE)])
    met = rows.crossJoin(F.broadcast(cuts))
    got = stats.item_f1(met, "ty", F.lit(0), {f"x{i}": F.col(f"x{i}") > F.col(f"c{i}") for i in range(B.SIZE)})
    return got.select("item", *[B.r(c).alias(c) for c in ("precision", "recall", "f1")])


CRITERIA = {"a": 1, "b": -1, "c": 1}
_CR = "cr AS MATERIALIZED (SELECT p_brand AS k, round(avg(p_retailprice), 4) AS a, count(*) AS b, max(p_size) * 100 + count(DISTINCT p_type) AS c FROM part GROUP BY 1)"


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(B.r(F.avg("p_retailprice"), 4).alias("a"), F.count("*").alias("b"), (F.max("p_size") * 100 + F.countDistinct("p_type")).cast("long").alias("c"))


_PLACES = "pc AS MATERIALIZED (SELECT k, rank() OVER (ORDER BY a DESC) AS a, rank() OVER (ORDER BY b) AS b, rank() OVER (ORDER BY c DESC) AS c, count(*) OVER () AS n FROM cr)"
_GRADE = ", ".join(f"CASE WHEN {c} <= ceil(n / 3.0) THEN 1 WHEN {c} <= ceil(2 * n / 3.0) THEN 2 ELSE 3 END AS g{c}" for c in "abc")


@query(f"WITH {_CR}, {_PLACES}, gr AS (SELECT *, a + b + c AS s, {_GRADE} FROM pc), nn AS (SELECT *, (ga = 3)::INT + (gb = 3)::INT + (gc = 3)::INT AS n3, (ga = 1)::INT + (gb = 1)::INT + (gc = 1)::INT AS n1 FROM gr) SELECT k, CAST(ga AS VARCHAR) || gb || gc AS grades, CAST(row_number() OVER (ORDER BY n3, n1 DESC, s, k) AS INTEGER) AS threshold, CAST(rank() OVER (ORDER BY s) AS INTEGER) AS borda FROM nn")
def threshold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.threshold_and_borda(_criteria(spark, sf_dir), "k", CRITERIA)


@query(f"WITH {_CR}, {_PLACES} SELECT k, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, CAST(greatest(a, b, c) AS INTEGER) AS worst, CAST(least(a, b, c) AS INTEGER) AS best, round(((a <= 2)::INT + (b <= 2)::INT + (c <= 2)::INT) / 3.0, 6) AS top_two FROM pc")
def borda_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranking.places(_criteria(spark, sf_dir), "k", CRITERIA)
    two = sum(((F.col(c) <= 2).cast("int") for c in "bc"), (F.col("a") <= 2).cast("int"))
    return p.select("k", "a", "b", "c", F.greatest("a", "b", "c").alias("worst"), F.least("a", "b", "c").alias("best"), B.r(two / 3.0).alias("top_two"))


@query(f"WITH {_CR} SELECT k, a, b, c FROM cr x WHERE NOT EXISTS (SELECT 1 FROM cr y WHERE y.a >= x.a AND y.b <= x.b AND y.c >= x.c AND (y.a > x.a OR y.b < x.b OR y.c > x.c))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pareto_front(_criteria(spark, sf_dir), "k", CRITERIA)


@query("WITH v AS (SELECT n_name AS k, c_mktsegment AS r, round(avg(c_acctbal), 6) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT k, median(p) AS median, CAST(min(p) AS INTEGER) AS best, CAST(max(p) AS INTEGER) AS worst FROM (SELECT k, rank() OVER (PARTITION BY r ORDER BY v DESC) AS p FROM v) GROUP BY k")
def rank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("k"), F.col("c_mktsegment").alias("r")).agg(B.r(F.avg("c_acctbal")).alias("v"))
    return ranking.rank_intervals(v, "k", "r", "v", 1)


@query(B.steps("SELECT y.ty, CAST(y.y AS INTEGER) AS year, round(y.m, 4) AS level, round(y.m / z.m - 1, 6) AS growth FROM yy y LEFT JOIN yy z ON z.ty = y.ty AND z.y = y.y - 1", "cp", "ty", recursive="yy AS MATERIALIZED (SELECT ty, year(q) AS y, median(total) AS m FROM cp JOIN (SELECT tid, arg_max(ty, q) AS ty FROM ty GROUP BY tid) USING (tid) GROUP BY 1, 2)"))
def yoy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = types(spark, sf_dir).groupBy("tid").agg(F.max_by("ty", "q").alias("ty"))
    yearly = B.complete(spark, sf_dir).join(final, "tid").groupBy("ty", F.year("q").alias("year")).agg(F.median("total").alias("m"))
    before = F.when(F.lag("year").over(Window.partitionBy("ty").orderBy("year")) == F.col("year") - 1, F.lag("m").over(Window.partitionBy("ty").orderBy("year")))
    return yearly.select("ty", "year", B.r("m", 4).alias("level"), B.r(F.col("m") / before - 1).alias("growth"))


@query(B.steps(f"SELECT {DAY}, ty, count(*) AS n, CAST(sum(moved) AS BIGINT) AS moved FROM (SELECT q, ty, CASE WHEN lag(ty) OVER (PARTITION BY tid ORDER BY q) <> ty THEN 1 ELSE 0 END AS moved FROM ty) GROUP BY q, ty", "ty"))
def type_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = (F.lag("ty").over(Window.partitionBy("tid").orderBy("q")) != F.col("ty")).cast("long")
    return types(spark, sf_dir).select("q", "ty", F.coalesce(moved, F.lit(0)).alias("moved")).groupBy("q", "ty").agg(F.count("*").alias("n"), F.sum("moved").cast("long").alias("moved")).select(B.day("q"), "ty", "n", "moved")


@query(B.steps('SELECT a AS start, b AS "end", n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT a, b, count(*) AS n FROM (SELECT arg_min(ty, q) AS a, arg_max(ty, q) AS b FROM ty GROUP BY tid) WHERE a <> b GROUP BY ALL) ORDER BY n DESC, a, b LIMIT 3', "ty"))
def top_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest flows between first and last types, with their share of all changes."""
    f = stats.start_end_flow(types(spark, sf_dir), "tid", "q", "ty").where("start <> end")
    total = f.agg(F.sum("n").alias("t"))
    return f.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "start", "end").limit(3).select("start", "end", "n", B.r(F.col("n") / F.col("t")).alias("share"))


@query(B.steps("SELECT CASE WHEN robust THEN 'robust' WHEN persists THEN 'persistent' WHEN censored THEN 'censored' ELSE 'blinking' END AS status, count(*) AS n, round(median(support), 6) AS support FROM (SELECT censored, same AND NOT censored AS persists, CASE WHEN censored THEN 0.0 ELSE sup END AS support, same AND NOT censored AND sup >= 0.5 AS robust FROM tr) GROUP BY 1", "ty", recursive=_TR))
def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.transitions(types(spark, sf_dir), "tid", "q", "ty", "conf")
    status = F.when(F.col("robust"), "robust").when(F.col("persists"), "persistent").when(F.col("censored"), "censored").otherwise("blinking")
    return t.groupBy(status.alias("status")).agg(F.count("*").alias("n"), B.r(F.median("support")).alias("support"))


@query(B.steps("SELECT round(median(conf), 6) AS median, round(avg(CASE WHEN conf >= 0.9 THEN 1.0 ELSE 0 END), 6) AS high, round(avg(CASE WHEN conf < 0.75 THEN 1.0 ELSE 0 END), 6) AS boundary FROM ty", "ty"))
def agreement_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conf")
    return types(spark, sf_dir).agg(B.r(F.median("conf")).alias("median"), B.r(F.avg((c >= 0.9).cast("double"))).alias("high"), B.r(F.avg((c < 0.75).cast("double"))).alias("boundary"))


@query("SELECT CAST(sum(h) % 1000000007 AS BIGINT) AS digest, count(*) AS n FROM (SELECT CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 12)) AS BIGINT) AS h FROM orders)")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a table that doesn't depend on its order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")), 1, 12), 16, 10).cast("decimal(38,0)")
    return B.table(spark, sf_dir, "orders").agg((F.sum(h) % 1000000007).cast("long").alias("digest"), F.count("*").alias("n"))
