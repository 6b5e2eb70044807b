"""Queries on context beside spending, centres of single periods, penalties, noise, trajectories, profiles and forms of text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import context, graph, indices, model
from tessera.sources.scratch import written

from . import base as B
from . import models as M
from .catalogue import query

GROUPS, DAY = [f"g{i}" for i in range(6)], "CAST(q AS VARCHAR) AS q"
SIZE, WEIGHT, COVERAGE, NOISE = 9, 0.5, 0.98, 0.15
PENALTIES = [0.1, 0.3, 1.0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, pop, wage, sold, g0..g5): customers of the nation, balance, sales, and shares of groups of sizes; the seventh
    group of sizes goes unreported. A group without sales is null."""
    sizes = B.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).alias("g"))
    items = B.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice").join(sizes, F.col("l_partkey") == F.col("p_partkey"))
    sold = items.groupBy(F.col("l_suppkey").alias("tid")).agg(F.sum("l_extendedprice").alias("sold"), *[F.sum(F.when(F.col("g") == i, F.col("l_extendedprice"))).alias(g) for i, g in enumerate(GROUPS)])
    people = B.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").cast("double").alias("pop"))
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"), "s_nationkey", F.col("s_acctbal").alias("wage"))
    return s.join(people, "s_nationkey", "left").join(sold, "tid", "left").select("tid", "pop", "wage", "sold", *[(F.col(g) / F.col("sold")).alias(g) for g in GROUPS])


def vectors(rows: DataFrame) -> DataFrame:
    """(tid, x, told, valid): the context vector, the share of sales in reported groups, and whether there are sales."""
    valid = F.coalesce(F.col("sold") > 0, F.lit(False))
    told = S.array_sum(F.array(*[F.coalesce(g, F.lit(0.0)) for g in GROUPS]))
    return rows.select("tid", context.context_vector(F.col("pop"), F.col("wage"), [F.col(g) for g in GROUPS], valid).alias("x"), told.alias("told"), valid.alias("valid"))


_FILLED = " + ".join(f"coalesce({g}, 0.0)" for g in GROUPS)
_SHARES = ", ".join(f"CASE WHEN sold > 0 THEN coalesce({g}, 0.0) / greatest(told, 1.0) END" for g in GROUPS)
B.STEPS["cr"] = ([], f"""SELECT s_suppkey AS tid, CAST(n AS DOUBLE) AS pop, s_acctbal AS wage, sold, {', '.join(f'{g} / sold AS {g}' for g in GROUPS)} FROM supplier LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = s_nationkey
    LEFT JOIN (SELECT l_suppkey, sum(l_extendedprice) AS sold, {', '.join(f'sum(CASE WHEN p_size % 7 = {i} THEN l_extendedprice END) AS {g}' for i, g in enumerate(GROUPS))} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_suppkey = s_suppkey""")
B.STEPS["ct"] = (["cr"], f"SELECT *, {_FILLED} AS told FROM cr")
B.STEPS["cx"] = (["ct"], f"SELECT tid, told, coalesce(sold > 0, false) AS valid, [CASE WHEN pop > 0 THEN ln(pop) END, CASE WHEN wage > 0 THEN ln(wage) END, {_SHARES}, CASE WHEN sold > 0 THEN greatest(1 - told / greatest(told, 1.0), 0.0) END] AS x FROM ct")
B.STEPS["cm"] = (["cx", "wf"], f"SELECT i, coalesce(median(x[i]), 0.0) AS m FROM cx JOIN (SELECT DISTINCT tid FROM wf) USING (tid), range(1, {SIZE + 1}) r(i) GROUP BY i")
B.STEPS["ci"] = (["cx", "cm", "wf"], f"SELECT tid, i, coalesce(x[i], m) AS v FROM cx JOIN (SELECT DISTINCT tid FROM wf) USING (tid), cm")
B.STEPS["cz"] = (["ci"], f"SELECT tid, list(greatest(-4.0, least(4.0, (v - m) / s)) * sqrt({1 - WEIGHT} / {SIZE}) ORDER BY i) AS c FROM ci JOIN (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS s FROM ci GROUP BY i) USING (i) GROUP BY tid")


@query(B.steps(f"SELECT tid, {', '.join(f'round(x[{i + 1}], 6) AS c{i}' for i in range(SIZE))}, NOT valid AS missing, valid AND told < {COVERAGE} AS withheld FROM cx", "cx"))
def context_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(shares(spark, sf_dir))
    return v.select("tid", *[B.r(F.col("x")[i]).alias(f"c{i}") for i in range(SIZE)], (~F.col("valid")).alias("missing"), (F.col("valid") & (F.col("told") < COVERAGE)).alias("withheld"))


@query(B.steps(f"SELECT tid, {', '.join(f'round({g}, 6) AS {g}' for g in GROUPS)}, round(CASE WHEN coalesce(g0, g1, g2) IS NOT NULL THEN coalesce(g0, 0) + coalesce(g1, 0) + coalesce(g2, 0) END, 6) AS low, round(CASE WHEN coalesce(g3, g4, g5) IS NOT NULL THEN coalesce(g3, 0) + coalesce(g4, 0) + coalesce(g5, 0) END, 6) AS high FROM cr", "cr"))
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of groups, missing ones missing, and sums that are null only where all their groups are."""
    sums = {"low": GROUPS[:3], "high": GROUPS[3:]}
    return shares(spark, sf_dir).select("tid", *[B.r(g).alias(g) for g in GROUPS], *[B.r(context.sum_or_null([F.col(g) for g in gs])).alias(n) for n, gs in sums.items()])


@query(B.steps(f"SELECT s.tid, {DAY}, {', '.join(f'round(s.x[{i}] * sqrt({WEIGHT}), 6) AS v{i}' for i in range(1, B.SIZE + 1))}, {', '.join(f'round(c.c[{i}], 6) AS c{i}' for i in range(1, SIZE + 1))} FROM sc s JOIN cz c USING (tid)", "sc", "cz"))
def scaled_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = context.scaled_arrays(B.windows(spark, sf_dir), vectors(shares(spark, sf_dir)), "tid", "x", B.SIZE, SIZE, WEIGHT)
    return both.select("tid", B.day("q"), *[B.r(F.col("x")[i]).alias(f"v{i + 1}" if i < B.SIZE else f"c{i - B.SIZE + 1}") for i in range(B.SIZE + SIZE)])


def _rounds(iterations: int = 5) -> str:
    """Steps of k-means in each period; returns the step of codes."""
    square = "round(list_aggregate([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, 8)], 'sum'), 9)"
    B.STEPS["pk0"] = (["sc"], f"SELECT q, row_number() OVER (PARTITION BY q ORDER BY md5(concat_ws('|', '42', tid, q))) - 1 AS code, x FROM sc QUALIFY code < {M.K}")
    for t in range(iterations + 1):
        B.STEPS[f"pa{t}"] = (["sc", f"pk{t}"], f"SELECT p.tid, p.q, min({{'d': {square}, 'c': c.code}}) AS s FROM sc p JOIN pk{t} c USING (q) GROUP BY ALL")
        B.STEPS[f"pk{t + 1}"] = ([f"pk{t}", f"pa{t}"], f"SELECT c.q, c.code, coalesce(m.x, c.x) AS x FROM pk{t} c LEFT JOIN (SELECT q, code, list(v ORDER BY i) AS x FROM (SELECT q, s.c AS code, i, round(avg(x[i]), 9) AS v FROM sc JOIN pa{t} USING (tid, q), range(1, 8) r(i) GROUP BY ALL) GROUP BY ALL) m USING (q, code)")
    return f"pa{iterations}"


_CODES = _rounds()


@query(B.steps(f"SELECT tid, {DAY}, CAST(s.c AS INTEGER) AS code FROM {_CODES}", _CODES))
def period_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means of each period for itself; codes of two periods have nothing in common."""
    rows = B.scaled(spark, sf_dir)
    centers = context.period_centers(rows, "q", "x", B.SIZE, M.K, F.concat_ws("|", F.col("tid").cast("string"), F.date_format("q", "yyyy-MM-dd")))
    return rows.join(centers, "q").select("tid", B.day("q"), context.nearest_center("x", "centers").cast("int").alias("code"))


def _variant(n: int) -> str:
    """The steps of paths under the n-th penalty, their names with that number."""
    sql = M.paths_sql(M.RAW).replace(f"round({M.PENALTY} *", f"round({PENALTIES[n]} *")
    return re.sub(r"\b(pn|sq|fw|bk|rn)\b", rf"\g<1>{n}", sql)


_VARIANTS = ", ".join(_variant(n) for n in range(len(PENALTIES)))
_SWITCHES = ", ".join(f"sw{n} AS (SELECT tid, sum(s) AS s FROM (SELECT tid, CASE WHEN lag(t) OVER (PARTITION BY tid ORDER BY i) <> t THEN 1 ELSE 0 END AS s FROM bk{n}) GROUP BY tid)" for n in range(len(PENALTIES)))


def by_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, switches, penalty) over one table of distances."""
    d = written(M.fitted(B.scaled(spark, sf_dir)), "distances")
    one = lambda w: context.switches(model.viterbi(d, "tid", "q", model.switch_penalty(d, w), M.K), "tid", "q", "type").withColumn("penalty", F.lit(w))
    out = one(PENALTIES[0])
    for w in PENALTIES[1:]:
        out = out.unionByName(one(w))
    return out


@query(B.steps(" UNION ALL ".join(f"SELECT CAST({w} AS DOUBLE) AS penalty, CAST(sum(s) AS BIGINT) AS switches, round(avg(CAST(s = 0 AS INTEGER)), 6) AS steady FROM sw{n}" for n, w in enumerate(PENALTIES)), M.RAW, recursive=f"{_VARIANTS}, {_SWITCHES}"))
def penalty_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches under each penalty, and the share of entities that never switch, in one grouping by variant."""
    return by_penalty(spark, sf_dir).groupBy("penalty").agg(F.sum("switches").alias("switches"), B.r(F.avg((F.col("switches") == 0).cast("double"))).alias("steady"))


@query(B.steps("SELECT tid, CAST(a.s AS BIGINT) AS low, CAST(b.s AS BIGINT) AS high FROM sw0 a JOIN sw2 b USING (tid) ORDER BY 10 * (a.s - b.s) + a.s DESC, tid LIMIT 1", M.RAW, recursive=f"{_VARIANTS}, {_SWITCHES}"))
def penalty_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity whose path the penalty changes most: ten times the switches that go, and those of the lowest penalty."""
    n = lambda w: F.coalesce(F.sum(F.when(F.col("penalty") == w, F.col("switches"))), F.lit(0))
    both = by_penalty(spark, sf_dir).groupBy("tid").agg(n(PENALTIES[0]).alias("low"), n(PENALTIES[-1]).alias("high"))
    return both.orderBy((10 * (F.col("low") - F.col("high")) + F.col("low")).desc(), "tid").limit(1)


_UNIFORM = "CAST('0x' || substr(md5(concat_ws('|', '{}', '7', tid, q, i - 1)), 1, 13) AS BIGINT) / 4503599627370496.0"
B.STEPS["sn"] = (["sc"], f"SELECT tid, q, list(x[i] + {NOISE} * sqrt(1.0 / 7) * sqrt(-2 * ln(1 - {_UNIFORM.format('r')})) * cos(2 * pi() * {_UNIFORM.format('a')}) ORDER BY i) AS x FROM sc, range(1, 8) r(i) GROUP BY tid, q")
_NOISY = B.kmeans("kn", "sn")


@query(
    B.steps(
        """SELECT n, round((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS "ARI" FROM (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM cells),
        (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM cells GROUP BY a)), (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM cells GROUP BY b))""",
        M.RAW, _NOISY, recursive=f"cells AS (SELECT list_position(u.d, list_min(u.d)) AS a, list_position(v.d, list_min(v.d)) AS b, count(*) AS n FROM {M.RAW} u JOIN {_NOISY} v USING (tid, q) GROUP BY ALL)",
    )
)
def noise_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of types with those of a refit on features with normal noise of 0.15 deviations."""
    rows = B.scaled(spark, sf_dir)
    noise = lambda i: context.gaussian(F.lit("7"), F.col("tid").cast("string"), F.date_format("q", "yyyy-MM-dd"), i.cast("string"))
    shaken = rows.withColumn("x", F.transform("x", lambda v, i: v + F.lit(NOISE * (1 / B.SIZE) ** 0.5) * noise(i)))
    code = lambda df, name: df.select("tid", "q", F.array_position("d", F.array_min("d")).alias(name))
    both = written(code(M.fitted(rows), "a").join(code(M.fitted(shaken), "b"), ["tid", "q"]), "labels")
    return both.agg(F.count("*").alias("n")).crossJoin(indices.adjusted_rand(both, "a", "b")).select("n", B.r("ARI").alias("ARI"))


def _trajectory(name: str, rows: str, vector: str) -> str:
    B.STEPS[f"{name}_v"] = (["wf"], rows)
    centre = "list_transform(v, lambda z: z - list_avg(v))" if vector == "centred" else "v"
    B.STEPS[f"{name}_x"] = ([f"{name}_v"], f"SELECT tid, {centre} AS x FROM {name}_v")
    return f"SELECT src, dst, rank, round(d, 6) AS d FROM (SELECT a.tid AS src, b.tid AS dst, round(1 - list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 12) AS d, CAST(row_number() OVER (PARTITION BY a.tid ORDER BY round(1 - list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 12), b.tid) AS INTEGER) AS rank FROM {name}_x a JOIN {name}_x b ON a.tid <> b.tid) WHERE rank <= {B.LEAST}"


_SHAPE = _trajectory("ls", "SELECT tid, list(x[1] ORDER BY q) AS v FROM wf GROUP BY tid", "centred")
_GROWTH = _trajectory("gr", "SELECT tid, list(x[i] - y[i] ORDER BY q, i) AS v FROM (SELECT tid, q, x, lag(x) OVER (PARTITION BY tid ORDER BY q) AS y FROM wf), range(1, 8) r(i) WHERE y IS NOT NULL GROUP BY tid", "plain")


def _nearest(rows: DataFrame, metric: str) -> DataFrame:
    """``rows`` (tid, x) are one group, so that whole trajectories are compared by pairs of blocks."""
    found = graph.nearest(written(rows.withColumn("all_", F.lit(0)), "trajectories"), "all_", "tid", "x", B.LEAST, metric)
    return found.select("src", "dst", "rank", B.r("d").alias("d"))


def _series(rows: DataFrame) -> DataFrame:
    """(tid, s): an entity's windows in order."""
    return rows.groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda e: e["x"]).alias("s"))


@query(B.steps(_SHAPE, "ls_x"))
def shape_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose levels move alike: correlation over all windows. Scaling a trajectory does not change it."""
    return _nearest(_series(B.windows(spark, sf_dir)).select("tid", F.transform("s", lambda x: x[0]).alias("x")), "correlation")


@query(B.steps(_GROWTH, "gr_x"))
def growth_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose features change alike: cosine of all changes from window to window."""
    s = _series(B.windows(spark, sf_dir))
    changes = F.flatten(F.transform(F.slice("s", F.lit(2), F.size("s") - 1), lambda x, i: F.zip_with(x, F.col("s")[i], lambda a, b: a - b)))
    return _nearest(s.where(F.size("s") > 1).select("tid", changes.alias("x")), "cosine")


@query(B.steps(f"SELECT ty, name, round(m, 6) AS mean, round(coalesce((m - avg(m) OVER (PARTITION BY name)) / nullif(stddev_pop(m) OVER (PARTITION BY name), 0), 0), 4) AS z FROM ({' UNION ALL '.join(f'SELECT ty, {chr(39)}{p}{chr(39)} AS name, avg({p} / total) AS m FROM ty JOIN cp USING (tid, q) GROUP BY ty' for p in B.PARTS)})", "ty", "cp"))
def profile_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shares of each type, and their z among types."""
    rows = B.types(spark, sf_dir).join(B.complete(spark, sf_dir).select("tid", "q", *[(F.col(p) / F.col("total")).alias(p) for p in B.PARTS]), ["tid", "q"])
    return context.profile_z(rows, "ty", B.PARTS).select("ty", "name", B.r("mean").alias("mean"), B.r("z", 4).alias("z"))


@query("SELECT coalesce(a.k, b.k) AS nation, a.n AS suppliers, round(a.b, 2) AS owed, b.n AS customers, round(b.b, 2) AS held FROM (SELECT s_nationkey AS k, count(*) AS n, sum(s_acctbal) AS b FROM supplier WHERE s_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS b FROM customer WHERE c_mktsegment = 'FURNITURE' GROUP BY 1) b ON a.k = b.k")
def aligned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregates by nation side by side, nations of either one."""
    a = B.table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"), B.r(F.sum("s_acctbal"), 2).alias("owed"))
    b = B.table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), B.r(F.sum("c_acctbal"), 2).alias("held"))
    return a.join(b, "nation", "full")


@query(r"SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS word, translate(regexp_extract(p_type, '^([A-Z])', 1), 'EMPS', 'ЕМРС') AS section, translate(format('{:,.2f}', p_retailprice), ',.', '_,') AS price FROM part")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word, the section's letter in the other alphabet, and prices with a decimal comma and spaced thousands."""
    p = B.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")).alias("word"), S.section_letter(F.col("p_type"), "EMPS", "ЕМРС").alias("section"), S.spaced_number(F.col("p_retailprice"), 2, "_").alias("price"))
