"""The frames that the catalogue's queries start from, and the same steps as SQL.

The tables stand in for a spending panel: suppliers are entities, quarters are periods, the six kinds of part are the
categories of a composition, nations and regions are places. ``steps`` strings common table expressions together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, graph, panel
from tessera.sources.scratch import written

CATEGORIES = {"ECONOMY": "p1", "LARGE": "p2", "MEDIUM": "p3", "PROMO": "p4", "SMALL": "p5", "STANDARD": "p6"}
PARTS = list(CATEGORIES.values())
SIZE, WINDOW, NEAR, LEAST, TYPES = 7, 4, 10, 3, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, q, total, p1..p6)."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    kinds = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    long = items.join(kinds, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("tid"), F.trunc("l_shipdate", "quarter").alias("q"), "p_type", "l_extendedprice")
    return panel.pivot_levels(long, ["tid", "q"], "p_type", "l_extendedprice", CATEGORIES, "total")


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels are written, a row for an entity and period: the count of periods and the steps after it read that, not the items."""
    p = written(levels(spark, sf_dir), "levels")
    return panel.complete_entities(p, "tid", "q", panel.all_present(PARTS, "total"), p.select("q").distinct().count())


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, q, x): log level and CLR over four trailing quarters."""
    return features.window_features(complete(spark, sf_dir), "tid", "q", "total", PARTS, WINDOW)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as the steps after it read it several times and their plans shall stay short; windows too, which the statistics and
    the rows that they scale both read."""
    return written(features.scaled(written(windows(spark, sf_dir), "windows"), "x", SIZE), "scaled")


def near(spark: SparkSession, sf_dir: str, metric: str = "cosine", k: int = NEAR, rows: DataFrame | None = None) -> DataFrame:
    """Of the scaled ``rows``, built here unless the caller has them."""
    return written(graph.nearest(scaled(spark, sf_dir) if rows is None else rows, "q", "tid", "x", k, metric), "near")


def edges(spark: SparkSession, sf_dir: str, metric: str = "cosine", mutual: bool = True, rows: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Of neighbours ``found`` among the scaled ``rows``, each built here unless the caller has it."""
    found = near(spark, sf_dir, metric, rows=rows) if found is None else found
    return written(graph.weighted_knn(found, "q", NEAR, LEAST, mutual), "edges")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, q, ty, conf): the category that stands out most in a window, and by how much, as a plain type."""
    parts = F.slice("x", 2, 6)
    w = windows(spark, sf_dir).withColumn("top", F.array_max(parts))
    return w.select("tid", "q", (F.array_position(parts, F.col("top")) - 1).cast("int").alias("ty"), F.least(F.lit(1.0), F.col("top") + 0.5).alias("conf"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, nation, region, acctbal)."""
    s, n, g = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("tid"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("acctbal"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label) of the embeddings, in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


_SUMS = ", ".join(f"sum(CASE WHEN p_type = '{c}' THEN l_extendedprice ELSE 0.0 END) AS {n}" for c, n in CATEGORIES.items())
_PLUS = " + ".join(f"s{i}" for i in range(1, 7))
_LOGS = " + ".join(f"l{i}" for i in range(1, 7))
#: Steps by name: what each needs, and its SQL.
STEPS: dict[str, tuple[list[str], str]] = {
    "lv": ([], f"SELECT l_suppkey AS tid, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum(l_extendedprice) AS total, {_SUMS} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "cp": (["lv"], "SELECT * FROM lv WHERE tid IN (SELECT tid FROM lv WHERE total > 0 GROUP BY tid HAVING count(DISTINCT q) >= (SELECT count(DISTINCT q) FROM lv))"),
    "w0": (["cp"], f"SELECT tid, q, avg(total) OVER w AS lvl, {', '.join(f'sum(p{i}) OVER w AS s{i}' for i in range(1, 7))}, count(*) OVER w AS n FROM cp WINDOW w AS (PARTITION BY tid ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "w1": (["w0"], f"SELECT tid, q, ln(lvl) AS f0, {', '.join(f'ln(greatest(s{i} / ({_PLUS}), 1e-6)) AS l{i}' for i in range(1, 7))} FROM w0 WHERE n = 4"),
    "wf": (["w1"], f"SELECT tid, q, [f0, {', '.join(f'l{i} - ({_LOGS}) / 6.0' for i in range(1, 7))}] AS x FROM w1"),
    "st": (["wf"], "SELECT i, avg(x[i]) AS m, CASE WHEN stddev_pop(x[i]) > 0 THEN stddev_pop(x[i]) ELSE 1.0 END AS s FROM wf, range(1, 8) r(i) GROUP BY i"),
    "sl": (["st"], "SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM st"),
    "sc": (["wf", "sl"], "SELECT tid, q, [greatest(-4.0, least(4.0, (x[i] - m[i]) / s[i])) * sqrt(1.0 / 7) for i in range(1, 8)] AS x FROM wf, sl"),
    "nn": (["sc"], "SELECT a.q, a.tid AS src, b.tid AS dst, round(1 - list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 12) AS d FROM sc a JOIN sc b ON a.q = b.q AND a.tid <> b.tid"),
    "ne": (["sc"], "SELECT a.q, a.tid AS src, b.tid AS dst, round(list_distance(a.x, b.x), 12) AS d FROM sc a JOIN sc b ON a.q = b.q AND a.tid <> b.tid"),
    "ty": (["wf"], "SELECT tid, q, CAST(list_position(x[2:7], list_max(x[2:7])) - 1 AS INTEGER) AS ty, least(1.0, list_max(x[2:7]) + 0.5) AS conf FROM wf"),
    "pl": ([], "SELECT s_suppkey AS tid, n_name AS nation, r_name AS region, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "ev": ([], "SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label FROM embeddings"),
}


def _graph(name: str, pairs: str, mutual: bool = True) -> None:
    a = f"{name}_"
    STEPS[f"{a}k"] = ([pairs], f"SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY d, dst) AS rank FROM {pairs} QUALIFY rank <= {NEAR}")
    STEPS[f"{a}w"] = ([f"{a}k"], f"SELECT q, src, dst, 1 / (d + 0.001) AS w, rank FROM {a}k")
    main = f"SELECT a.q, a.src, a.dst, least(a.w, b.w) AS w FROM {a}w a JOIN {a}w b ON a.q = b.q AND a.src = b.dst AND a.dst = b.src" if mutual else f"SELECT q, src, dst, w FROM {a}w UNION ALL SELECT q, dst, src, w FROM {a}w"
    STEPS[f"{a}0"] = ([f"{a}w"], f"SELECT q, src, dst, max(w) AS w FROM ({main} UNION ALL SELECT q, src, dst, w FROM {a}w WHERE rank <= {LEAST} UNION ALL SELECT q, dst, src, w FROM {a}w WHERE rank <= {LEAST}) GROUP BY ALL")
    STEPS[name] = ([f"{a}0"], f"SELECT q, src, dst, w / avg(w) OVER (PARTITION BY q) AS w FROM {a}0")


_graph("gc", "nn")
_graph("ge", "ne")
_graph("gu", "nn", mutual=False)
STEPS["sm_d"] = (["gc"], "SELECT q, src AS tid, 1 + sum(w) AS deg FROM gc GROUP BY ALL")
STEPS["sm_b"] = (["sc", "sm_d"], "SELECT sc.tid, sc.q, sc.x, coalesce(deg, 1.0) AS deg FROM sc LEFT JOIN sm_d USING (tid, q)")
STEPS["sm_s"] = (["gc", "sm_b"], "SELECT q, tid, list(v ORDER BY i) AS s FROM (SELECT g.q, g.src AS tid, i, sum(g.w / sqrt(b.deg) * b.x[i]) AS v FROM gc g JOIN sm_b b ON g.q = b.q AND g.dst = b.tid, range(1, 8) r(i) GROUP BY ALL) GROUP BY ALL")
STEPS["sm"] = (["sm_b", "sm_s"], "SELECT b.tid, b.q, [b.x[i] / b.deg + coalesce(s.s[i], 0.0) / sqrt(b.deg) for i in range(1, 8)] AS x FROM sm_b b LEFT JOIN sm_s s USING (tid, q)")


def kmeans(name: str, rows: str, iterations: int = 5, k: int = TYPES) -> str:
    """Steps of the fixed Lloyd rounds over (tid, q, x) of step ``rows``; returns the step that holds distances d."""
    a = f"{name}_c"
    STEPS[f"{a}0"] = ([rows], f"SELECT row_number() OVER (ORDER BY h) - 1 AS code, x FROM (SELECT x, md5(concat_ws('|', '42', tid, q)) AS h FROM {rows} ORDER BY h LIMIT {k})")
    for t in range(iterations):
        near_ = f"SELECT p.tid, p.q, min({{'d': round(list_aggregate([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, 8)], 'sum'), 9), 'c': c.code}}).c AS code FROM {rows} p, {a}{t} c GROUP BY ALL"
        STEPS[f"{name}_a{t}"] = ([rows, f"{a}{t}"], near_)
        STEPS[f"{name}_m{t}"] = ([rows, f"{name}_a{t}"], f"SELECT code, list(v ORDER BY i) AS x FROM (SELECT code, i, round(avg(x[i]), 9) AS v FROM {rows} JOIN {name}_a{t} USING (tid, q), range(1, 8) r(i) GROUP BY ALL) GROUP BY code")
        STEPS[f"{a}{t + 1}"] = ([f"{a}{t}", f"{name}_m{t}"], f"SELECT c.code, coalesce(m.x, c.x) AS x FROM {a}{t} c LEFT JOIN {name}_m{t} m USING (code)")
    STEPS[f"{name}_d"] = ([rows, f"{a}{iterations}"], f"SELECT p.tid, p.q, list(round(list_aggregate([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, 8)], 'sum'), 9) ORDER BY c.code) AS d FROM {rows} p, {a}{iterations} c GROUP BY ALL")
    return f"{name}_d"


def steps(last: str, *needed: str, recursive: str = "") -> str:
    """``WITH`` all steps that ``needed`` ask for, then ``recursive`` ones, then ``last``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in STEPS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needed:
        visit(n)
    ctes = [f"{n} AS MATERIALIZED ({STEPS[n][1]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {last}" if ctes else last
