"""Queries that fit again: on subsamples of the entities, and without smoothing; types are matched to those of the whole fit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, graph, indices, model, stats
from tessera.sources.scratch import written

from . import base as B
from . import models as M
from .catalogue import query

REPLICATES, SHARE, SEED = 3, 0.8, 42
DAY = "CAST(q AS VARCHAR) AS q"


def _labels_sql(n: str, d: str) -> str:
    """Steps of the paths over distances ``d`` and ``lab`` (tid, q, c) with the final codes, all names ending in ``n``."""
    paths = re.sub(r"\b(pn|sq|fw|bk|rn)\b", rf"\g<1>{n}", M.paths_sql(d))
    return f"{paths}, lab{n} AS MATERIALIZED (SELECT tid, q, CAST(r.new AS INTEGER) AS c FROM bk{n} JOIN sq{n} USING (tid, i) JOIN rn{n} r ON r.code = t - 1)"


_PERMS = "perms AS MATERIALIZED (SELECT p FROM (SELECT [a, b, c, d, e] AS p FROM " + ", ".join(f"range(0, {M.K}) r{x}({x})" for x in "abcde") + f") WHERE list_unique(p) = {M.K})"


def _matched_sql(n: str) -> str:
    """``cell`` (a of the whole fit, b of this one, n) and ``best`` (p, s): the map of the largest overlap."""
    return f"""cell{n} AS MATERIALIZED (SELECT u.c AS a, v.c AS b, count(*) AS n FROM lab u JOIN lab{n} v USING (tid, q) GROUP BY ALL),
    best{n} AS MATERIALIZED (SELECT p, CAST(sum(n) AS BIGINT) AS s FROM (SELECT p, CASE WHEN p[b + 1] = a THEN n ELSE 0 END AS n FROM perms, cell{n}) GROUP BY p ORDER BY s DESC, p LIMIT 1)"""


def _agreement_sql(n: str) -> str:
    return f"""SELECT n, round(1 - s / n, 6) AS changed, round(coalesce((x - xa * xb / t) / nullif((xa + xb) / 2 - xa * xb / t, 0), 1), 6) AS "ARI" FROM (SELECT s FROM best{n}),
    (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2) AS x, sum(n) * (sum(n) - 1) / 2 AS t FROM cell{n}),
    (SELECT sum(n * (n - 1) / 2) AS xa FROM (SELECT sum(n) AS n FROM cell{n} GROUP BY a)), (SELECT sum(n * (n - 1) / 2) AS xb FROM (SELECT sum(n) AS n FROM cell{n} GROUP BY b))"""


def _copied(n: str) -> str:
    """Copies of all steps from the scaling on, over the windows of replicate ``n``; returns the step of distances."""
    own: list[str] = []

    def visit(name: str) -> None:
        if name != "wf" and name not in own:
            for m in B.STEPS[name][0]:
                visit(m)
            own.append(name)

    visit(M.SMOOTH)
    change = lambda t: re.sub(r"\bwf\b", f"wf{n}", re.sub(rf"\b({'|'.join(own)})\b", rf"\g<1>_r{n}", t))
    B.STEPS[f"wf{n}"] = (["wf"], f"SELECT * FROM wf WHERE tid IN (SELECT tid FROM (SELECT tid, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', '{n}', tid)), tid) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT tid FROM wf)) WHERE rn <= floor(n * {SHARE}))")
    for name in own:
        needs, sql = B.STEPS[name]
        B.STEPS[f"{name}_r{n}"] = ([change(m) for m in needs], change(sql))
    return change(M.SMOOTH)


_COPIES = {str(n): _copied(str(n)) for n in range(1, REPLICATES + 1)}
_REFITS = ", ".join([_labels_sql("", M.SMOOTH), _PERMS, *[f"{_labels_sql(n, d)}, {_matched_sql(n)}" for n, d in _COPIES.items()]])


def matched(whole: DataFrame, other: DataFrame) -> DataFrame:
    """(tid, q, type, again): labels of the ``other`` fit in the codes of the whole one, where both have a row."""
    both = written(whole.select("tid", "q", "type").join(other.select("tid", "q", F.col("type").alias("candidate")), ["tid", "q"]), "both")
    codes = model.match_labels(both.withColumnRenamed("type", "reference"), "reference", "candidate", M.K)
    return both.join(F.broadcast(codes), "candidate").select("tid", "q", "type", F.col("reference").alias("again"))  # K rows


def refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(replicate, tid, q, type, again): in each replicate four fifths of the entities are drawn without replacement, scaled
    by their own statistics, linked, smoothed and fitted anew."""
    rows = written(B.windows(spark, sf_dir), "windows")

    def fit(some: DataFrame) -> DataFrame:
        plain = written(features.scaled(some, "x", B.SIZE), "scaled")
        return written(M.fit_rows(graph.smoothed(plain, B.edges(spark, sf_dir, rows=plain), "q", "tid", "x", B.SIZE)).select("tid", "q", "type"), "types")

    whole = fit(rows)
    drawn = written(stats.subsamples(rows.select("tid").distinct(), "tid", REPLICATES, SHARE, SEED), "drawn")
    out = None
    for n in range(1, REPLICATES + 1):
        here = matched(whole, fit(rows.join(drawn.where(F.col("replicate") == n).select("tid"), "tid", "left_semi"))).withColumn("replicate", F.lit(n))
        out = here if out is None else out.unionByName(here)
    return written(out, "refits")


@query(B.steps(" UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS replicate, * FROM ({_agreement_sql(n)})" for n in _COPIES), M.SMOOTH, *_COPIES.values(), recursive=_REFITS))
def bootstrap_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of windows whose type changes in a refit, and the agreement of both partitions, by replicate."""
    r = refits(spark, sf_dir)
    share = r.groupBy("replicate").agg(F.count("*").alias("n"), B.r(F.avg((F.col("type") != F.col("again")).cast("double"))).alias("changed"))
    return share.join(indices.adjusted_rand(r, "type", "again", ["replicate"]), "replicate").select("replicate", "n", "changed", B.r("ARI").alias("ARI"))


_HITS = " UNION ALL ".join(f"SELECT tid, q, CASE WHEN p[v.c + 1] = u.c THEN 1 ELSE 0 END AS hit FROM lab u JOIN lab{n} v USING (tid, q), best{n}" for n in _COPIES)


@query(B.steps(f"SELECT tid, {DAY}, CAST(count(*) AS BIGINT) AS n, round(avg(hit), 6) AS confidence FROM ({_HITS}) GROUP BY tid, q", M.SMOOTH, *_COPIES.values(), recursive=_REFITS))
def refit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window, of the refits that drew its entity, the share that gives it the type of the whole fit."""
    hit = (F.col("type") == F.col("again")).cast("double")
    return refits(spark, sf_dir).groupBy("tid", "q").agg(F.count("*").alias("n"), B.r(F.avg(hit)).alias("confidence")).select("tid", B.day("q"), "n", "confidence")


@query(B.steps(_agreement_sql("s"), M.SMOOTH, M.RAW, recursive=", ".join([_labels_sql("", M.SMOOTH), _PERMS, _labels_sql("s", M.RAW), _matched_sql("s")])))
def smoothing_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with and without smoothing over the graph: share that differs after matching, and agreement."""
    plain = B.scaled(spark, sf_dir)
    whole = M.fit_rows(graph.smoothed(plain, B.edges(spark, sf_dir, rows=plain), "q", "tid", "x", B.SIZE))
    m = written(matched(whole, M.fit_rows(plain)), "matched")
    return m.agg(F.count("*").alias("n"), B.r(F.avg((F.col("type") != F.col("again")).cast("double"))).alias("changed")).crossJoin(indices.adjusted_rand(m, "type", "again")).select("n", "changed", B.r("ARI").alias("ARI"))
