"""Context beside spending: lenses, training rows, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import context


def _frames(spark):
    windows = spark.createDataFrame([(t, q, [float(t), float(t * q)]) for t in (1, 2, 3) for q in (1, 2)], "tid long, q int, x array<double>")
    known = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, None]), (9, [50.0, 1.0])], "tid long, x array<double>")
    return windows, known


def test_blocks_and_lenses(spark):
    windows, known = _frames(spark)
    make = lambda lens: {(r.tid, r.q): r.x for r in context.scaled_arrays(windows, known, "tid", "x", 2, 2, 0.5, lens).collect()}
    both, spend, static = make("combined"), make("spend"), make("context")
    assert len(both) == 6 and all(len(v) == 4 for v in both.values()) and all(len(v) == 2 for v in [*spend.values(), *static.values()])
    for k, v in both.items():
        assert v == pytest.approx([x * 0.5**0.5 for x in spend[k] + static[k]])
    # the third entity has no context: the median of the others; the second coordinate has no value anywhere: 0
    assert both[3, 1][2] == pytest.approx(0.0) and all(v[3] == 0.0 for v in both.values())
    with pytest.raises(ValueError):
        make("other")


def test_training_rows_alone_make_the_statistics(spark):
    windows, known = _frames(spark)
    got = {(r.tid, r.q): r.x for r in context.scaled_arrays(windows, known, "tid", "x", 2, 2, 0.5, "combined", train=F.col("tid") < 3).collect()}
    assert got[1, 1][0] == pytest.approx(-(0.25**0.5)) and got[3, 1][0] == pytest.approx(3 * 0.25**0.5)


def test_sums_are_null_only_without_any_value(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(context.sum_or_null([F.col("a"), F.col("b")])).collect()] == [1.0, None, 2.0]


def test_centers_of_periods(spark):
    df = spark.createDataFrame([(q, t, [float(q * 10 + (t > 2) * 5)]) for q in (1, 2) for t in (1, 2, 3, 4)], "q int, tid long, x array<double>")
    got = {r.q: sorted(c[0] for c in r.centers) for r in context.period_centers(df, "q", "x", 1, 4, F.col("tid").cast("string")).collect()}
    assert {q: (v[0], v[-1]) for q, v in got.items()} == {1: (10.0, 15.0), 2: (20.0, 25.0)}
    assert context.period_centers(df.where("q > 5"), "q", "x", 1, 4, F.col("tid").cast("string")).count() == 0


def test_switches_and_forms(spark):
    paths = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 1, 3)], "tid int, q int, type int")
    assert {r.tid: r.switches for r in context.switches(paths, "tid", "q", "type").collect()} == {1: 2, 2: 0}
    df = spark.createDataFrame([("EAST", 1234567.5), ("x", 0.0), (None, None)], "a string, b double")
    got = [tuple(r) for r in df.select(S.section_letter(F.col("a"), "E", "Е"), S.spaced_number(F.col("b"), 2)).collect()]
    assert got == [("Е", "1\u2009234\u2009567,50"), ("", "0,00"), (None, None)]
