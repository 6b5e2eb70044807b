from tessera.plans import dynamics


def test_all_orders_make_neighbours(spark, tmp_path):
    rows = [(o, s) for o in range(1, 41) for s in (o, o + 1, o + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in dynamics._roads(spark, str(tmp_path)).select("src", "dst").collect())
    assert got == sorted([(s, s + 1) for s in range(1, 41)] + [(s + 1, s) for s in range(1, 41)])
