from tessera.streaming import events


def test_sliding_levels(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", 1.0) for m in range(0, 40, 5)]
    spark.createDataFrame(rows, "u int, ts string, v double").selectExpr("u", "cast(ts as timestamp) ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = events.sliding_levels(stream, "u", "ts", "v", "20 minutes", "10 minutes", "5 minutes").writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start.strftime("%H:%M"): (r.total, r.n) for r in spark.table("levels").collect()}
    assert got["00:00"] == (4.0, 4) and got["00:30"] == (2.0, 2) and len(got) == 5


def test_confirmed_changes(spark, tmp_path):
    seq = {1: [0, 0, 1, 1, 1, 1], 2: [0, 1, 0, 1, 1, 2], 3: [2, 1, 1, 1, 0, 0, 0]}
    for part in range(2):
        rows = [(u, i, x) for u, xs in seq.items() for i, x in enumerate(xs) if i % 7 // 4 == part]
        spark.createDataFrame(rows, "u int, i int, ty int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, i int, ty int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.confirmed_changes(stream, "u", "ty", "i").writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.table("changes").collect())) == [(1, 0, 1), (3, 1, 0), (3, 2, 1)]
