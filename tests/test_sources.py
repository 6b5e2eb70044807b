import gzip
import math

import pytest

from tessera.sources import tables


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;name;x\n007;n;1,5\n")
    got = tables.wide_csv(spark, str(tmp_path / "a.csv"), ["code", "x", "section"], {"section": ""})
    assert [tuple(r) for r in got.collect()] == [("007", "1,5", "")]
    with pytest.raises(ValueError):
        tables.wide_csv(spark, str(tmp_path / "a.csv"), ["none"])
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("code,x\n007,1.5\n")
    assert tuple(tables.typed_csv(spark, str(tmp_path / "b.csv.gz"), "code string, x double").first()) == ("007", 1.5)


def test_manifest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = tables.manifest(spark, str(tmp_path / "f")).first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")
    want = spark.createDataFrame([("f", row.sha256), ("g", "x")], "name string, sha256 string")
    assert [r.name for r in tables.verified(spark, str(tmp_path / "f"), want).collect()] == ["g"]


def test_roads(spark):
    e = spark.createDataFrame([(1, 2, "highway", 5.0), (2, 1, "highway", 4.0), (1, 1, "highway", 0.0), (1, 9, "highway", 1.0), (1, 3, "rail", 1.0)], "src int, dst int, type string, d double")
    n = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(map(tuple, tables.roads(e, n, "highway").collect())) == [(1, 2, 4.0), (2, 1, 4.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.5, None), (3, float("inf"), "c")], "i int, x double, s string")
    assert [r.json for r in tables.json_rows(df.orderBy("i")).collect()] == ['{"i":1,"x":null,"s":"a"}', '{"i":2,"x":1.5,"s":null}', '{"i":3,"x":null,"s":"c"}']
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    tables.write_parquet(df, str(tmp_path / "p"), ["i"])
    assert spark.read.parquet(str(tmp_path / "p")).where("i = 2").first().x == 1.5
    a, b = (tables.table_hash(df.orderBy(o)).first() for o in ("i", "s"))
    assert a == b and a != tables.table_hash(df.unionAll(df)).first()
    assert tables.same_rows(df, df.orderBy("s")) and not tables.same_rows(df, df.unionAll(df))
    assert tables.cleaned({"a": [math.nan, 1.0], 2: math.inf}) == {"a": [None, 1.0], "2": None}


def test_lineage_and_templates():
    a = tables.lineage({"x": "1"})
    assert len(a["run_id"]) == 16 and a["run_id"] != tables.lineage({"x": "2"})["run_id"]
    assert tables.render("n = <<N>>", {"N": "3"}) == "n = 3"
    with pytest.raises(ValueError):
        tables.render("<<N>> <<M>>", {"N": "3"})
