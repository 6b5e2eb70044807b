"""Every query that has SQL gives the rows of that SQL, at the smallest size."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from tessera.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    cur = con.execute(registry.ORACLE_SQL[name])
    want = ([d[0] for d in cur.description], cur.fetchall())
    df = registry.QUERIES[name](spark, SF)
    got = (df.columns, df.collect())
    spark.catalog.clearCache()
    assert not compare.differences(name, got, want)
    assert want[1] or name in ("panel_excluded", "unique_key_filter")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
