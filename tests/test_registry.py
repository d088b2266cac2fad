"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusmill import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df, columns):
    return sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = db.execute(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([rows(registry.QUERIES[q](spark, SF).toPandas(), c) for q, c in (("write_order", ["rel_path", "seq", "entry_id"]), ("solid_blocks", ["blob_id", "block_id", "block_offset"]))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
