"""Registered queries against their SQL on the smallest tables, and plans that must stay as they are."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from landweave.plans import catalog, lineages, models, overlays, pixels
from landweave.sources import fixtures, scans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for b in (pixels.book, overlays.book, models.book, lineages.book) for n in b.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}".replace("-0.000000", "0.000000")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, ([plain(v) for v in r] for r in df.select(cols).collect())))
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry_and_names(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_push_filters_and_prune_columns(spark, tmp_path):
    path = str(tmp_path / "scenes")
    fixtures.scenes(spark, SF).withColumn("year", F.year("acq_date")).write.partitionBy("year").parquet(path)
    p = plan(scans.scan_scenes(scans.scan_year(spark.read.parquet(path), 1996), "1996-01-01", "1997-01-01", 30).select("scene_id"))
    assert "PartitionFilters: [isnotnull(year" in p and "PushedFilters: [IsNotNull(acq_date)" in p and "tile" not in p.split("ReadSchema")[1]


def test_band_functions_stay_in_the_jvm(spark):
    p = plan(pixels.book.queries["p9_p10_fraction_indices"](spark, SF))
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
