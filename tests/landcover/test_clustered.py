"""Files along the Morton curve."""

import random

from pyspark.sql import functions as F

from landweave.sources import clustered

SHAPE = "year int, row int, col int, v long"


def test_morton_interleaves(spark):
    rng = random.Random(1)
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1), (2**31 - 1, 0), (0, 2**31 - 1), (2**31 - 1, 2**31 - 1)] + [(rng.randrange(2**31), rng.randrange(2**31)) for _ in range(200)]
    got = spark.createDataFrame(pairs, "row long, col long").select("row", "col", clustered.morton(F.col("row"), F.col("col")).alias("m")).collect()
    for r in got:
        assert r.m == sum((r.row >> b & 1) << 2 * b + 1 | (r.col >> b & 1) << 2 * b for b in range(31))


def test_windows_read_only_the_files_they_meet(spark, tmp_path):
    path = str(tmp_path / "grid")
    data = [(y, r, c, y * 10**6 + r * 1000 + c) for y in (1995, 1996, 1997) for r in range(64) for c in range(64)]
    df = spark.createDataFrame(data, SHAPE)
    clustered.write_clustered(df, path, 16, tile=4)
    zones = spark.read.parquet(f"{path}/zones").collect()
    assert len(zones) == 16 and sum(z.n for z in zones) == len(data)
    # Files are compact: their boxes together cover the grid about twice, where strips or hashes would cover it far more often.
    assert sum((z.max_row - z.min_row + 1) * (z.max_col - z.min_col + 1) for z in zones) < 3 * 64 * 64
    for rows, cols, dates in (((3, 9), (2, 8), None), ((20, 44), (30, 31), (1996, 1997)), ((0, 64), (0, 64), None), ((60, 99), (60, 99), (1990, 1996))):
        got = clustered.read_window(spark, path, df.schema, rows, cols, dates)
        assert sorted(map(tuple, got.collect())) == [t for t in sorted(data) if rows[0] <= t[1] < rows[1] and cols[0] <= t[2] < cols[1] and (dates is None or dates[0] <= t[0] < dates[1])]
        opened = {f.rsplit("/", 1)[1] for f in got.inputFiles()}
        assert opened == {z.file for z in zones if z.max_row >= rows[0] and z.min_row < rows[1] and z.max_col >= cols[0] and z.min_col < cols[1]}
    assert len(clustered.read_window(spark, path, df.schema, (3, 9), (2, 8)).inputFiles()) <= 4
    # The plan's scan has the files of the window, and filters that reach them.
    plan = clustered.read_window(spark, path, df.schema, (3, 9), (2, 8)).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(row)" in plan


def test_empty_and_null(spark, tmp_path):
    path = str(tmp_path / "grid")
    clustered.write_clustered(spark.createDataFrame([(1995, None, 1, 1), (None, 1, 1, 1), (1995, 2, 2, 7)], SHAPE), path, 4)
    schema = spark.createDataFrame([], SHAPE).schema
    assert [r.v for r in clustered.read_window(spark, path, schema, (0, 9), (0, 9)).collect()] == [7]
    assert clustered.read_window(spark, path, schema, (5, 9), (0, 9)).count() == 0
    clustered.write_clustered(spark.createDataFrame([], SHAPE), path, 4)
    assert clustered.read_window(spark, path, schema, (0, 9), (0, 9)).count() == 0
