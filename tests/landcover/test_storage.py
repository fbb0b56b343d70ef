"""Writes, incremental runs and shared intermediates."""

import pytest
from pyspark.sql import functions as F

from landweave.operators.components import connected_components
from landweave.operators.skew import join_counted
from landweave.sources import scans
from landweave.storage import discard, materialize, scratch_dir
from landweave.streaming import incremental

SHAPE = "image_id long, ts timestamp, tile int"


def test_materialized_tables_live_in_the_shared_folder(spark):
    m = materialize(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert m.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(scratch_dir(spark).removeprefix("file:").lstrip("/"))
    assert m.count() == 5
    discard(m)


def test_tiles_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "tiles")
    scans.write_tiles(spark.createDataFrame([(1, 5), (2, 6)], "year int, v int"), path, ["year"])
    scans.write_tiles(spark.createDataFrame([(2, 7)], "year int, v int"), path, ["year"])
    assert sorted((r.year, r.v) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 7)]


def test_restart_and_repeats(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    a = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 86400 + 10**9).alias("ts"), (F.col("id") % 3).cast("int").alias("tile")).toDF("image_id", "ts", "tile")

    def run():
        incremental.process(incremental.arriving(spark, src, a.schema), lambda b: b.select("image_id"), out, mark).awaitTermination()
        return sorted(r.image_id for r in spark.read.parquet(out).collect())

    a.where("image_id < 4").write.parquet(src)
    assert run() == [0, 1, 2, 3]
    a.where("image_id between 2 and 6").write.mode("append").parquet(src)
    assert run() == list(range(7))
    assert run() == list(range(7))


def scenes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, day int, tile int").select("image_id", F.timestamp_seconds(F.col("day") * 86400 + 10**9).alias("ts"), "tile")


def test_late_scenes_are_taken_and_repeats_are_not(spark, tmp_path):
    """A scene 90 days late, ids that come again with other times, and rows that repeat an id in one batch."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run(mark="mark"):
        stream = incremental.arriving(spark, src, scenes(spark, []).schema, files=1)
        incremental.process(stream, lambda b: b.select("image_id", "tile"), out, str(tmp_path / mark)).awaitTermination()
        return sorted((r.image_id, r.tile) for r in spark.read.parquet(out).collect())

    scenes(spark, [(1, 100, 0), (2, 101, 0), (2, 101, 1), (None, 101, 1)]).coalesce(1).write.parquet(src)
    assert run() == [(1, 0), (2, 0)]
    scenes(spark, [(3, 11, 5), (1, 150, 7), (2, 10, 9)]).coalesce(1).write.mode("append").parquet(src)
    assert run() == [(1, 0), (2, 0), (3, 5)]
    # Another checkpoint counts its batches from 0 and reads everything again.
    assert run("other") == [(1, 0), (2, 0), (3, 5)]


def test_break_between_output_and_note(spark, tmp_path, monkeypatch):
    """A batch that breaks off after its output, and one after its note: run again, each scene has one output."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    note, calls = incremental._finish, []

    def run():
        stream = incremental.arriving(spark, src, scenes(spark, []).schema)
        incremental.process(stream, lambda b: b.select("image_id"), out, mark).awaitTermination()

    def before(ids, path):
        raise RuntimeError("lost")

    def after(ids, path):
        note(ids, path)
        calls.append(path)
        raise RuntimeError("lost")

    scenes(spark, [(1, 1, 0), (2, 2, 0)]).write.parquet(src)
    for broken in (before, after):
        monkeypatch.setattr(incremental, "_finish", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    monkeypatch.setattr(incremental, "_finish", note)
    run()
    scenes(spark, [(2, 9, 0), (3, 3, 0)]).write.mode("append").parquet(src)
    run()
    assert len(calls) == 1 and sorted(r.image_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5), (None, 7), (2000, 2001)]
    for few in (0, 1000):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {i: 1 for i in range(1, 201)} | {1000 + i: 1000 for i in range(300)} | {2000 + i: 2000 for i in range(3)}
        assert connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_shuffle_files_go_with_the_write(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    m = materialize(df)
    assert spark.conf.get(name) == "false" and sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect())) == [(0, 34), (1, 33), (2, 33)]


def test_counted_join_is_a_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k % 2 = 0")
    got = join_counted(rows, counts, "k", "n", 3000).select("id", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(counts, "k").select("id", "m").collect()))
