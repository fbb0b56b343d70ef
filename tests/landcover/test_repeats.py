"""Steps whose rows must not repeat: ids that are wanted, profiles of clusters, places of a disc."""

import random

from pyspark.sql import functions as F

from landweave.operators import neighborhood, sampling
from landweave.sources import scans


def test_wanted_ids_are_distinct_before_they_move(spark):
    scenes = spark.range(50).withColumnRenamed("id", "scene_id")
    wanted = spark.range(5000).select((F.col("id") % 7 * 10).alias("scene_id")).unionByName(spark.sql("select cast(null as bigint) as scene_id"))
    found = scans.scenes_by_id(scenes, wanted)
    assert "Aggregate" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.scene_id for r in found.collect()) == [0, 10, 20, 30, 40]


def test_profiles_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    base = spark.range(200).select("id", (F.col("id") % 2 * 5 + F.col("id") / 1000).alias("a"), (F.col("id") / 500).alias("b"))
    found, silhouettes = sampling.cluster_profiles(base.mapInArrow(count, base.schema), ["a", "b"], ks=(2, 3))
    assert found.count() == 200 and set(silhouettes) == {2, 3}
    assert len({(r.id % 2, r.cluster) for r in found.collect()}) == 2
    assert made.value == 200


def test_disc_max_at_pixels(spark):
    """Against the definition, over seams of tiles, below zero, with values that are null."""
    rng = random.Random(5)
    places = {(k, rng.choice((-1, 0, 1, 2)) * 64 + rng.randrange(-5, 5), rng.choice((-1, 0, 1)) * 64 + rng.randrange(-5, 5)) for k in (1, 2) for _ in range(150)}
    rows = [(k, r, c, None if rng.random() < 0.5 else rng.randrange(-50, 50)) for k, r, c in sorted(places)] + [(1, None, 3, 9)]
    pixels = spark.createDataFrame(rows, "k int, row int, col int, v int")
    for radius in (0, 2, 3):
        got = neighborhood.disc_max_at_pixels(pixels, "v", radius, ["k"])
        assert got.schema["v"].dataType == pixels.schema["v"].dataType
        near = lambda k, r, c: [v for q, s, t, v in rows if q == k and v is not None and s is not None and (s - r) ** 2 + (t - c) ** 2 <= radius**2]
        want = [(k, r, c, None if r is None else max(near(k, r, c), default=None)) for k, r, c, _ in rows]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert neighborhood.disc_max_at_pixels(pixels.withColumn("v", F.lit(None).cast("double")), "v", 2, ["k"]).where("v is null").count() == len(rows)
