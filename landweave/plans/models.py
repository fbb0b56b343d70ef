"""Queries of chips, augmentation, metrics, inference and incremental runs (A, G, N, UD, U, ST, SK)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from landweave.functions import arrays, bands
from landweave.operators import chips as ch
from landweave.operators import composite, metrics, overlay, raking, sampling
from landweave.plans.book import Book
from landweave.sources import fixtures as fx
from landweave.sources import clustered, scans, versions
from landweave.sources.fixtures import sql
from landweave.storage import scratch_dir
from landweave.streaming import incremental

book = Book()


def _checksum(data):
    return F.aggregate(F.transform(data, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _sum_sql(index: str) -> str:
    """Checksum of the array whose place i holds data[index(i)]."""
    return f"SELECT chip_id, (SELECT sum(data[({index}) + 1] * (i + 1)) FROM range(64) r(i)) AS checksum FROM chips"


UP, LEFT = "(3 - i // 16) * 16 + i % 16", "i // 16 * 16 + (3 - i // 4 % 4) * 4 + i % 4"
TURN = "(i // 4 % 4) * 16 + (3 - i // 16) * 4 + i % 4"


@book.add(sql(_sum_sql(UP), "chips"), ["checksum"])
def a1_flip_up_down(spark, d):
    return fx.chips(spark, d).select("chip_id", _checksum(arrays.flip_up_down(F.col("data"), 4, 4, 4)).alias("checksum"))


@book.add(sql(_sum_sql(LEFT), "chips"), ["checksum"])
def a2_flip_left_right(spark, d):
    return fx.chips(spark, d).select("chip_id", _checksum(arrays.flip_left_right(F.col("data"), 4, 4, 4)).alias("checksum"))


@book.add(sql(_sum_sql(TURN), "chips"), ["checksum"])
def a3_rotate_90(spark, d):
    return fx.chips(spark, d).select("chip_id", _checksum(arrays.rotate_90(F.col("data"), 4, 4, 4)).alias("checksum"))


@book.add(sql("+u AS (" + " UNION ALL ".join(f"SELECT *, '{t}' AS aug FROM ({_sum_sql(x)})" for t, x in (("original", "i"), ("rotated", TURN), ("left_right", LEFT), ("up_down", UP))) + ") SELECT chip_id, aug, checksum FROM u", "chips"), ["checksum"])
def a4_u1_augmented(spark, d):
    return ch.augmented(fx.chips(spark, d), 4, 4, 4).select("chip_id", "aug", _checksum(F.col("data")).alias("checksum"))


@book.add(sql(_sum_sql("(i % 16) * 4 + i // 16"), "chips"), ["checksum"])
def a6_channel_first(spark, d):
    return fx.chips(spark, d).select("chip_id", _checksum(arrays.to_channel_first(F.col("data"), 4, 4, 4)).alias("checksum"))


def _hash(seed: int) -> str:
    return f"((chip_id::HUGEINT + {seed}) % 2147483648 * 2654435761 % 4294967296)::BIGINT"


TURNS = f"""+h AS (SELECT chip_id, data, {_hash(0)} < 2147483648 AS up, {_hash(1)} < 2147483648 AS lft, radians(({_hash(2)} / 2147483648.0::DOUBLE - 1) * 45.0) AS a FROM chips),
 p AS (SELECT *, i // 8 - 3.5::DOUBLE AS y, i % 8 - 3.5::DOUBLE AS x FROM h, range(64) r(i)),
 s AS (SELECT *, round_even(y * cos(a) + x * sin(a) + 3.5, 0)::INT AS rr, round_even(x * cos(a) - y * sin(a) + 3.5, 0)::INT AS kk FROM p)
 SELECT chip_id, sum(CASE WHEN rr BETWEEN 0 AND 7 AND kk BETWEEN 0 AND 7 THEN data[(CASE WHEN up THEN 7 - rr ELSE rr END) * 8 + (CASE WHEN lft THEN 7 - kk ELSE kk END) + 1] ELSE 0 END * (i + 1)) AS checksum FROM s GROUP BY chip_id"""


@book.add(sql(TURNS, "chips"), ["checksum"])
def a5_random_turns(spark, d):
    return ch.randomly_turned(fx.chips(spark, d), 8, 8, 1).select("chip_id", _checksum(F.col("data")).alias("checksum"))


FINER = """+p AS (SELECT chip_id, data, i, least(greatest((i // 16 + 0.5) / 2 - 0.5, 0), 7)::DOUBLE AS y, least(greatest((i % 16 + 0.5) / 2 - 0.5, 0), 7)::DOUBLE AS x FROM chips, range(256) r(i)),
 q AS (SELECT *, floor(y)::INT AS r0, floor(x)::INT AS k0, least(floor(y)::INT + 1, 7) AS r1, least(floor(x)::INT + 1, 7) AS k1 FROM p)
 SELECT chip_id, count(*)::INT AS n, sum((i + 1) * ((data[r0 * 8 + k0 + 1] * (1 - y + r0) + data[r1 * 8 + k0 + 1] * (y - r0)) * (1 - x + k0) + (data[r0 * 8 + k1 + 1] * (1 - y + r0) + data[r1 * 8 + k1 + 1] * (y - r0)) * (x - k0))) AS checksum FROM q GROUP BY chip_id"""


@book.add(sql(FINER, "chips"), ["checksum"])
def n6_resampled(spark, d):
    return ch.resampled(fx.chips(spark, d), 8, 8, 1, (16, 16)).select("chip_id", F.size("data").alias("n"), _checksum(F.col("data")).alias("checksum"))


@book.add(sql("SELECT chip_id, (i - 1) // 16 AS row, (i - 1) // 4 % 4 AS col, (i - 1) % 4 AS channel, data[i] AS value FROM chips, range(1, 65) r(i)", "chips"), ["value"])
def ud3_chip_values(spark, d):
    return ch.to_pixels(fx.chips(spark, d), 4, 4)


EPS = 1e-7
R = "sum(round_even(least(greatest(y_true * y_pred, 0), 1), 0))"


@book.add(sql(f"+a AS (SELECT {R} / (sum(round_even(y_true, 0)) + {EPS}) AS recall, {R} / (sum(round_even(y_pred, 0)) + {EPS}) AS precision, 1 - (2 * sum(y_true * y_pred) + 1) / (sum(y_true * y_true) + sum(y_pred * y_pred) + 1) AS soft_dice FROM scores) SELECT recall, precision, 2 * precision * recall / (precision + recall + {EPS}) AS f1, soft_dice FROM a", "scores"), ["recall", "precision", "f1", "soft_dice"])
def g13_g17_ud5_binary_metrics(spark, d):
    return metrics.evaluate(fx.scores(spark, d))


@book.add(sql("SELECT avg(x) AS batch_dice FROM (SELECT 1 - (2 * sum(y_true * y_pred) + 1) / (sum(y_true) + sum(y_pred) + 1) AS x FROM scores GROUP BY chip_id)", "scores"), ["batch_dice"])
def g19_batch_dice(spark, d):
    return metrics.batch_dice(fx.scores(spark, d))


SOFT = "+e AS (SELECT label % 4 AS y, [exp(list_sum(data[i:i + 15])) FOR i IN [1, 17, 33, 49]] AS e FROM chips) SELECT 1 - (2 * sum(e[(y + 1)::INT] / list_sum(e)) + 1) / (count(*) + count(*) + 1) AS softmax_dice FROM e"


@book.add(sql(SOFT, "chips"), ["softmax_dice"])
def g18_softmax_dice(spark, d):
    part = lambda i: F.aggregate(F.slice("data", 16 * i + 1, 16), F.lit(0.0), lambda a, x: a + x)
    wide = fx.chips(spark, d).select(*[part(i).alias(f"z{i}") for i in range(4)], (F.col("label") % 4).alias("y"))
    return metrics.softmax_dice(wide, [f"z{i}" for i in range(4)], "y")


PRED = "+p AS (SELECT label % 4 AS t, (list_position(data, list_max(data)) - 1) % 4 AS p FROM chips)"
PER = PRED + """, c AS (SELECT class, (SELECT count(*) FROM p WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM p WHERE t <> class AND p = class) AS fp, (SELECT count(*) FROM p WHERE t = class AND p <> class) AS fn FROM (SELECT t AS class FROM p UNION SELECT p FROM p)),
 m AS (SELECT class, tp, fp, fn, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, coalesce(tp / nullif(tp + fp + fn, 0), 0)::DOUBLE AS iou FROM c)"""


def _predicted(spark, d):
    return fx.chips(spark, d).select((F.col("label") % 4).alias("t"), (bands.arg_max(F.col("data")) % 4).alias("p"))


@book.add(sql(PRED + " SELECT t, p, count(*) AS n FROM p GROUP BY t, p", "chips"))
def g15_confusion(spark, d):
    return metrics.confusion(_predicted(spark, d), "t", "p")


@book.add(sql(PER + " SELECT * FROM m", "chips"), ["recall", "precision", "f1", "iou"])
def g14_g15_g16_per_class(spark, d):
    return metrics.per_class(_predicted(spark, d), "t", "p")


@book.add(sql(PER + " SELECT avg(recall) AS macro_recall, avg(precision) AS macro_precision, avg(f1) AS macro_f1, avg(iou) AS macro_iou, (SELECT avg((t = p)::INT) FROM p) AS accuracy FROM m", "chips"), ["macro_recall", "macro_precision", "macro_f1", "macro_iou", "accuracy"])
def g14_macro(spark, d):
    return metrics.macro(_predicted(spark, d), "t", "p")


@book.add(sql("+l AS (SELECT chip_id, pixel // 8 AS row, pixel % 8 AS col, -y_true * ln(q) * 0.25 - (1 - y_true) * ln(1 - q) * 0.75 AS x FROM (SELECT *, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS q FROM scores)) SELECT chip_id, avg(x * (SELECT max(x) FROM l b WHERE b.chip_id = a.chip_id AND b.row BETWEEN a.row - 3 AND a.row + 4 AND b.col BETWEEN a.col - 3 AND a.col + 4)) AS loss FROM l a GROUP BY chip_id", "scores"), ["loss"])
def g20_n4_local_max_loss(spark, d):
    s = fx.scores(spark, d).select("chip_id", F.floor(F.col("pixel") / 8).cast("int").alias("row"), (F.col("pixel") % 8).alias("col"), "y_true", "y_pred")
    return metrics.local_max_loss(s).groupBy("chip_id").agg(F.avg("loss").alias("loss"))


def linear_model():
    """The test model: mean of the channels with fixed weights, clipped to 0..1."""
    weights = np.array([0.5, -0.25, 1.0, 0.75])
    return lambda x: np.clip(0.1 + x @ weights, 0, 1)


LINEAR = "SELECT chip_id, i, least(greatest(0.1 + data[i * 4 + 1] * 0.5 - data[i * 4 + 2] * 0.25 + data[i * 4 + 3] + data[i * 4 + 4] * 0.75, 0), 1) AS p FROM chips, range(16) r(i)"


@book.add(sql(f"+m AS ({LINEAR}) SELECT chip_id, sum(trunc(p * 100)::INT)::BIGINT AS pct, max(p) AS top FROM m GROUP BY chip_id HAVING max(p) >= 0.5", "chips"), ["top"])
def ud1_f7_p28_inference(spark, d):
    found = ch.keep_detections(ch.predict(fx.chips(spark, d).select("chip_id", "data"), linear_model, (4, 4, 4)), 0.5)
    pct = F.aggregate(F.transform("probability", lambda x: bands.percent(x)), F.lit(0), lambda a, x: a + x).cast("long")
    return found.select("chip_id", pct.alias("pct"), F.array_max("probability").alias("top"))


SCENE = """+seeds AS (SELECT (l_suppkey % 40)::INT AS seed_id, max(row)::INT AS seed_row, max(col)::INT AS seed_col FROM li GROUP BY 1), m AS (SELECT row, col, median(red) AS red, median(nir) AS nir FROM scene_pixels GROUP BY row, col),
 w AS (SELECT seed_id, row, col, (row - seed_row + 4) * 8 + (col - seed_col + 4) AS at, least(greatest(0.2 + red / 2000 + nir / 8000, 0), 1) AS p FROM seeds, m WHERE row BETWEEN seed_row - 4 AND seed_row + 3 AND col BETWEEN seed_col - 4 AND seed_col + 3),
 k AS (SELECT *, max(p) OVER (PARTITION BY seed_id) AS top FROM w) SELECT row, col, arg_min(trunc(p * 100)::INT, seed_id) AS pct FROM k WHERE top >= 0.2 GROUP BY row, col"""


@book.add(sql(SCENE, "scene_pixels"))
def e1_scene_inference(spark, d):
    """Composite, windows around seeds, scoring, dropped chips, percent and mosaic: G1, J8, UD3, F7, P28, G22."""
    from landweave.plans.overlays import _seeds

    m = bands.composite_bands(composite.median(fx.scene_pixels(spark, d), ["red", "nir"]), ["red", "nir"], ["row", "col"])
    w = overlay.window_pixels(m, _seeds(spark, d), 8)
    p = w.withColumn("p", F.least(F.greatest(0.2 + F.col("red") / 2000 + F.col("nir") / 8000, F.lit(0.0)), F.lit(1.0)))
    kept = p.groupBy("seed_id").agg(F.max("p").alias("top")).where("top >= 0.2").select("seed_id")
    scored = p.join(kept, "seed_id", "left_semi").withColumn("pct", bands.percent("p"))
    return composite.mosaic(scored, "pct", "seed_id")


@book.add(sql("+m AS (SELECT row // 8 AS ti, col // 8 AS tj, row % 8 AS r, col % 8 AS c, median(red) AS red, median(nir) AS nir FROM scene_pixels GROUP BY ALL) SELECT (ti * 10000 + tj)::BIGINT AS chip_id, count(*)::INT AS pixels, sum(red) + sum(nir) AS total FROM m GROUP BY 1", "scene_pixels"), ["total"])
def sc7_sc8_chip_arrays(spark, d):
    m = bands.composite_bands(composite.median(fx.scene_pixels(spark, d), ["red", "nir"]), ["red", "nir"], ["row", "col"])
    cells = m.select((F.floor(F.col("row") / 8) * 10000 + F.floor(F.col("col") / 8)).cast("long").alias("chip_id"), (F.col("row") % 8).alias("chip_row"), (F.col("col") % 8).alias("chip_col"), "red", "nir")
    return ch.to_chips(cells, ["chip_id"], ["red", "nir"]).select("chip_id", "pixels", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _fresh(spark) -> str:
    return f"{scratch_dir(spark)}/landweave-{uuid.uuid4().hex}"


@book.add(sql("SELECT year, row, col, class FROM landcover", "landcover"))
def sk1_sk5_write_tiles(spark, d):
    """A partitioned write, one partition replaced by a rerun, and the read back."""
    path, l = _fresh(spark), fx.landcover(spark, d)
    scans.write_tiles(l.withColumn("class", F.when(F.col("year") == 1997, 0).otherwise(F.col("class"))), path, ["year"])
    scans.write_tiles(l.where("year = 1997"), path, ["year"])
    return spark.read.parquet(path).select("year", "row", "col", "class")


@book.add(sql("SELECT year, row, col, class, 30.0 * col + 1000 AS x, -30.0 * row + 5000 AS y FROM landcover", "landcover"), ["x", "y"])
def sk2_write_mosaic(spark, d):
    """A mosaic and its transform, written and read back with map coordinates."""
    path = _fresh(spark)
    scans.write_mosaic(fx.landcover(spark, d), path, (30.0, 1000.0, -30.0, 5000.0), ["year"])
    return scans.read_mosaic(spark, path).select("year", "row", "col", "class", "x", "y")


SPLIT = "CASE WHEN n < floor(k * 0.6 + 1e-9) THEN 'train' WHEN n < floor(k * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS split"


@book.add(sql(f"+r AS (SELECT chip_id, label, row_number() OVER (ORDER BY {_hash(0)}, chip_id) - 1 AS n, (SELECT count(*) FROM chips) AS k FROM chips) SELECT chip_id, label, {SPLIT} FROM r", "chips"))
def sk3_append_chip_records(spark, d):
    """Chip records appended to the files of their split, in two runs."""
    path, c = _fresh(spark), sampling.split(fx.chips(spark, d).select("chip_id", "label"), "chip_id").select("chip_id", "label", "split")
    for part in (c.where("label % 2 = 0"), c.where("label % 2 <> 0 or label is null")):
        scans.append_records(part, path)
    return spark.read.parquet(path).select("chip_id", "label", "split")


@book.add(sql(f"+r AS (SELECT id, x, y, row_number() OVER (ORDER BY {_hash(0).replace('chip_id', 'id')}, id) - 1 AS n, (SELECT count(*) FROM points) AS k FROM points) SELECT id, x, y, {SPLIT} FROM r", "points"), ["x", "y"])
def sk8_split_directories(spark, d):
    """Points placed in a directory for each split, read back directory by directory."""
    path, p = _fresh(spark), fx.points(spark, d)
    scans.place_by_split(p, sampling.split(p.select("id"), "id"), path)
    back = [spark.read.parquet(f"{path}/split={s}").select("id", "x", "y", F.lit(s).alias("split")) for s in ("train", "validation", "test")]
    return back[0].unionByName(back[1]).unionByName(back[2])


@book.add(sql("SELECT scene_id, tile, cloud_pct FROM scenes WHERE scene_id IN (SELECT o_orderkey % 1000 + 119700 FROM orders)", "scenes"))
def f5_scene_by_id(spark, d):
    wanted = fx.table(spark, d, "orders").select((F.col("o_orderkey") % 1000 + 119700).cast("long").alias("scene_id"))
    return scans.scenes_by_id(fx.scenes(spark, d), wanted).select("scene_id", "tile", "cloud_pct")


@book.add(sql("SELECT scene_id, row, col, CASE WHEN red <> 0 THEN red / 1000 END AS red, coalesce((nir / 1000 - red / 1000) / nullif(nir / 1000 + red / 1000, 0), 0) AS ndvi FROM scene_pixels", "scene_pixels"), ["red", "ndvi"])
def ud2_per_image_functions(spark, d):
    """Scaling, an index and a mask as functions of images over the whole collection."""
    scaled = lambda p: p.withColumns({b: F.col(b) / 1000 for b in ("red", "nir")})
    index = lambda p: p.withColumn("ndvi", bands.normalized_difference("nir", "red"))
    masked = lambda p: p.withColumn("red", bands.self_mask("red"))
    return scans.map_images(fx.scene_pixels(spark, d), scaled, index, masked).select("scene_id", "row", "col", "red", "ndvi")


@book.add(sql("SELECT id, x, y FROM points WHERE id > 100", "points"), ["x", "y"])
def sk6_write_points(spark, d):
    path = _fresh(spark)
    scans.write_points(fx.points(spark, d), path, 100, "id")
    return spark.read.parquet(path).select("id", "x", "y")


@book.add(sql("SELECT run::BIGINT AS run, count(*) AS n, sum(k)::BIGINT AS k FROM (SELECT l_suppkey % 5 AS run, year(l_shipdate) AS y, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY run", "g"))
def sk7_append_metrics(spark, d):
    path = _fresh(spark)
    log = fx.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("long").alias("run"), F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    scans.append_metrics(log.where("run < 3"), path)
    scans.append_metrics(log.where("run >= 3"), path)
    back = spark.read.schema("run long, y int, k long").option("sep", ";").csv(path)
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@book.add(sql("SELECT chip_id, (i - 1)::INT AS version, label + i - 1 AS label FROM chips, range(1, 3) r(i)", "chips"))
def sk9_sk10_dataset_versions(spark, d):
    root, c = _fresh(spark), fx.chips(spark, d)
    for v in (0, 1):
        scans.write_version(c.select("chip_id", (F.col("label") + v).alias("label")), root, v)
    return spark.read.parquet(root).select("chip_id", "version", F.col("label").cast("long").alias("label"))


RAKED = f"""+p AS (SELECT year * 1000000 + row // 3 * 1000 + col // 3 AS chip_id, class, count(*) AS n FROM landcover GROUP BY ALL),
 s AS (SELECT chip_id, class, n / sum(n) OVER (PARTITION BY chip_id) AS share FROM p),
 k AS (SELECT chip_id, string_agg(class::VARCHAR, '-' ORDER BY class) AS classes FROM s GROUP BY chip_id), z AS (SELECT classes, count(*) AS chips FROM k GROUP BY classes),
 m AS (SELECT classes, class, sum(share) / any_value(chips) AS share FROM s JOIN k USING (chip_id) JOIN z USING (classes) GROUP BY classes, class),
 t AS (SELECT class, target / sum(target) OVER () AS target FROM (VALUES {", ".join(f"({c}, {v}::DOUBLE)" for c, v in ({6: 0.0} | fx.SHARES).items())}) v(class, target)),
 r AS (SELECT 0 AS i, classes, chips, least(chips, 500 * chips / sum(chips) OVER ()) AS x FROM z
  UNION ALL SELECT i + 1, classes, chips, least(chips, 500 * y / sum(y) OVER ()) FROM (SELECT r.i, r.classes, any_value(r.chips) AS chips, any_value(r.x) * product(pow(ratio, m.share)) AS y FROM r JOIN m ON r.classes = m.classes
   JOIN (SELECT m.class, CASE WHEN sum(x * share) > 0 THEN any_value(target) * (SELECT sum(x) FROM r) / sum(x * share) ELSE 1 END AS ratio FROM r JOIN m ON r.classes = m.classes JOIN t ON m.class = t.class GROUP BY m.class) q ON m.class = q.class WHERE r.i < 20 GROUP BY r.i, r.classes))
 SELECT classes, chips, x AS expected FROM r WHERE i = 20"""


@book.add(sql(RAKED, "landcover", recursive=True), ["expected"])
def m6_raked_quotas(spark, d):
    """Chips of 3 x 3 cells: samples of each combination of classes after twenty rounds towards the classes' target shares."""
    chip = (F.col("year") * 1000000 + F.floor(F.col("row") / 3) * 1000 + F.floor(F.col("col") / 3)).alias("chip_id")
    shares = sampling.class_shares(fx.landcover(spark, d).select(chip, "class"))
    quotas, _ = raking.raked(shares, fx.SHARES, 500, 20)
    return quotas.select(F.array_join("classes", "-").alias("classes"), "chips", "expected")


@book.add(sql("SELECT chip_id, CASE WHEN chip_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM chips UNION ALL SELECT chip_id + 1000000, label FROM chips WHERE chip_id % 50 = 0", "chips"))
def sk9_sk10_replaced_version(spark, d):
    """A version, then one with changed and new chips that rewrites the buckets it touches; the old one goes."""
    root, c = _fresh(spark), fx.chips(spark, d).select("chip_id", F.col("label").cast("long").alias("label"))
    versions.replace(c, root, ["chip_id"], 8)
    changed = c.where("chip_id % 3 = 0").withColumn("label", F.col("label") + 100)
    versions.upsert(changed.unionByName(c.where("chip_id % 50 = 0").withColumn("chip_id", F.col("chip_id") + 1000000)), root)
    versions.drop_old(spark, root)
    return versions.read(spark, root)


@book.add(sql("SELECT year, row, col, class FROM landcover WHERE row >= 8 AND row < 24 AND col >= 10 AND col < 30 AND year >= 1996 AND year < 1998", "landcover"))
def sk1_sc7_clustered_window(spark, d):
    """The grid along a Morton curve; a window and two years of it from the files that the zone map names."""
    path, grid = _fresh(spark), fx.landcover(spark, d)
    clustered.write_clustered(grid, path, 16, 8)
    return clustered.read_window(spark, path, grid.schema, (8, 24), (10, 30), (1996, 1998)).select("year", "row", "col", "class")


@book.add(sql("SELECT count(*) AS files, sum((p IN ('grid'))::INT)::BIGINT AS grids FROM (SELECT 'grid' AS p FROM (SELECT DISTINCT y FROM li))", "li"))
def sc1_list_files(spark, d):
    path = _fresh(spark)
    years = fx.landcover(spark, d).select("year").distinct()
    years.repartition(1).withColumn("part", F.concat(F.lit("y"), F.col("year"))).write.partitionBy("part").parquet(path)
    files = scans.list_files(spark, path, "*.parquet")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum((F.regexp_count(F.col("path"), F.lit("part=y")) > 0).cast("long")).alias("grids"))


@book.add(sql("SELECT image_id, tile FROM arrivals", "arrivals"))
def st1_incremental(spark, d):
    """Newer arrivals first, then, after a restart, the older half with repeats of the first; each image is processed once."""
    src, out, mark = _fresh(spark), _fresh(spark), _fresh(spark)
    a = fx.arrivals(spark, d)
    step = lambda b: b.select("image_id", "tile")
    middle = a.agg(F.timestamp_seconds((F.min(F.unix_seconds("ts")) + F.max(F.unix_seconds("ts"))) / 2)).first()[0]
    for part in (a.where(F.col("ts") >= middle), a.where((F.col("ts") < middle) | (F.col("image_id") % 10 == 0))):
        part.write.mode("append").parquet(src)
        incremental.process(incremental.arriving(spark, src, a.schema), step, out, mark).awaitTermination()
    return spark.read.parquet(out).select("image_id", "tile")


@book.add(sql("SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01')::VARCHAR AS start, tile, count(*) AS scenes FROM arrivals GROUP BY ALL", "arrivals"))
def st2_time_windows(spark, d):
    w = incremental.windows(fx.arrivals(spark, d))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tile", "scenes")
