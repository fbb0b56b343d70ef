"""Queries of joins, reductions, windows and neighbourhoods (J, G, W, N, L, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landweave.functions import bands
from landweave.operators import composite, metrics, neighborhood, overlay, polygons, ranking, sampling
from landweave.plans.book import Book
from landweave.sources import fixtures as fx
from landweave.sources import scans
from landweave.sources.fixtures import sql

book = Book()
KEYS = ["scene_id", "row", "col"]


@book.add(sql("SELECT a.year, a.row, a.col, a.class AS parent, b.class AS child FROM landcover a JOIN landcover b ON b.year = a.year + 1 AND a.row = b.row AND a.col = b.col", "landcover"))
def j2_next_year_overlay(spark, d):
    return overlay.next_year(fx.landcover(spark, d), "class")


@book.add(sql("SELECT a.row, a.col, max(a.red) AS red_t0, max(b.red) AS red_t1 FROM scene_pixels a JOIN scene_pixels b ON a.row = b.row AND a.col = b.col WHERE (a.scene_id // 5 - 1) // 12 = 1995 AND (b.scene_id // 5 - 1) // 12 = 1996 GROUP BY a.row, a.col", "scene_pixels"), ["red_t0", "red_t1"])
def j3_stack_dates(spark, d):
    p = fx.scene_pixels(spark, d)
    of = lambda y: p.where(F.floor((F.floor(F.col("scene_id") / 5) - 1) / 12) == y).groupBy("row", "col").agg(F.max("red").alias("red"))
    return overlay.stack_dates(of(1995), of(1996), ["red"])


@book.add(sql("SELECT scene_id, tile FROM scenes WHERE scene_id NOT IN (SELECT scene_id FROM scenes WHERE cloud_pct > 60)", "scenes"))
def j4_u3_not_done(spark, d):
    s = fx.scenes(spark, d)
    return overlay.not_done(s, s.where("cloud_pct > 60"), ["scene_id"]).select("scene_id", "tile")


@book.add(sql("SELECT s.grid_name FROM sheets s WHERE EXISTS (SELECT 1 FROM points p WHERE p.category = 'BUILDING' AND p.x - 0.01 <= s.maxx AND p.x + 0.01 >= s.minx AND p.y - 0.01 <= s.maxy AND p.y + 0.01 >= s.miny)", "sheets", "points"))
def j5_features_in_region(spark, d):
    r = fx.points(spark, d).where("category = 'BUILDING'").select((F.col("x") - 0.01).alias("minx"), (F.col("y") - 0.01).alias("miny"), (F.col("x") + 0.01).alias("maxx"), (F.col("y") + 0.01).alias("maxy"))
    return overlay.intersecting(fx.sheets(spark, d), r).select("grid_name")


@book.add(sql("SELECT s.scene_id, g.grid_name FROM scenes s, sheets g WHERE s.cloud_pct <= 20", "scenes", "sheets"))
def j6_f1_work_items(spark, d):
    return overlay.work_items(fx.scenes(spark, d).where("cloud_pct <= 20").select("scene_id"), fx.sheets(spark, d).select("grid_name"))


SEEDS = "SELECT (l_suppkey % 40)::INT AS seed_id, max(row)::INT AS seed_row, max(col)::INT AS seed_col FROM li GROUP BY 1"


def _seeds(spark, d):
    g = fx.grid_size(spark, d)
    k = fx.table(spark, d, "lineitem")
    return k.groupBy((F.col("l_suppkey") % 40).cast("int").alias("seed_id")).agg(F.max(F.col("l_orderkey") % g).cast("int").alias("seed_row"), F.max(F.col("l_partkey") % g).cast("int").alias("seed_col"))


@book.add(sql(f"+seeds AS ({SEEDS}) SELECT seed_id, year, row, col, class, (row - seed_row + 8)::INT AS chip_row, (col - seed_col + 8)::INT AS chip_col FROM landcover, seeds WHERE row BETWEEN seed_row - 8 AND seed_row + 7 AND col BETWEEN seed_col - 8 AND seed_col + 7", "landcover"))
def j8_sc7_window_pixels(spark, d):
    return overlay.window_pixels(fx.landcover(spark, d), _seeds(spark, d), 16).select("seed_id", "year", "row", "col", "class", "chip_row", "chip_col")


@book.add(sql("SELECT p.id, coalesce(s.grid_name, 'none') AS grid_name FROM points p LEFT JOIN sheets s ON p.x >= s.minx AND p.x < s.maxx AND p.y >= s.miny AND p.y < s.maxy", "points", "sheets"))
def j9_burn_features(spark, d):
    return overlay.points_in(fx.points(spark, d), fx.sheets(spark, d).withColumn("o", F.col("minx") + 5 * F.col("miny")), "grid_name", "o", "none").select("id", "grid_name")


@book.add(sql("SELECT scene_id, row, col, red FROM scene_pixels p WHERE EXISTS (SELECT 1 FROM landcover l WHERE l.row = p.row AND l.col = p.col AND l.class IN (3, 6))", "scene_pixels", "landcover"), ["red"])
def j10_mask_by_class(spark, d):
    return overlay.mask_by_class(fx.scene_pixels(spark, d).select(*KEYS, "red"), fx.landcover(spark, d), [3, 6])


QUOTA = "VALUES (3, 0.60), (9, 0.10), (12, 0.05), (15, 0.26), (18, 0.10), (24, 0.05), (30, 0.05), (33, 0.05)"


@book.add(sql(f"+q(class, share) AS ({QUOTA}) SELECT l.year, l.row, l.col, l.class, (q.share * 3000)::INT AS quota FROM landcover l JOIN q USING (class)", "landcover"))
def j12_class_quota(spark, d):
    return overlay.class_quota(fx.landcover(spark, d), sampling.quotas(spark, fx.SHARES)).select("year", "row", "col", "class", "quota")


@book.add(sql("SELECT a.tile, a.scene_id AS t1_scene, b.scene_id AS t0_scene FROM scenes a JOIN scenes b ON a.tile = b.tile AND b.acq_date >= make_date(year(a.acq_date) - 1, 5, 1) AND b.acq_date < make_date(year(a.acq_date) - 1, 7, 30)", "scenes"))
def j13_season_pairs(spark, d):
    return overlay.season_pairs(fx.scenes(spark, d)).select("tile", "t1_scene", "t0_scene")


@book.add(sql("+m AS (SELECT year(acq_date) AS y, month(acq_date) AS m, min(scene_id) AS map_id FROM scenes WHERE cloud_pct < 50 GROUP BY ALL) SELECT s.scene_id, m.map_id FROM scenes s LEFT JOIN m ON year(s.acq_date) = m.y AND month(s.acq_date) = m.m", "scenes"))
def j14_l1_first_basemap(spark, d):
    s = fx.scenes(spark, d).withColumn("year", F.year("acq_date")).withColumn("month", F.month("acq_date"))
    maps = s.where("cloud_pct < 50").select("year", "month", F.col("scene_id").alias("map_id"))
    return overlay.first_basemap(s, maps).select("scene_id", "map_id")


@book.add(sql("SELECT id, CASE WHEN x >= 2 AND x < 4 AND y >= 1 AND y < 3 THEN 0 WHEN x >= 0 AND x < 3 AND y >= 0 AND y < 2 THEN 1 ELSE (id % 2)::INT END AS label FROM points", "points"))
def j15_corrected_labels(spark, d):
    s = fx.sheets(spark, d)
    add, cut = s.where("minx < 3 and miny < 2"), s.where("minx >= 2 and minx < 4 and miny >= 1 and miny < 3")
    return overlay.corrected(fx.points(spark, d).withColumn("label", (F.col("id") % 2).cast("int")), add, cut).select("id", "label")


@book.add(sql("SELECT row, col, arg_min(owner, feature) AS owner FROM parcel_cells GROUP BY row, col", "parcel_cells"))
def j9_burn_polygons(spark, d):
    """Parcels, some of them with holes, burnt into the whole grid; the first by feature wins."""
    g = fx.grid_size(spark, d)
    return polygons.burn(fx.parcels(spark, d), polygons.Grid(rows=g, cols=g), "owner", "feature")


@book.add(sql("+p AS (SELECT row, col, arg_min(owner, feature) AS owner FROM parcel_cells GROUP BY row, col) SELECT year, row, col, class, coalesce(owner, -1) AS owner FROM landcover LEFT JOIN p USING (row, col)", "landcover", "parcel_cells"))
def j9_label_pixels(spark, d):
    return polygons.label_pixels(fx.landcover(spark, d), fx.parcels(spark, d), polygons.Grid(), "owner", "feature", -1).select("year", "row", "col", "class", "owner")


@book.add(sql("+p AS (SELECT row, col, bool_or(feature % 7 = 0) AS gone, bool_or(feature % 7 IN (1, 2)) AS more FROM parcel_cells GROUP BY row, col) SELECT year, row, col, CASE WHEN gone THEN 0 WHEN more THEN 1 ELSE (class = 3)::INT END AS label FROM landcover LEFT JOIN p USING (row, col)", "landcover", "parcel_cells"))
def j15_polygon_labels(spark, d):
    p, pixels = fx.parcels(spark, d), fx.landcover(spark, d).select("year", "row", "col", (F.col("class") == 3).cast("int").alias("label"))
    return polygons.corrected_labels(pixels, p.where("feature % 7 in (1, 2)"), p.where("feature % 7 = 0"), polygons.Grid())


@book.add(sql("SELECT year, row, col, class FROM landcover SEMI JOIN (SELECT DISTINCT row, col FROM parcel_cells WHERE feature % 5 = 0) p USING (row, col)", "landcover", "parcel_cells"))
def f13_clip_to_polygons(spark, d):
    """Whole quadtree cells where they lie inside, edges only where a border runs through."""
    x, y = polygons.Grid().centre()
    g = fx.grid_size(spark, d)
    return polygons.clip(fx.landcover(spark, d), fx.parcels(spark, d).where("feature % 5 = 0"), ["year", "row", "col"], 2.0, x, y, box=(0, 0, g, g))


@book.add(sql("SELECT row, col, feature, 1 AS inside FROM parcel_cells", "parcel_cells"))
def sc11_polygon_masks(spark, d):
    """The constant image of every parcel."""
    g = fx.grid_size(spark, d)
    inside = polygons.masks(fx.parcels(spark, d), polygons.Grid(rows=g, cols=g), ["feature"])
    return scans.constant(inside, 1, "inside").select("row", "col", "feature", "inside")


MEET = """+a AS (SELECT * FROM parcel_up WHERE feature % 4 <> 1), b AS (SELECT * FROM parcel_up WHERE feature % 4 = 1 AND owner < 12),
 crossed AS (SELECT DISTINCT a.feature FROM a JOIN b ON least(a.x0, a.x1) <= greatest(b.x0, b.x1) AND least(b.x0, b.x1) <= greatest(a.x0, a.x1) AND a.y0 <= b.y1 AND b.y0 <= a.y1
  AND sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * sign((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0
  AND sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * sign((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0),
 inside AS (SELECT p.feature FROM (SELECT DISTINCT feature, px, py FROM parcel_edges WHERE feature % 4 <> 1) p JOIN b ON b.y0 <= p.py AND p.py < b.y1 AND b.x0 + (p.py - b.y0) * (b.x1 - b.x0) / (b.y1 - b.y0) <= p.px GROUP BY p.feature, p.px, p.py, b.feature HAVING count(*) % 2 = 1),
 around AS (SELECT a.feature FROM (SELECT DISTINCT feature, px, py FROM parcel_edges WHERE feature % 4 = 1 AND owner < 12) p JOIN a ON a.y0 <= p.py AND p.py < a.y1 AND a.x0 + (p.py - a.y0) * (a.x1 - a.x0) / (a.y1 - a.y0) <= p.px GROUP BY a.feature, p.px, p.py, p.feature HAVING count(*) % 2 = 1)
 SELECT feature FROM crossed UNION SELECT feature FROM inside UNION SELECT feature FROM around"""


@book.add(sql(MEET, "parcel_edges", "parcel_up"))
def j5_polygons_in_region(spark, d):
    p = fx.parcels(spark, d)
    return polygons.intersecting(p.where("feature % 4 <> 1"), p.where("feature % 4 = 1 and owner < 12"), "feature", 4.0).select("feature")


@book.add(sql("SELECT row, col, sum(red) AS red, count(*) AS n FROM scene_pixels GROUP BY row, col", "scene_pixels"), ["red"])
def g2_pixel_sum(spark, d):
    return composite.total(fx.scene_pixels(spark, d).withColumn("n", F.lit(1).cast("long")), ["red", "n"])


@book.add(sql("SELECT quantile_cont(red, 0.03) AS red_p3, quantile_cont(red, 0.98) AS red_p98, quantile_cont(nir, 0.03) AS nir_p3, quantile_cont(nir, 0.98) AS nir_p98 FROM scene_pixels", "scene_pixels"), ["red_p3", "red_p98", "nir_p3", "nir_p98"])
def g4_region_percentiles(spark, d):
    return composite.region_percentiles(fx.scene_pixels(spark, d), ["red", "nir"])


@book.add(sql("SELECT (CASE WHEN v < 0 THEN 0 WHEN v >= 1 THEN 21 ELSE floor(v * 20) + 1 END)::INT AS bin, count(*) AS n FROM (SELECT red / 1000 AS v FROM scene_pixels) GROUP BY 1", "scene_pixels"))
def g10_histogram(spark, d):
    return composite.histogram(fx.scene_pixels(spark, d).withColumn("v", F.col("red") / 1000), "v", 0.0, 1.0, 20)


@book.add(sql("+q AS (SELECT class, quantile_cont(area, 0.25) AS q1, median(area) AS median, quantile_cont(area, 0.75) AS q3 FROM a GROUP BY class) SELECT q.*, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, (SELECT count(*) FROM a WHERE a.class = q.class AND (area < q1 - 1.5 * (q3 - q1) OR area > q3 + 1.5 * (q3 - q1))) AS outliers FROM q", "landcover").replace(", q AS (SELECT class", ", a AS (SELECT year, class, row // 10 AS ti, col // 10 AS tj, count(*)::DOUBLE AS area FROM landcover GROUP BY ALL), q AS (SELECT class"), ["q1", "median", "q3", "low", "high"])
def g11_box_plot(spark, d):
    a = fx.landcover(spark, d).groupBy("year", "class", F.floor(F.col("row") / 10).alias("ti"), F.floor(F.col("col") / 10).alias("tj")).agg(F.count(F.lit(1)).cast("double").alias("area"))
    return composite.box_plot(a, "area", ["class"])


@book.add(sql("+w AS (SELECT row // 10 AS ti, col // 10 AS tj, avg((class = 3)::INT) AS c3, avg((class = 9)::INT) AS c9, avg((class = 15)::INT) AS c15 FROM landcover GROUP BY ALL) SELECT 'c3' AS a, 'c9' AS b, corr(c3, c9) AS r FROM w UNION ALL SELECT 'c3', 'c15', corr(c3, c15) FROM w UNION ALL SELECT 'c9', 'c15', corr(c9, c15) FROM w", "landcover"), ["r"])
def g12_share_correlation(spark, d):
    chip = F.concat_ws("_", F.floor(F.col("row") / 10), F.floor(F.col("col") / 10)).alias("chip_id")
    shares = sampling.class_shares(fx.landcover(spark, d).select(chip, "class"))
    return composite.correlations(sampling.wide_shares(shares, [3, 9, 15]), ["c3", "c9", "c15"])


@book.add(sql("SELECT count(*) AS pixels, count(DISTINCT scene_id) AS scenes FROM scene_pixels", "scene_pixels"))
def g21_u2_dataset_size(spark, d):
    return fx.scene_pixels(spark, d).agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("scene_id").alias("scenes"))


@book.add(sql("SELECT row, col, arg_min(red, scene_id) AS first_red, arg_max(red, scene_id) AS last_red FROM scene_pixels WHERE red <> 20 GROUP BY row, col", "scene_pixels"), ["first_red", "last_red"])
def g22_u4_mosaic(spark, d):
    p = fx.scene_pixels(spark, d)
    a = composite.mosaic(p, "red", "scene_id", 20.0).withColumnRenamed("red", "first_red")
    return a.join(composite.mosaic(p, "red", "scene_id", 20.0, last=True).withColumnRenamed("red", "last_red"), ["row", "col"])


@book.add(sql("SELECT max(class) AS top_class, max(row // 60 * 60)::INT AS top_row, max(col // 60 * 60)::INT AS top_col, (max(row) + 1)::INT AS height, (max(col) + 1)::INT AS width FROM landcover", "landcover"))
def g7_mosaic_shape(spark, d):
    o = lambda c: (F.floor(F.col(c) / 60) * 60).cast("int")
    return fx.landcover(spark, d).agg(F.max("class").alias("top_class"), F.max(o("row")).alias("top_row"), F.max(o("col")).alias("top_col"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


@book.add(sql("SELECT l.year, l.row, l.col, p.class AS before FROM landcover l LEFT JOIN landcover p ON p.year = l.year - 1 AND p.row = l.row AND p.col = l.col", "landcover"))
def w5_previous_state(spark, d):
    l = fx.landcover(spark, d)
    before = l.select((F.col("year") + 1).alias("year"), "row", "col", F.col("class").alias("before"))
    return l.select("year", "row", "col").join(before, ["year", "row", "col"], "left")


@book.add(sql("SELECT scene_id, row_number() OVER (ORDER BY cloud_pct, scene_id) AS n FROM scenes", "scenes"))
def w2_number_rows(spark, d):
    return ranking.number_rows(fx.scenes(spark, d), ["cloud_pct", "scene_id"]).select("scene_id", "n")


LOG = "+log AS (SELECT l_suppkey % 5 AS run, year(l_shipdate) * 12 + month(l_shipdate) AS epoch, avg(l_discount)::DOUBLE AS val_loss FROM lineitem GROUP BY ALL), b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM log), i AS (SELECT *, bf IS NULL OR val_loss < bf AS improves FROM b)"


@book.add(sql(LOG + " SELECT run::BIGINT AS run, epoch::INT AS epoch, improves, n - max(CASE WHEN improves THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS since_best, n - max(CASE WHEN improves THEN n END) OVER (PARTITION BY run ORDER BY epoch) >= 10 AS stopped FROM i", "g"))
def w6_g26_best_so_far(spark, d):
    l = fx.table(spark, d, "lineitem")
    log = l.groupBy((F.col("l_suppkey") % 5).cast("long").alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch")).agg(F.avg("l_discount").cast("double").alias("val_loss"))
    return metrics.best_so_far(log, keys=["run"]).select("run", "epoch", "improves", F.col("since_best").cast("long").alias("since_best"), "stopped")


@book.add(sql("+hi AS (SELECT DISTINCT row, col FROM scene_pixels WHERE red > 960 AND nir > 1500), o AS (SELECT r::INT AS r FROM range(-20, 21) t(r)), w AS (SELECT DISTINCT row, (col + r)::INT AS col FROM hi, o WHERE col + r >= 0 AND col + r < (SELECT g FROM g)), v AS (SELECT DISTINCT (row + r)::INT AS row, col FROM w, o WHERE row + r >= 0 AND row + r < (SELECT g FROM g)) SELECT row, col, 1 AS high FROM v", "scene_pixels"))
def n1_focal_max_square(spark, d):
    g = fx.grid_size(spark, d)
    hi = fx.scene_pixels(spark, d).where("red > 960 and nir > 1500").select("row", "col", F.lit(1).alias("high")).distinct()
    return neighborhood.focal_max_square(hi, "high", 20, shape=(g, g))


@book.add(sql("+o(r) AS (VALUES (-1), (0), (1)) SELECT DISTINCT year, (row + a.r)::INT AS row, (col + b.r)::INT AS col FROM forest, o a, o b, g WHERE row + a.r >= 0 AND row + a.r < g AND col + b.r >= 0 AND col + b.r < g", "forest"))
def n2_dilation(spark, d):
    g = fx.grid_size(spark, d)
    return neighborhood.dilate(fx.forest(spark, d), ["year"], (g, g))


@book.add(sql("SELECT chip_id, pixel // 8 AS row, pixel % 8 AS col, y_pred, (SELECT max(y_pred) FROM scores b WHERE b.chip_id = a.chip_id AND b.pixel // 8 BETWEEN a.pixel // 8 - 3 AND a.pixel // 8 + 4 AND b.pixel % 8 BETWEEN a.pixel % 8 - 3 AND a.pixel % 8 + 4) AS local_max FROM scores a", "scores"), ["y_pred", "local_max"])
def n4_moving_max(spark, d):
    s = fx.scores(spark, d).select("chip_id", F.floor(F.col("pixel") / 8).cast("int").alias("row"), (F.col("pixel") % 8).alias("col"), "y_pred")
    return neighborhood.moving_max(s, "y_pred", 8, ["chip_id"])


@book.add(sql("+o AS (SELECT a.r::INT AS r, b.r::INT AS c FROM range(-5, 6) a(r), range(-5, 6) b(r) WHERE a.r * a.r + b.r * b.r <= 25), wt AS (SELECT year, row, col FROM landcover WHERE class = 33), s AS (SELECT year, (row + r)::INT AS row, (col + c)::INT AS col, min(sqrt(r * r + c * c)) AS distance FROM wt, o GROUP BY ALL) SELECT year, row, col, distance FROM s, g WHERE distance > 0 AND row >= 0 AND col >= 0 AND row < g AND col < g", "landcover"), ["distance"])
def n5_near_water(spark, d):
    g = fx.grid_size(spark, d)
    return neighborhood.near_but_not(fx.landcover(spark, d).where("class = 33"), 5, ["year"], (g, g))


@book.add(sql("SELECT grid_name, i * 0.25::DOUBLE AS x, j * 0.25::DOUBLE AS y FROM sheets, range(0, 20) a(i), range(0, 20) b(j) WHERE i * 0.25 >= minx AND i * 0.25 < maxx AND j * 0.25 >= miny AND j * 0.25 < maxy", "sheets"), ["x", "y"])
def n7_seed_grid(spark, d):
    return neighborhood.seed_grid(fx.sheets(spark, d), 0.25).select("grid_name", "x", "y")


@book.add(sql("+c AS (SELECT (row // 4)::INT AS row, (col // 4)::INT AS col, class, count(*) AS n FROM landcover GROUP BY ALL) SELECT row, col, arg_min(class, -n * 1000 + class) AS class FROM c GROUP BY row, col", "landcover"))
def n8_coarser_mode(spark, d):
    return composite.coarser(fx.landcover(spark, d), "class", 4)


@book.add(sql("SELECT year, (row // 5)::INT AS row, (col // 5)::INT AS col, arg_min(class, (pow(row % 5 - 2, 2) + pow(col % 5 - 2, 2)) * 1000000000 + row * 10000 + col) AS class FROM landcover GROUP BY ALL", "landcover"))
def n8_coarser_nearest(spark, d):
    return composite.coarser(fx.landcover(spark, d), "class", 5, "nearest", ["year"])


RATIO = """+o AS (SELECT year, 10 * row + 987 AS rl, 10 * col + 993 AS cl, class FROM landcover), t AS (SELECT year, class, r.r::INT - 27 AS row, c.c::INT - 27 AS col,
 (least(rl + 10, (r.r + 1) * 37) - greatest(rl, r.r * 37)) * (least(cl + 10, (c.c + 1) * 37) - greatest(cl, c.c * 37)) AS w FROM o, range(0, 400) r(r), range(0, 400) c(c) WHERE r.r BETWEEN rl // 37 AND (rl + 9) // 37 AND c.c BETWEEN cl // 37 AND (cl + 9) // 37)"""


@book.add(sql(RATIO + ", s AS (SELECT year, row, col, class, sum(w) AS w FROM t GROUP BY ALL) SELECT year, row, col, arg_min(class, -w * 1000 + class) AS class FROM s GROUP BY year, row, col", "landcover"))
def n8_regrid_ratio(spark, d):
    """Cells 3.7 pixels wide that begin 1.2 rows and 0.6 columns in, by the class of the largest area."""
    return composite.regrid(fx.landcover(spark, d), "class", "3.7", "mode", ["year"], ("1.2", "0.6"))


LEVELS = "".join(f", s{n} AS (SELECT year, row // 2 AS row, col // 2 AS col, class, count(*) AS n FROM {'landcover' if n == 1 else f'l{n - 1}'} GROUP BY ALL), l{n} AS (SELECT year, row, col, arg_min(class, -n * 1000 + class) AS class FROM s{n} GROUP BY year, row, col)" for n in (1, 2, 3, 4))


@book.add(sql("+" + LEVELS.removeprefix(", ") + " " + " UNION ALL ".join(f"SELECT {n}::INT AS level, year, row::INT AS row, col::INT AS col, class FROM l{n}" for n in (1, 2, 3, 4)), "landcover"))
def n8_overviews(spark, d):
    return composite.overviews(fx.landcover(spark, d), "class", 4, "mode", ["year"]).select("level", "year", "row", "col", "class")


@book.add(sql("+u AS (SELECT row, col, unnest(range(greatest(0, (row - 4 + 800) // 8 - 100), (row + 4) // 8 + 1)) AS ti, year FROM landcover), t AS (SELECT year, row, col, ti::INT AS ti, unnest(range(greatest(0, (col - 4 + 800) // 8 - 100), (col + 4) // 8 + 1))::INT AS tj FROM u) SELECT year, ti, tj, count(*) AS pixels, sum((ti = row // 8 AND tj = col // 8)::INT)::BIGINT AS core FROM t GROUP BY year, ti, tj", "landcover"))
def n9_overlapping_tiles(spark, d):
    t = neighborhood.overlapping_tiles(fx.landcover(spark, d), 16, 8)
    return t.groupBy("year", "ti", "tj").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("core").cast("int")).alias("core"))


@book.add(sql("SELECT scene_id, cloud_pct FROM scenes ORDER BY cloud_pct, scene_id OFFSET 5 LIMIT 3", "scenes"))
def l2_l3_skip_take(spark, d):
    return scans.skip_take(fx.scenes(spark, d), ["cloud_pct", "scene_id"], 5, 3).select("scene_id", "cloud_pct")


@book.add(sql("SELECT DISTINCT tile, cloud_pct // 10 AS decile FROM scenes", "scenes"))
def u2_distinct(spark, d):
    return fx.scenes(spark, d).select("tile", F.floor(F.col("cloud_pct") / 10).cast("int").alias("decile")).distinct()


FREQ = """+ix AS (SELECT row, col, sum((red > 500)::INT) AS freq FROM scene_pixels GROUP BY row, col), hi AS (SELECT row, col FROM ix WHERE freq > 3), o AS (SELECT r::INT AS r FROM range(-20, 21) t(r)),
 w AS (SELECT DISTINCT row, (col + r)::INT AS col FROM hi, o), v AS (SELECT DISTINCT (row + r)::INT AS row, col FROM w, o), f AS (SELECT DISTINCT row, col FROM landcover WHERE class = 3)
 SELECT p.scene_id, p.row, p.col, p.red FROM scene_pixels p SEMI JOIN v ON p.row = v.row AND p.col = v.col SEMI JOIN f ON p.row = f.row AND p.col = f.col WHERE p.red <> 0"""


@book.add(sql(FREQ, "scene_pixels", "landcover"), ["red"])
def e1_frequency_postprocessing(spark, d):
    """Predictions kept near pixels that are often detected, inside forest: G2, P17, N1, P18, J10, P19 together."""
    p = fx.scene_pixels(spark, d).select(*KEYS, "red")
    often = composite.total(p.withColumn("hit", bands.at_least("red", 500, strict=True)), "hit")
    near = neighborhood.focal_max_square(often.where("hit > 3").select("row", "col", F.lit(1).alias("near")), "near", 20)
    kept = p.join(near, ["row", "col"], "left").withColumn("red", bands.overwrite("red", F.coalesce("near", F.lit(0)) == 0, 0.0))
    kept = overlay.mask_by_class(kept, fx.landcover(spark, d), [3]).withColumn("red", bands.self_mask("red"))
    return kept.where(F.col("red").isNotNull()).select(*KEYS, "red")
