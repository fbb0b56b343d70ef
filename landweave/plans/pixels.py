"""Queries of scans, band functions, names, dates and georeferences (SC, P, X, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from landweave.functions import arrays, bands, geo, metres
from landweave.operators import composite, neighborhood, overlay
from landweave.plans.book import Book
from landweave.sources import fixtures as fx
from landweave.sources import scans
from landweave.sources.fixtures import sql

book = Book()
B = list(bands.BANDS)
KEYS = ["scene_id", "row", "col"]
FRACTIONS = ["gv", "npv", "soil", "cloud"]


def _unmix_sql(source: str = "scene_pixels") -> str:
    parts = ", ".join("greatest(" + " + ".join(f"{b} / 1000 * ({w!r})" for b, w in zip(B, ws)) + f", 0) AS {n}" for n, ws in bands.unmixing_matrix().items())
    return f"SELECT *, {parts} FROM {source}"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


SHADE = "abs(gv + npv + soil - 1)"
GVS = _ratio("gv", "gv + npv + soil")
NDFI = _ratio("gvs - (npv + soil)", "gvs + npv + soil")
FRAC = f"+fr AS ({_unmix_sql()}), ix AS (SELECT *, {NDFI} AS ndfi FROM (SELECT *, {GVS} AS gvs, {SHADE} AS shade FROM fr))"


def _indices(spark, d):
    return bands.unmix(fx.scene_pixels(spark, d)).withColumn("shade", bands.shade()).withColumn("gvs", bands.gvs()).withColumn("ndfi", bands.ndfi())


@book.add(sql("SELECT row, col FROM forest WHERE year = 2001", "forest"))
def sc2_grid_year(spark, d):
    return scans.scan_year(fx.forest(spark, d), 2001).select("row", "col")


@book.add(sql("SELECT scene_id, acq_date, tile, cloud_pct FROM scenes WHERE acq_date >= DATE '1995-01-01' AND acq_date < DATE '1997-01-01' AND cloud_pct <= 30", "scenes"))
def sc3_f1_f2_scene_scan(spark, d):
    s = scans.scan_scenes(fx.scenes(spark, d), "1995-01-01", "1997-01-01", 30)
    return s.withColumn("acq_date", F.col("acq_date").cast("date"))


@book.add(sql("SELECT id, category, x, y FROM points WHERE category IN ('BUILDING', 'MACHINERY')", "points"), ["x", "y"])
def sc4_f4_features(spark, d):
    return scans.scan_features(fx.points(spark, d), category=["BUILDING", "MACHINERY"])


@book.add(sql("SELECT chip_id, label FROM chips WHERE data IS NOT NULL AND len(data) = 64", "chips"))
def sc5_f6_f10_complete_chips(spark, d):
    return scans.complete_chips(fx.chips(spark, d), 64).select("chip_id", "label")


@book.add(sql("SELECT chip_id, list_sum([x FOR x, i IN data IF i % 4 <> 0]) AS features, list_sum([x FOR x, i IN data IF i % 4 = 0]) AS label_sum FROM chips", "chips"), ["features", "label_sum"])
def sc6_a7_split_label(spark, d):
    x, y = arrays.split_label(F.col("data"), 4, 4, 4)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return fx.chips(spark, d).select("chip_id", add(x).alias("features"), add(y).alias("label_sum"))


@book.add(sql("SELECT scene_id, row, col, concat_ws('|', blue::BIGINT, green::BIGINT, red::BIGINT) AS bands FROM scene_pixels", "scene_pixels"))
def sc8_band_array(spark, d):
    a = scans.band_array(["blue", "green", "red"])
    whole = F.transform(a, lambda x: F.bround(x).cast("long").cast("string"))
    return fx.scene_pixels(spark, d).select(*KEYS, F.array_join(whole, "|").alias("bands"))


@book.add(sql("SELECT string_agg(scene_id, ',' ORDER BY scene_id) AS scene_ids, string_agg(tile, ',' ORDER BY scene_id) AS tiles FROM scenes", "scenes"))
def sc9_property_list(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    listed = scans.property_list(fx.scenes(spark, d), ["scene_id", "tile"], "scene_id")
    return listed.select(text("scene_id").alias("scene_ids"), text("tile").alias("tiles"))


@book.add(sql("SELECT year, row, sum(pow(6371008.8 * radians(0.00027), 2) * cos(radians(-5.0 - row * 0.00027)) / 10000) AS area_ha FROM landcover GROUP BY year, row", "landcover"), ["area_ha"])
def sc10_pixel_area(spark, d):
    area = geo.pixel_area_ha(-5.0 - F.col("row") * 0.00027, 0.00027)
    return fx.landcover(spark, d).groupBy("year", "row").agg(F.sum(area).alias("area_ha"))


@book.add(sql("SELECT id, 1 AS inside FROM points WHERE x >= 1 AND x < 3 AND y >= 0 AND y < 2", "points"))
def sc11_p32_region_constant(spark, d):
    inside = fx.points(spark, d).where("x >= 1 and x < 3 and y >= 0 and y < 2")
    return scans.constant(inside, 1, "inside").select("id", "inside")


@book.add(sql("SELECT scene_id, row, col, blue / 1000 AS b, nir / 1000 AS n FROM scene_pixels", "scene_pixels"), ["b", "n"])
def p1_p6_select_reflectance(spark, d):
    return bands.select_bands(bands.reflectance(fx.scene_pixels(spark, d)), {"blue": "b", "nir": "n"}, KEYS)


@book.add(sql("SELECT row, col, median(red) AS red_t1, median(nir) AS nir_t1 FROM scene_pixels GROUP BY row, col", "scene_pixels"), ["red_t1", "nir_t1"])
def p2_p3_g1_composite_bands(spark, d):
    m = composite.median(fx.scene_pixels(spark, d), ["red", "nir"])
    return bands.suffix_bands(bands.composite_bands(m, ["red", "nir"], ["row", "col"]), ["red", "nir"], "_t1")


@book.add(sql("SELECT chip_id, list_sum([x * (CASE (i - 1) % 4 WHEN 2 THEN 1 ELSE 10 END) FOR x, i IN data IF (i - 1) % 4 IN (0, 2)]) AS weighted FROM chips", "chips"), ["weighted"])
def p4_channel_subset(spark, d):
    some = arrays.gather_channels(F.col("data"), 4, 4, 4, [2, 0])
    weighted = F.aggregate(F.transform(some, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 10)), F.lit(0.0), lambda a, v: a + v)
    return fx.chips(spark, d).select("chip_id", weighted.alias("weighted"))


@book.add(sql("SELECT scene_id, row, col, blue * 0.0000275 + (-0.2) AS SR_B2, nir * 0.00341802 + 149.0 AS ST_B10 FROM scene_pixels", "scene_pixels"), ["SR_B2", "ST_B10"])
def p5_scale_factors(spark, d):
    return bands.scale_factors(bands.select_bands(fx.scene_pixels(spark, d), {"blue": "SR_B2", "nir": "ST_B10"}, KEYS))


@book.add(sql(FRAC + f" SELECT scene_id, row, col, gv, npv, soil, cloud, shade, trunc(shade) AS shade_byte FROM ix", "scene_pixels"), [*FRACTIONS, "shade"])
def p7_p8_fractions(spark, d):
    return _indices(spark, d).select(*KEYS, *FRACTIONS, "shade", bands.shade(byte=True).alias("shade_byte"))


@book.add(sql(FRAC + f" SELECT scene_id, row, col, gvs, ndfi, {_ratio('gv - shade', 'gv + shade')} AS csfi FROM ix", "scene_pixels"), ["gvs", "ndfi", "csfi"])
def p9_p10_fraction_indices(spark, d):
    return _indices(spark, d).select(*KEYS, "gvs", "ndfi", bands.csfi().alias("csfi"))


@book.add(sql(f"SELECT scene_id, row, col, {_ratio('nir - red', 'nir + red')} AS ndvi FROM scene_pixels", "scene_pixels"), ["ndvi"])
def p11_ndvi(spark, d):
    return fx.scene_pixels(spark, d).select(*KEYS, bands.normalized_difference("nir", "red").alias("ndvi"))


TWO = FRAC + """, tw AS (SELECT row, col, median(ndfi) FILTER (WHERE (scene_id // 5 - 1) // 12 < 1998) AS ndfi_t0, median(ndfi) FILTER (WHERE (scene_id // 5 - 1) // 12 >= 1998) AS ndfi_t1,
    median(cloud) FILTER (WHERE (scene_id // 5 - 1) // 12 >= 1998) AS cloud_t1 FROM ix GROUP BY row, col)"""


def _two_dates(spark, d):
    ix = _indices(spark, d).withColumn("y", F.floor((F.floor(F.col("scene_id") / 5) - 1) / 12))
    side = lambda w, s, cols: ix.where(w).groupBy("row", "col").agg(*[F.median(c).alias(f"{c}{s}") for c in cols])
    return side("y < 1998", "_t0", ["ndfi"]).join(side("y >= 1998", "_t1", ["ndfi", "cloud"]), ["row", "col"], "full_outer")


@book.add(sql(TWO + """ SELECT row, col, ndfi_t1 - ndfi_t0 AS diff, CASE WHEN ndfi_t0 > 0.60 AND ndfi_t1 IS NOT NULL THEN CASE WHEN d BETWEEN -0.095 AND 0.095 THEN 1 WHEN d BETWEEN -0.25 AND -0.095 THEN 2
    WHEN d <= -0.25 THEN 3 WHEN d >= 0.095 THEN 4 ELSE 0 END END AS change, CASE WHEN d IS NULL THEN NULL WHEN cloud_t1 > 0.05 THEN 0 WHEN d BETWEEN -0.25 AND -0.095 THEN 1 ELSE 0 END AS logging
    FROM (SELECT *, ndfi_t1 - ndfi_t0 AS d FROM tw)""", "scene_pixels"), ["diff"])
def p12_p13_p14_change_classes(spark, d):
    t = _two_dates(spark, d)
    diff = bands.date_difference("ndfi")
    return t.select("row", "col", diff.alias("diff"), bands.change_class(diff, F.col("ndfi_t0")).alias("change"), bands.logging_label(diff, F.col("cloud_t1")).alias("logging"))


REMAP = "CASE class WHEN 3 THEN 1 WHEN 9 THEN 2 WHEN 12 THEN 3 WHEN 15 THEN 4 WHEN 18 THEN 5 WHEN 24 THEN 6 WHEN 30 THEN 7 WHEN 33 THEN 8 ELSE 0 END"


@book.add(sql(f"SELECT year, row, col, {REMAP} AS label FROM landcover", "landcover"))
def p15_remap_classes(spark, d):
    return bands.remap(fx.landcover(spark, d), "class").select("year", "row", "col", "label")


@book.add(sql("SELECT year, row, col, class IN (3, 6) AS forest FROM landcover", "landcover"))
def p16_forest_mask(spark, d):
    return fx.landcover(spark, d).select("year", "row", "col", bands.is_class("class").alias("forest"))


@book.add(sql("SELECT chip_id, pixel, (y_pred >= 0.5)::INT AS half, (y_pred > 0.2)::INT AS over FROM scores", "scores"))
def p17_thresholds(spark, d):
    return fx.scores(spark, d).select("chip_id", "pixel", bands.at_least("y_pred", 0.5).alias("half"), bands.at_least("y_pred", 0.2, strict=True).alias("over"))


@book.add(sql("SELECT scene_id, row, col, CASE WHEN qa > 40 THEN 0 ELSE red END AS replaced, CASE WHEN cs >= 0.6 THEN red END AS masked, CASE WHEN green <> 0 THEN green END AS self_masked, coalesce(CASE WHEN cs >= 0.6 THEN red END, 1000) AS filled FROM scene_pixels JOIN cloud_score USING (scene_id, row, col)", "cloud_score"), ["replaced", "masked", "self_masked", "filled"])
def p18_p19_p20_masks(spark, d):
    p = overlay.attach_scores(fx.scene_pixels(spark, d), fx.cloud_score(spark, d))
    masked = bands.mask("red", F.col("cs") >= 0.6)
    return p.select(*KEYS, bands.overwrite("red", F.col("qa") > 40, 0.0).alias("replaced"), masked.alias("masked"), bands.self_mask("green").alias("self_masked"), bands.unmask(masked, 1000.0).alias("filled"))


DISC = ", ".join(f"({r}, {c})" for r in range(-2, 3) for c in range(-2, 3) if r * r + c * c <= 4)


@book.add(sql(f"+o(r, c) AS (VALUES {DISC}), hit AS (SELECT DISTINCT scene_id, row + r AS row, col + c AS col FROM scene_pixels, o WHERE qa & 8 <> 0) SELECT p.scene_id, p.row, p.col, (hit.row IS NOT NULL)::INT AS cloudy FROM scene_pixels p LEFT JOIN hit ON p.scene_id = hit.scene_id AND p.row = hit.row AND p.col = hit.col", "scene_pixels"))
def p21_n3_cloud_mask(spark, d):
    p = fx.scene_pixels(spark, d).select(*KEYS, F.when(bands.bit_set("qa", 3), 1).alias("cloudy"))
    return neighborhood.disc_max_at_pixels(p, "cloudy", 2, ["scene_id"]).select(*KEYS, F.coalesce("cloudy", F.lit(0)).alias("cloudy"))


@book.add(sql("SELECT scene_id, row, col, CASE qa % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE red END AS red FROM scene_pixels", "scene_pixels"), ["red"])
def p22_clean_nan(spark, d):
    odd = F.when(F.col("qa") % 5 == 0, F.lit(float("nan"))).when(F.col("qa") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("red"))
    return fx.scene_pixels(spark, d).select(*KEYS, bands.clean(odd).alias("red"))


@book.add(sql("SELECT chip_id, 1 - label % 2 AS flipped, concat_ws('', (label % 12 = 0)::INT, (label % 12 = 1)::INT, (label % 12 = 2)::INT, (label % 12 = 3)::INT, (label % 12 = 4)::INT) AS one_hot FROM chips", "chips"))
def p23_p24_label_coding(spark, d):
    hot = F.array_join(F.transform(bands.one_hot(F.col("label") % 12, 5), lambda x: x.cast("string")), "")
    return fx.chips(spark, d).select("chip_id", bands.flip_binary(F.col("label") % 2).alias("flipped"), hot.alias("one_hot"))


@book.add(sql("+v AS (SELECT chip_id, unnest(data) AS x, generate_subscripts(data, 1) - 1 AS i FROM chips), n AS (SELECT chip_id, i, CASE WHEN max(x) OVER w = min(x) OVER w THEN 0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END AS s FROM v WINDOW w AS (PARTITION BY chip_id, i % 4)) SELECT chip_id, sum(s * (i + 1)) AS checksum, max(s) AS top, min(s) AS low FROM n GROUP BY chip_id", "chips"), ["checksum", "top", "low"])
def p25_channel_normalise(spark, d):
    n = arrays.normalize_channels(F.col("data"), 4, 4, 4)
    c = fx.chips(spark, d).select("chip_id", n.alias("s"))
    return c.select("chip_id", F.aggregate(F.transform("s", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("checksum"), F.array_max("s").alias("top"), F.array_min("s").alias("low"))


@book.add(sql("SELECT chip_id, pixel, least(greatest(y_pred * 1.5, 0), 1) AS bright, trunc(y_pred * 100)::INT AS pct FROM scores", "scores"), ["bright"])
def p26_p28_brightness_percent(spark, d):
    return fx.scores(spark, d).select("chip_id", "pixel", bands.brightness("y_pred").alias("bright"), bands.percent("y_pred").alias("pct"))


@book.add(sql(f"SELECT p.scene_id, p.row, p.col, {_ratio('red - r0', 'r1 - r0')} AS red, {_ratio('nir - n0', 'n1 - n0')} AS nir FROM scene_pixels p JOIN (SELECT scene_id, min(red) r0, max(red) r1, min(nir) n0, max(nir) n1 FROM scene_pixels GROUP BY scene_id) m USING (scene_id)", "scene_pixels"), ["red", "nir"])
def p27_g3_region_normalise(spark, d):
    return composite.normalize_region(fx.scene_pixels(spark, d).select(*KEYS, "red", "nir"), ["red", "nir"], ["scene_id"])


@book.add(sql("SELECT chip_id, list_position(data, list_max(data)) - 1 AS best FROM chips", "chips"))
def p29_argmax(spark, d):
    return fx.chips(spark, d).select("chip_id", bands.arg_max("data").alias("best"))


@book.add(sql("SELECT scene_id, row, col, trunc(red)::INT AS red_int, red::FLOAT::DOUBLE AS red_float, CASE WHEN trunc(nir) BETWEEN -128 AND 127 THEN trunc(nir)::INT END AS nir_byte FROM scene_pixels", "scene_pixels"), ["red_float"])
def p30_casts(spark, d):
    p = fx.scene_pixels(spark, d)
    return p.select(*KEYS, F.col("red").cast("int").alias("red_int"), F.col("red").cast("float").cast("double").alias("red_float"), F.floor("nir").cast("int").try_cast("byte").cast("int").alias("nir_byte"))


@book.add(sql("SELECT p.scene_id, s.acq_date::VARCHAR AS acq_date, s.cloud_pct, count(*) AS n FROM scene_pixels p JOIN scenes s USING (scene_id) GROUP BY ALL", "scene_pixels", "scenes"))
def p31_carry_properties(spark, d):
    s = fx.scenes(spark, d)
    n = fx.scene_pixels(spark, d).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(s, "scene_id").select("scene_id", F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"), "cloud_pct", "n")


@book.add(sql("SELECT DISTINCT 'chunk_' || year || '_' || row // 60 * 60 || '_' || col // 60 * 60 || '.tif' AS name, year, (row // 60 * 60)::INT AS row0, (col // 60 * 60)::INT AS col0 FROM landcover", "landcover"))
def x1_x2_x3_tile_names(spark, d):
    o = lambda c: F.floor(F.col(c) / 60) * 60
    path = F.concat(F.lit("/out/"), geo.tile_name("chunk", F.col("year"), o("row"), o("col")), F.lit(".tif"))
    t = fx.landcover(spark, d).select(path.alias("path")).distinct()
    p = geo.tile_name_parts(F.col("path"))
    return t.select(F.concat(geo.base_name(F.col("path")), F.lit(".tif")).alias("name"), p["year"].alias("year"), p["row"].alias("row0"), p["col"].alias("col0"))


@book.add(sql("SELECT scene_id, make_date(year(acq_date) - 1, 5, 1)::VARCHAR AS s0, make_date(year(acq_date) - 1, 7, 30)::VARCHAR AS s1, date_trunc('month', acq_date)::DATE::VARCHAR AS m0, (date_trunc('month', acq_date) + INTERVAL 1 MONTH)::DATE::VARCHAR AS m1, (year(acq_date) + CASE WHEN month(acq_date) >= 8 THEN 1 ELSE 0 END)::INT AS label_year, month(acq_date)::INT AS mon FROM scenes", "scenes"))
def x4_x5_x6_x7_calendar(spark, d):
    y, m = F.year("acq_date"), F.month("acq_date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    (a, b), (e, f) = geo.season(y), geo.month_window(y, m)
    return fx.scenes(spark, d).select("scene_id", text(a).alias("s0"), text(b).alias("s1"), text(e).alias("m0"), text(f).alias("m1"), geo.analysis_year(F.col("acq_date")).alias("label_year"), m.alias("mon"))


@book.add(sql("SELECT year, row, col, class, 30.0 * col + 1000 AS x, -30.0 * row + 5000 AS y, 1000 + 30.0 * (col // 60 * 60) AS tile_c, 5000 - 30.0 * (row // 60 * 60) AS tile_f FROM landcover", "landcover"), ["x", "y", "tile_c", "tile_f"])
def x8_x11_affine(spark, d):
    c = fx.landcover(spark, d)
    one = [F.lit(v) for v in (30.0, 1000.0, -30.0, 5000.0)]
    x, y = geo.pixel_to_map(*one, F.col("row"), F.col("col"))
    t = geo.tile_transform(*one, F.floor(F.col("row") / 60) * 60, F.floor(F.col("col") / 60) * 60)
    return c.select("year", "row", "col", "class", x.alias("x"), y.alias("y"), t["c"].alias("tile_c"), t["f"].alias("tile_f"))


@book.add(sql("+s AS (SELECT x, y, lead(x) OVER (ORDER BY x) - x AS dx FROM (SELECT DISTINCT x, 0 AS y FROM points)), t AS (SELECT lead(y) OVER (ORDER BY y) - y AS dy FROM (SELECT DISTINCT y FROM points)) SELECT (SELECT min(dx) FROM s) AS a, (SELECT min(x) FROM points) AS c, -(SELECT min(dy) FROM t) AS e, (SELECT max(y) FROM points) AS f", "points"), ["a", "c", "e", "f"])
def x9_affine_of_coordinates(spark, d):
    return geo.affine_of(fx.points(spark, d))


@book.add(sql("SELECT id, x - 2.5 AS c, y + 2.5 AS f, x - 1.5 AS minx, y - 1.5 AS miny, x + 1.5 AS maxx, y + 1.5 AS maxy FROM points", "points"), ["c", "f", "minx", "miny", "maxx", "maxy"])
def x10_x13_chip_origin_box(spark, d):
    c, f = geo.chip_origin(F.col("x"), F.col("y"), 0.01, 500)
    return fx.points(spark, d).select("id", c.alias("c"), f.alias("f"), geo.box(F.col("x"), F.col("y"), 1.5).alias("b")).select("id", "c", "f", "b.*")


def _project_sql(source: str, keep: str) -> str:
    """``keep, mx, my`` of ``source``, which has lon, lat, zone and south: the series written out."""
    sigma = f"sinh({metres.ECCENTRIC!r} * atanh({metres.ECCENTRIC!r} * sin(radians(lat))))"
    t = f"tan(radians(lat)) * sqrt(1 + pow({sigma}, 2)) - {sigma} * sqrt(1 + pow(tan(radians(lat)), 2))"
    series = lambda f, g, cs, sign="+": " ".join(f"{sign} ({c!r}::DOUBLE) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(cs, 1))
    unit = f"{metres.SCALE * metres.ARC!r}::DOUBLE"
    return f"""SELECT {keep}, 500000 + {unit} * (eta {series("cos", "sinh", metres.PLANE)}) AS mx, CASE WHEN south THEN 10000000 ELSE 0 END + {unit} * (xi {series("sin", "cosh", metres.PLANE)}) AS my
        FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM (SELECT *, {t} AS t, radians(lon - (zone * 6 - 183)) AS dl FROM {source}))"""


def _unproject_sql(source: str, keep: str) -> str:
    """``keep, lon, lat`` of ``source``, which has zone, south, mx and my."""
    unit = f"{metres.SCALE * metres.ARC!r}::DOUBLE"
    series = lambda f, g: " ".join(f"- ({c!r}::DOUBLE) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(metres.SPHERE, 1))
    lat = " ".join(f"+ ({c!r}::DOUBLE) * sin({2 * j} * chi)" for j, c in enumerate(metres.LATITUDE, 1))
    return f"""SELECT {keep}, zone * 6 - 183 + degrees(atan2(sinh(b), cos(a))) AS lon, degrees(chi {lat}) AS lat FROM (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM (SELECT *, xi {series("sin", "cosh")} AS a, eta {series("cos", "sinh")} AS b
        FROM (SELECT *, (my - CASE WHEN south THEN 10000000 ELSE 0 END) / {unit} AS xi, (mx - 500000) / {unit} AS eta FROM {source})))"""


PLACES = "SELECT id, x - 58 AS lon, y - 2.5 AS lat, floor((x - 58 + 180) / 6)::INT + 1 AS zone, y - 2.5 < 0 AS south FROM points"
AROUND = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(dx, dy)"


def _places(spark, d):
    """Sample points on both sides of the equator, in two zones."""
    return fx.points(spark, d).select("id", (F.col("x") - 58).alias("lon"), (F.col("y") - 2.5).alias("lat"))


@book.add(sql(f"+p AS ({PLACES}), m AS ({_project_sql('p', 'id, zone, south')}) SELECT id, zone, south, round(mx, 3) AS x, round(my, 3) AS y FROM m", "points"), ["x", "y"])
def x13_metres(spark, d):
    """Eastings and northings to the millimetre."""
    return _places(spark, d).select("id", metres.project(F.col("lon"), F.col("lat")).alias("m")).select("id", "m.zone", "m.south", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@book.add(sql(f"+p AS ({PLACES}), m AS ({_project_sql('p', 'id, zone, south')}), c AS (SELECT id, zone, south, mx + 3840 * dx AS mx, my + 3840 * dy AS my FROM m, {AROUND}), u AS ({_unproject_sql('c', 'id')}) SELECT id, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM u GROUP BY id", "points"), ["minx", "miny", "maxx", "maxy"])
def x13_metre_canvas(spark, d):
    """Canvases of 256 pixels of 30 m around sample points, in degrees."""
    return metres.buffer_box(_places(spark, d), 256 * 30 / 2).select("id", "box.*")


LAND = "SELECT grid_name, minx - 58 AS minx, miny - 2.5 AS miny, maxx - 58 AS maxx, maxy - 2.5 AS maxy, floor(((minx + maxx) / 2 - 58 + 180) / 6)::INT + 1 AS zone, (miny + maxy) / 2 - 2.5 < 0 AS south FROM sheets"


@book.add(sql(f"+l AS ({LAND}), s AS (SELECT l.*, a.i * 5120.0::DOUBLE AS mx, b.j * 5120.0::DOUBLE AS my FROM l, range(-20, 220) a(i), range(-60, 2020) b(j) WHERE a.i * 5120 BETWEEN 0 AND 1000000 AND (b.j * 5120 BETWEEN 9700000 AND 10010000) = south AND b.j * 5120 < 10010000 AND (south OR b.j * 5120 < 300000)), u AS ({_unproject_sql('s', 'grid_name, zone, minx, miny, maxx, maxy, mx, my')}) SELECT grid_name, zone, mx AS x, my AS y, lon, lat FROM u WHERE lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy", "sheets"), ["x", "y", "lon", "lat"])
def n7_metre_seeds(spark, d):
    """Seeds every ten windows of 512 m in every map sheet."""
    boxes = fx.sheets(spark, d).select("grid_name", *[(F.col(c) - o).alias(c) for c, o in (("minx", 58), ("miny", 2.5), ("maxx", 58), ("maxy", 2.5))])
    return metres.metre_grid(boxes, 10 * 512.0, ["grid_name"])


@book.add(sql("SELECT grid_name, (minx + maxx + maxx) / 3 AS x, (miny + miny + maxy) / 3 AS y FROM sheets", "sheets"), ["x", "y"])
def x12_centroid(spark, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"))
    return fx.sheets(spark, d).select("grid_name", geo.centroid(ring).alias("p")).select("grid_name", "p.x", "p.y")


@book.add(sql("SELECT grid_name FROM sheets WHERE minx <= 2.5 AND maxx >= 1.2 AND miny <= 3.5 AND maxy >= 0.5", "sheets"))
def f3_sheet_bounds(spark, d):
    return fx.sheets(spark, d).where(scans.overlaps((1.2, 0.5, 2.5, 3.5))).select("grid_name")


@book.add(sql("SELECT scene_id, row, col, CASE WHEN cs >= 0.6 THEN red END AS red FROM scene_pixels JOIN cloud_score USING (scene_id, row, col)", "cloud_score"), ["red"])
def f9_j1_clear_sky(spark, d):
    p = overlay.attach_scores(fx.scene_pixels(spark, d), fx.cloud_score(spark, d))
    return overlay.mask_by_score(p, ["red"]).select(*KEYS, "red")


@book.add(sql("SELECT year, row, col, class FROM landcover WHERE row >= 5 AND row < 25 AND col >= 5 AND col < 25", "landcover"))
def f13_clip(spark, d):
    return scans.clip(fx.landcover(spark, d), (5, 25), (5, 25))
