"""Land-cover tables derived by Spark from the driver's tables; every row follows from theirs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = tuple(range(1995, 2002))
#: Land-cover class codes.
CLASSES = (3, 6, 9, 12, 15, 18, 24, 30, 33)
#: Share of each class in the sample; they add up to more than one.
SHARES = {3: 0.60, 9: 0.10, 12: 0.05, 15: 0.26, 18: 0.10, 24: 0.05, 30: 0.05, 33: 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_size(spark: SparkSession, sf_dir: str) -> int:
    return math.isqrt(table(spark, sf_dir, "lineitem").count() // 6)


def _cell(g: int):
    return (F.col("l_orderkey") % g).cast("int").alias("row"), (F.col("l_partkey") % g).cast("int").alias("col")


def cells(spark: SparkSession, g: int) -> DataFrame:
    return spark.range(g * g).select(F.floor(F.col("id") / g).cast("int").alias("row"), (F.col("id") % g).cast("int").alias("col"))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, row, col`` of forest pixels: a base that all order lines of a cell decide, cleared and regrown by events."""
    g = grid_size(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    base = lines.groupBy(*_cell(g)).agg((F.sum(F.col("l_orderkey") + F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100 < 35).cast("int").alias("base"))
    events = lines.where("l_quantity > 48 and l_returnflag in ('A', 'R')")
    events = events.groupBy(*_cell(g), F.year("l_shipdate").alias("y")).agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("state"))
    history = events.groupBy("row", "col").agg(F.collect_list(F.struct("y", "state")).alias("h"))
    full = base.join(history, ["row", "col"], "left").withColumn("year", F.explode(F.array(*[F.lit(y) for y in YEARS])))
    last = F.array_max(F.filter("h", lambda e: e["y"] <= F.col("year")))["state"]
    return full.where(F.coalesce(last, F.col("base")) == 1).select("year", "row", "col")


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, row, col, class``, one class a cell and year."""
    g = grid_size(spark, sf_dir)
    code = F.get(F.array(*[F.lit(c) for c in CLASSES]), ((F.col("l_orderkey") + F.col("l_partkey")) % len(CLASSES)).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), *_cell(g)).agg(F.max(code).alias("class"))


def _scene():
    return ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) * 5 + F.col("l_suppkey") % 5).cast("long").alias("scene_id")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, acq_date, tile, cloud_pct``."""
    rows = table(spark, sf_dir, "lineitem").select(_scene(), F.trunc("l_shipdate", "month").alias("acq_date"), (F.col("l_suppkey") % 5).cast("int").alias("tile")).distinct()
    return rows.withColumn("cloud_pct", ((F.col("scene_id") * 37) % 101).cast("int"))


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, row, col``, six bands and ``qa``; the largest value of each where rows meet."""
    g = grid_size(spark, sf_dir)
    bands = {
        "blue": F.col("l_tax").cast("double") * 1000, "green": F.col("l_discount").cast("double") * 1000, "red": F.col("l_quantity").cast("double") * 20,
        "nir": F.col("l_extendedprice").cast("double") / 50, "swir1": (F.col("l_partkey") % 50 * 20).cast("double"), "swir2": (F.col("l_suppkey") % 50 * 20).cast("double"), "qa": (F.col("l_partkey") % 64).cast("int"),
    }
    return table(spark, sf_dir, "lineitem").groupBy(_scene(), *_cell(g)).agg(*[F.max(v).alias(k) for k, v in bands.items()])


def cloud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, row, col, cs`` between 0 and 1."""
    return scene_pixels(spark, sf_dir).select("scene_id", "row", "col", (((F.col("row") * 31 + F.col("col") * 17 + F.col("scene_id") * 13) % 100) / 100).alias("cs"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chip_id, data, label`` with 64 values a chip."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chip_id"), F.col("embedding").cast("array<double>").alias("data"), "label")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chip_id, pixel, y_true, y_pred`` of every chip value."""
    rows = chips(spark, sf_dir).select("chip_id", F.posexplode("data").alias("pixel", "v"), (F.col("label") % 2).cast("double").alias("y_true"))
    return rows.select("chip_id", "pixel", "y_true", F.least(F.greatest(F.col("v") + 0.5, F.lit(0.0)), F.lit(1.0)).alias("y_pred"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grid_name`` and box of each map sheet: nations as unit squares five to a row."""
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("grid_name"), x.alias("minx"), y.alias("miny"), (x + 1).alias("maxx"), (y + 1).alias("maxy"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, category, x, y`` of sample points."""
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("category"), ((k * 37 % 500) / 100).alias("x"), ((k * 91 % 500) / 100).alias("y"))


#: Rings by shape, in quarters of a parcel's reach: a star and an octagon, each with a hole in the middle.
SHAPES = {
    0: [[(4, 0), (1, 1), (0, 4), (-1, 1), (-4, 0), (-1, -1), (0, -4), (1, -1)], [(0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5)]],
    1: [[(4, -2), (4, 2), (2, 4), (-2, 4), (-4, 2), (-4, -2), (-2, -4), (2, -4)], [(2, 2), (-2, 2), (-2, -2), (2, -2)]],
}


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, owner, rings``: a polygon of up to a third of the grid for each supplier, in pixels; even ones have a hole."""
    g, k = grid_size(spark, sf_dir), F.col("s_suppkey").cast("long")
    x, y = (k * 37 % (2 * g)) / 2, (k * 91 % (2 * g)) / 2
    reach = F.when(k % 50 == 0, F.lit(float(g // 3))).otherwise((2 + k % 9).cast("double"))
    ring = lambda vertices: F.array(*[F.struct((x + reach * dx / 4).alias("x"), (y + reach * dy / 4).alias("y")) for dx, dy in vertices])
    shape = lambda n: F.when(k % 2 == 0, F.array(*[ring(r) for r in SHAPES[n]])).otherwise(F.array(ring(SHAPES[n][0])))
    return table(spark, sf_dir, "supplier").select(k.alias("feature"), F.col("s_nationkey").cast("int").alias("owner"), F.when(k % 3 == 0, shape(0)).otherwise(shape(1)).alias("rings"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, ts, tile`` of arriving scenes."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("image_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 12).cast("int").alias("tile"))


#: The same tables in SQL, by name; each may use those before it.
SQL = {
    "g": "SELECT floor(sqrt((SELECT count(*) FROM lineitem) // 6))::BIGINT AS g",
    "li": "SELECT *, (l_orderkey % g)::INT AS row, (l_partkey % g)::INT AS col, year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS mon FROM lineitem, g",
    "cells": "SELECT a.r::INT AS row, b.r::INT AS col FROM g, range(g) a(r), range(g) b(r)",
    "ev": "SELECT row, col, y, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS state FROM li WHERE l_quantity > 48 AND l_returnflag IN ('A', 'R') GROUP BY ALL",
    "base": "SELECT row, col, CASE WHEN sum(l_orderkey + l_partkey * 7 + l_suppkey) % 100 < 35 THEN 1 ELSE 0 END AS base FROM li GROUP BY ALL",
    "forest": """SELECT year, row, col FROM (SELECT yr.r::INT AS year, b.row, b.col, any_value(b.base) AS base, arg_max(ev.state, ev.y) AS last
        FROM base b CROSS JOIN range(1995, 2002) yr(r) LEFT JOIN ev ON ev.row = b.row AND ev.col = b.col AND ev.y <= yr.r GROUP BY yr.r, b.row, b.col)
        WHERE coalesce(last, base) = 1""",
    "landcover": "SELECT y AS year, row, col, max([3, 6, 9, 12, 15, 18, 24, 30, 33][((l_orderkey + l_partkey) % 9 + 1)::INT]) AS class FROM li GROUP BY ALL",
    "scenes": "SELECT *, (scene_id * 37 % 101)::INT AS cloud_pct FROM (SELECT DISTINCT ((y * 12 + mon) * 5 + l_suppkey % 5)::BIGINT AS scene_id, date_trunc('month', l_shipdate)::DATE AS acq_date, (l_suppkey % 5)::INT AS tile FROM li)",
    "scene_pixels": """SELECT ((y * 12 + mon) * 5 + l_suppkey % 5)::BIGINT AS scene_id, row, col, max(l_tax::DOUBLE * 1000) AS blue, max(l_discount::DOUBLE * 1000) AS green, max(l_quantity::DOUBLE * 20) AS red,
        max(l_extendedprice::DOUBLE / 50) AS nir, max((l_partkey % 50 * 20)::DOUBLE) AS swir1, max((l_suppkey % 50 * 20)::DOUBLE) AS swir2, max((l_partkey % 64)::INT) AS qa FROM li GROUP BY ALL""",
    "cloud_score": "SELECT scene_id, row, col, ((row * 31 + col * 17 + scene_id * 13) % 100) / 100.0::DOUBLE AS cs FROM scene_pixels",
    "chips": "SELECT vec_id AS chip_id, embedding::DOUBLE[] AS data, label FROM embeddings",
    "scores": "SELECT chip_id, i::INT AS pixel, (label % 2)::DOUBLE AS y_true, least(greatest(data[i + 1] + 0.5, 0), 1) AS y_pred FROM chips, range(64) r(i)",
    "sheets": "SELECT n_name AS grid_name, (n_nationkey % 5)::DOUBLE AS minx, (n_nationkey // 5)::DOUBLE AS miny, (n_nationkey % 5 + 1)::DOUBLE AS maxx, (n_nationkey // 5 + 1)::DOUBLE AS maxy FROM nation",
    "points": "SELECT c_custkey::BIGINT AS id, c_mktsegment AS category, (c_custkey::BIGINT * 37 % 500) / 100.0::DOUBLE AS x, (c_custkey::BIGINT * 91 % 500) / 100.0::DOUBLE AS y FROM customer",
    "vertices": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {h}, {i}, {len(ring)}, {dx}, {dy})" for n, rings in SHAPES.items() for h, ring in enumerate(rings) for i, (dx, dy) in enumerate(ring)) + ") v(shape, hole, i, size, dx, dy)",
    "parcel_edges": """SELECT k AS feature, owner, x + reach * a.dx::DOUBLE / 4 AS px, y + reach * a.dy::DOUBLE / 4 AS py, x + reach * b.dx::DOUBLE / 4 AS qx, y + reach * b.dy::DOUBLE / 4 AS qy
        FROM (SELECT s_suppkey::BIGINT AS k, s_nationkey::INT AS owner, (s_suppkey::BIGINT * 37 % (2 * g)) / 2.0::DOUBLE AS x, (s_suppkey::BIGINT * 91 % (2 * g)) / 2.0::DOUBLE AS y,
          CASE WHEN s_suppkey % 50 = 0 THEN (g // 3)::DOUBLE ELSE (2 + s_suppkey % 9)::DOUBLE END AS reach FROM supplier, g)
        JOIN vertices a ON a.shape = CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AND (a.hole = 0 OR k % 2 = 0) JOIN vertices b ON b.shape = a.shape AND b.hole = a.hole AND b.i = (a.i + 1) % a.size""",
    "parcel_up": "SELECT feature, owner, CASE WHEN up THEN px ELSE qx END AS x0, CASE WHEN up THEN py ELSE qy END AS y0, CASE WHEN up THEN qx ELSE px END AS x1, CASE WHEN up THEN qy ELSE py END AS y1 FROM (SELECT *, py < qy OR (py = qy AND px <= qx) AS up FROM parcel_edges)",
    "parcel_cells": """SELECT feature, owner, row, col FROM (SELECT feature, any_value(owner) AS owner, row, col, count(*) AS n FROM parcel_up JOIN cells ON y0 <= row + 0.5 AND row + 0.5 < y1 AND x0 + (row + 0.5 - y0) * (x1 - x0) / (y1 - y0) <= col + 0.5
        WHERE y0 < y1 GROUP BY feature, row, col) WHERE n % 2 = 1""",
    "arrivals": "SELECT event_id::BIGINT AS image_id, ts, (user_id % 12)::INT AS tile FROM events",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` under the definitions of ``names`` and of what they use."""
    needs = {"li": ["g"], "cells": ["g"], "parcel_edges": ["g", "vertices"], "parcel_up": ["parcel_edges"], "parcel_cells": ["parcel_up", "cells"], "ev": ["li"], "base": ["li"], "forest": ["base", "ev"], "landcover": ["li"], "scenes": ["li"], "scene_pixels": ["li"], "cloud_score": ["scene_pixels"], "scores": ["chips"]}
    wanted: set[str] = set()

    def add(n: str) -> None:
        for m in needs.get(n, []):
            add(m)
        wanted.add(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({q})" for n, q in SQL.items() if n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{', ' if body.lstrip().startswith('+') else ''}{body.lstrip().removeprefix('+')}"
