"""Joins of pixel tables, scenes, features and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.functions import geo
from landweave.sources.scans import first_per

#: Seeds, map sheets, quotas and polygons are broadcast up to this many rows, and shuffled beyond.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more rows than ``rows``, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach_scores(pixels: DataFrame, scores: DataFrame, keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """A score band by pixel; pixels without one keep null."""
    return pixels.join(scores, list(keys), "left")


def mask_by_score(df: DataFrame, bands: Sequence[str], score: str = "cs", least: float = 0.60) -> DataFrame:
    """bands are null where the clear-sky score is under a bound or missing."""
    return df.withColumns({b: F.when(F.col(score) >= least, F.col(b)) for b in bands})


def next_year(labels: DataFrame, value: str = "id") -> DataFrame:
    """``year, row, col, parent, child`` of pixels labelled in a year and in the next."""
    after = labels.select((F.col("year") - 1).alias("year"), "row", "col", F.col(value).alias("child"))
    return labels.select("year", "row", "col", F.col(value).alias("parent")).join(after, ["year", "row", "col"])


def stack_dates(earlier: DataFrame, later: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Bands of two dates side by side on the pixels that both have."""
    a = earlier.select(*keys, *[F.col(b).alias(f"{b}_t0") for b in bands])
    return a.join(later.select(*keys, *[F.col(b).alias(f"{b}_t1") for b in bands]), list(keys))


def not_done(items: DataFrame, done: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Items without a finished one of the same keys."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _covered(df: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that the box touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return df.withColumn("__cx", F.explode(span("minx", "maxx"))).withColumn("__cy", F.explode(span("miny", "maxy")))


def intersecting(features: DataFrame, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """Features whose box meets any region's box: an equi-join on coarse cells, then the exact test."""
    key = [c for c in features.columns]
    left = _covered(features.withColumn("__f", F.monotonically_increasing_id()), cell)
    right = _covered(regions.select("minx", "miny", "maxx", "maxy"), cell).select("__cx", "__cy", *[F.col(c).alias(f"__{c}") for c in ("minx", "miny", "maxx", "maxy")])
    meet = (F.col("minx") <= F.col("__maxx")) & (F.col("maxx") >= F.col("__minx")) & (F.col("miny") <= F.col("__maxy")) & (F.col("maxy") >= F.col("__miny"))
    on = (left["__cx"] == right["__cx"]) & (left["__cy"] == right["__cy"]) & meet
    return left.join(right, on, "left_semi").dropDuplicates(["__f"]).select(*key)


def points_in(points: DataFrame, regions: DataFrame, value: str, order: str, default=None, cell: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Each point with the value of the first region that holds it (edges: low in, high out), else ``default``."""
    right = _covered(regions, cell).select("__cx", "__cy", *[F.col(c).alias(f"__{c}") for c in ("minx", "miny", "maxx", "maxy")], F.col(value).alias("__v"), F.col(order).alias("__o"))
    left = points.withColumn("__p", F.monotonically_increasing_id()).withColumn("__cx", F.floor(F.col(x) / cell)).withColumn("__cy", F.floor(F.col(y) / cell))
    inside = (F.col(x) >= F.col("__minx")) & (F.col(x) < F.col("__maxx")) & (F.col(y) >= F.col("__miny")) & (F.col(y) < F.col("__maxy"))
    on = (left["__cx"] == right["__cx"]) & (left["__cy"] == right["__cy"]) & inside
    joined = left.join(right, on, "left").groupBy("__p", *points.columns).agg(F.min_by("__v", "__o").alias(value))
    return joined.drop("__p").withColumn(value, F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value))


def work_items(scenes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every scene with every seed."""
    return scenes.crossJoin(small(seeds))


def window_pixels(pixels: DataFrame, seeds: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """J8, SC7: pixels in the ``size`` x ``size`` window centred on each seed (``seed_id, seed_row, seed_col``).

    Pixels belong to one cell of the window's size, and a window touches four at most, so the join is on
    cells. ``keys`` are further columns that both sides share.
    """
    half = size // 2
    top, left = F.col("seed_row") - half, F.col("seed_col") - half
    near = seeds.withColumn("__ti", F.explode(F.sequence(F.floor(top / size), F.floor((top + size - 1) / size)))).withColumn("__tj", F.explode(F.sequence(F.floor(left / size), F.floor((left + size - 1) / size))))
    cells = pixels.withColumn("__ti", F.floor(F.col("row") / size)).withColumn("__tj", F.floor(F.col("col") / size))
    inside = cells.join(small(near), [*keys, "__ti", "__tj"]).where(F.col("row").between(top, top + size - 1) & F.col("col").between(left, left + size - 1))
    return inside.withColumn("chip_row", (F.col("row") - top).cast("int")).withColumn("chip_col", (F.col("col") - left).cast("int")).drop("__ti", "__tj")


def mask_by_class(pixels: DataFrame, classes: DataFrame, codes: Sequence[int], keys: Sequence[str] = ("row", "col"), column: str = "class") -> DataFrame:
    """Pixels on which the class raster has one of the codes."""
    return pixels.join(classes.where(F.col(column).isin(*codes)).select(*keys).distinct(), list(keys), "left_semi")


def class_quota(samples: DataFrame, quota: DataFrame, column: str = "class") -> DataFrame:
    """Each sample with its class's quota."""
    return samples.join(small(quota), column)


def season_pairs(scenes: DataFrame, tile: str = "tile", date: str = "acq_date") -> DataFrame:
    """Each scene with the scenes of its tile in the dry season of the year before."""
    start, end = geo.season(F.year("t1_date"))
    t1 = scenes.select(tile, F.col("scene_id").alias("t1_scene"), F.col(date).alias("t1_date"), (F.year(date) - 1).alias("__y"))
    t0 = scenes.select(tile, F.col("scene_id").alias("t0_scene"), F.col(date).alias("t0_date"), F.year(date).alias("__y"))
    return t1.join(t0, [tile, "__y"]).where((F.col("t0_date") >= start) & (F.col("t0_date") < end)).drop("__y")


def first_basemap(items: DataFrame, basemaps: DataFrame, keys: Sequence[str] = ("year", "month"), order: Sequence[str] = ("map_id",)) -> DataFrame:
    """Each item with the first basemap of the same keys, if any."""
    return items.join(first_per(basemaps, keys, order), list(keys), "left")


def corrected(pixels: DataFrame, added: DataFrame, removed: DataFrame, label: str = "label", x: str = "x", y: str = "y") -> DataFrame:
    """Labels set to 1 inside added boxes and to 0 inside removed ones; removal wins."""
    one = lambda d: d.select("minx", "miny", "maxx", "maxy", F.lit(1).alias("__in"), F.lit(0).alias("__at"))
    both = points_in(pixels, one(added), "__in", "__at", 0, x=x, y=y).withColumnRenamed("__in", "__add")
    both = points_in(both, one(removed), "__in", "__at", 0, x=x, y=y)
    return both.withColumn(label, F.when(F.col("__in") == 1, 0).when(F.col("__add") == 1, 1).otherwise(F.col(label))).drop("__add", "__in")


