"""Names, dates, affine georeferences and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HECTARE = 10_000.0
#: Fixed value: mean Earth radius in metres of the sphere used for pixel areas.
RADIUS = 6_371_008.8


def tile_name_parts(path: Column) -> dict[str, Column]:
    """Year and origin from names like ``..._<year>_<row>_<col>.tif``."""
    pattern = r"_(\d+)_(\d+)_(\d+)\.tif$"
    return {n: F.regexp_extract(path, pattern, i).cast("int") for i, n in enumerate(("year", "row", "col"), 1)}


def base_name(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def tile_name(prefix: str, *parts: Column) -> Column:
    """Keyed name of a tile or chip."""
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def season(year: Column) -> tuple[Column, Column]:
    """First day and end (exclusive) of the dry season of the year before."""
    return F.make_date(year - 1, F.lit(5), F.lit(1)), F.make_date(year - 1, F.lit(7), F.lit(30))


def month_window(year: Column, month: Column) -> tuple[Column, Column]:
    """First day of a month and of the next one."""
    first = F.make_date(year, month, F.lit(1))
    return first, F.add_months(first, 1)


def analysis_year(date: Column) -> Column:
    """Label year of a date; a year runs from August to July."""
    return F.year(date) + F.when(F.month(date) >= 8, 1).otherwise(0)


def pixel_to_map(a: Column, c: Column, e: Column, f: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel's corner."""
    return a * col + c, e * row + f


def affine_of(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Origin and pixel size from coordinate columns: left, top and the smallest steps."""
    # Distinct coordinates are as many as the grid has rows or columns.
    step = lambda c: points.select(c).distinct().withColumn("d", F.col(c) - F.lag(c).over(Window.orderBy(c))).agg(F.min("d").alias(f"step_{c}"))
    ends = points.agg(F.min(x).alias("c"), F.max(y).alias("f"))
    return ends.crossJoin(step(x)).crossJoin(step(y)).select(F.col(f"step_{x}").alias("a"), "c", (-F.col(f"step_{y}")).alias("e"), "f")


def chip_origin(x: Column, y: Column, scale: float, size: int) -> tuple[Column, Column]:
    """Left and top of a chip centred on a point."""
    half = scale * size / 2
    return x - half, y + half


def tile_transform(a: Column, c: Column, e: Column, f: Column, row: Column, col: Column) -> Column:
    """X11: the affine of a tile that begins at a pixel."""
    return F.struct(a.alias("a"), (c + a * col).alias("c"), e.alias("e"), (f + e * row).alias("f"))


def centroid(ring: Column) -> Column:
    """Centroid of a closed or open ring of (x, y) by the shoelace sums; the mean for a ring of no area."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        w = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((acc["s"] + w).alias("s"), (acc["x"] + (a["x"] + b["x"]) * w).alias("x"), (acc["y"] + (a["y"] + b["y"]) * w).alias("y"), (acc["mx"] + a["x"]).alias("mx"), (acc["my"] + a["y"]).alias("my"))

    def done(acc: Column) -> Column:
        flat = acc["s"] == 0
        return F.struct(F.when(flat, acc["mx"] / n).otherwise(acc["x"] / (3 * acc["s"])).alias("x"), F.when(flat, acc["my"] / n).otherwise(acc["y"] / (3 * acc["s"])).alias("y"))

    return F.aggregate(F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), zero, add, done)


def box(x: Column, y: Column, radius: float) -> Column:
    """Bounding box of a point's buffer."""
    return F.struct((x - radius).alias("minx"), (y - radius).alias("miny"), (x + radius).alias("maxx"), (y + radius).alias("maxy"))


def pixel_area_ha(latitude: Column, degrees: float) -> Column:
    """SC10: ground area in hectares of a square pixel of some degrees, by latitude."""
    side = F.lit(RADIUS) * F.radians(F.lit(degrees))
    return side * side * F.cos(F.radians(latitude)) / HECTARE
