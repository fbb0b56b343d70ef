"""Metres on the ground: transverse Mercator in zones of six degrees, forward and back, as columns.

Series of fourth order in the third flattening, which are within a micrometre in a zone and within a
millimetre two zones away. A zone's central meridian is its number times 6 less 183 degrees; eastings
begin at 500 km west of it, northings at the equator, south of it at minus 10,000 km.

Cases: null in, null out; longitudes are taken modulo 360; latitudes beyond 84 degrees are computed like
any other, the poles themselves too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reference ellipsoid in metres, scale on the central meridian, false easting and northing.
SEMI_MAJOR, FLATTENING, SCALE, EAST, NORTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0

_n = FLATTENING / (2 - FLATTENING)
#: Metres of a radian of the rectifying sphere.
ARC = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ECCENTRIC = 2 * _n**0.5 / (1 + _n)
#: The series' coefficients, plane from sphere, sphere from plane, and latitude from conformal latitude.
PLANE = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
SPHERE = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
LATITUDE = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def zone_of(lon: Column) -> Column:
    """Number of the zone of a longitude, 1 to 60."""
    return (F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 6) + 1).cast("int")


def _meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def project(lon: Column, lat: Column, zone: Column | None = None, south: Column | None = None) -> Column:
    """``zone, south, x, y`` in metres, in the point's own zone and half unless given."""
    zone = zone_of(lon) if zone is None else zone
    south = lat < 0 if south is None else south
    # Differences across the date line are taken the short way round.
    dl = F.radians(F.pmod(lon - _meridian(zone) + 180.0, F.lit(360.0)) - 180.0)
    # Tangent of the conformal latitude.
    tan = F.tan(F.radians(lat))
    sigma = F.sinh(ECCENTRIC * F.atanh(ECCENTRIC * F.sin(F.radians(lat))))
    t = tan * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tan * tan)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(PLANE, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct(zone.alias("zone"), south.alias("south"), (EAST + SCALE * ARC * x).alias("x"), (F.when(south, NORTH).otherwise(0.0) + SCALE * ARC * y).alias("y"))


def unproject(zone: Column, south: Column, x: Column, y: Column) -> Column:
    """``lon, lat`` in degrees of a point in metres."""
    xi, eta = (y - F.when(south, NORTH).otherwise(0.0)) / (SCALE * ARC), (x - EAST) / (SCALE * ARC)
    a, b = xi, eta
    for j, c in enumerate(SPHERE, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    lon = _meridian(zone) + F.degrees(F.atan2(F.sinh(b), F.cos(a)))
    return F.struct((F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), F.degrees(lat).alias("lat"))


_AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def _bounds(points: Sequence[Column], x: str, y: str, names: Sequence[str] = ("minx", "miny", "maxx", "maxy")) -> Column:
    ends = [f(*[p[c] for p in points]) for f, c in ((F.least, x), (F.least, y), (F.greatest, x), (F.greatest, y))]
    return F.struct(*[e.alias(n) for e, n in zip(ends, names)])


def buffer_box(df: DataFrame, radius: float, lon: str = "lon", lat: str = "lat", out: str = "box") -> DataFrame:
    """``df`` with the box in degrees around the square of ``radius`` metres about each point."""
    at = df.withColumn("__m", project(F.col(lon), F.col(lat)))
    m = F.col("__m")
    corners = [unproject(m["zone"], m["south"], m["x"] + dx * radius, m["y"] + dy * radius) for dx, dy in _AROUND]
    with_corners = at.withColumn("__c", F.array(*corners))
    return with_corners.withColumn(out, _bounds([F.get("__c", F.lit(i)) for i in range(len(_AROUND))], "lon", "lat")).drop("__m", "__c")


def metre_grid(regions: DataFrame, step: float, keys: Sequence[str]) -> DataFrame:
    """``keys, x, y, lon, lat`` of seeds at whole multiples of ``step`` metres inside each region's box of degrees.

    Low borders are in, high ones out. The seeds of a region lie in the zone of its box's middle, and each
    row of seeds is a row of its own before it is spread, so that a large region is many rows.
    """
    middle_x, middle_y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    boxed = regions.select(*keys, "minx", "miny", "maxx", "maxy", zone_of(middle_x).alias("__zone"), (middle_y < 0).alias("__south"))
    side = lambda low, middle, high, k: (low, middle, high)[k + 1]
    points = [project(side(F.col("minx"), middle_x, F.col("maxx"), dx), side(F.col("miny"), middle_y, F.col("maxy"), dy), F.col("__zone"), F.col("__south")) for dx, dy in _AROUND]
    # A side bends by no more than an eighth of its squared length over the radius; seeds so far out are tried too.
    bend = SEMI_MAJOR / 8 * (F.pow(F.radians(F.col("maxx") - F.col("minx")), 2) + F.pow(F.radians(F.col("maxy") - F.col("miny")), 2))
    more = F.ceil(bend / step) + 1
    spread = boxed.withColumn("__p", F.array(*points)).withColumn("__b", _bounds([F.get("__p", F.lit(i)) for i in range(len(_AROUND))], "x", "y"))
    along = lambda a, b: F.sequence(F.floor(F.col(f"__b.{a}") / step) - more, F.ceil(F.col(f"__b.{b}") / step) + more)
    rows = spread.withColumn("__j", F.explode(along("miny", "maxy"))).withColumn("__i", F.explode(along("minx", "maxx"))).withColumn("x", F.col("__i") * step).withColumn("y", F.col("__j") * step)
    placed = rows.withColumn("__d", unproject(F.col("__zone"), F.col("__south"), F.col("x"), F.col("y"))).withColumn("lon", F.col("__d.lon")).withColumn("lat", F.col("__d.lat"))
    return placed.where("lon >= minx and lon < maxx and lat >= miny and lat < maxy").select(*keys, F.col("__zone").alias("zone"), "x", "y", "lon", "lat")
