"""Metres on the ground and grids of any ratio."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from landweave.functions import metres
from landweave.operators import composite


def test_known_places(spark):
    """Points on a central meridian and on the equator, by arc length and by the ellipsoid's own integral."""

    def meridian(lat, steps=20000):
        """Metres from the equator along a meridian, by the trapezium rule."""
        e2, h = metres.FLATTENING * (2 - metres.FLATTENING), math.radians(lat) / steps
        f = lambda p: metres.SEMI_MAJOR * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
        return h * (sum(f(i * h) for i in range(1, steps)) + (f(0) + f(steps * h)) / 2)

    df = spark.createDataFrame([(-57.0, lat) for lat in (0.0, 10.0, 45.0, 84.0, -33.0)], "lon double, lat double")
    for r in df.select("lat", metres.project(F.col("lon"), F.col("lat")).alias("m")).collect():
        want = metres.SCALE * meridian(abs(r.lat))
        assert abs(r.m.x - 500000) < 1e-6 and r.m.zone == 21 and r.m.south == (r.lat < 0)
        assert abs(r.m.y - (10_000_000 - want if r.lat < 0 else want)) < 1e-3


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-180, 180), rng.uniform(-83.9, 83.9)) for _ in range(2000)] + [(180.0, 0.0), (-180.0, 10.0), (179.9999, -5.0), (0.0, 0.0), (6.0, 60.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("m", metres.project(F.col("lon"), F.col("lat")))
    back = df.withColumn("d", metres.unproject(F.col("m.zone"), F.col("m.south"), F.col("m.x"), F.col("m.y")))
    for r in back.collect():
        around = (r.d.lon - r.lon + 180) % 360 - 180
        assert abs(around * math.cos(math.radians(r.lat))) < 1e-9 and abs(r.d.lat - r.lat) < 1e-9
        assert 1 <= r.m.zone <= 60 and 160_000 < r.m.x < 840_000


def test_distances_are_metres(spark):
    """A step of 1 km in the plane is 1 km on the ground, but for the scale of the zone."""
    at = spark.createDataFrame([(-54.3, -7.2), (12.4, 48.0), (-51.01, 0.0)], "lon double, lat double")
    boxes = metres.buffer_box(at, 1000.0).collect()
    for r in boxes:
        b = r.box
        assert b.minx < r.lon < b.maxx and b.miny < r.lat < b.maxy
        high = (b.maxy - b.miny) * 111_132.95
        wide = (b.maxx - b.minx) * 111_319.49 * math.cos(math.radians(r.lat))
        assert 1980 < high < 2100 and 1980 < wide < 2100


def test_metre_grid_inside_its_box(spark):
    boxes = spark.createDataFrame([("a", -55.2, -3.1, -54.9, -2.8), ("b", 5.8, 59.9, 6.3, 60.1), ("c", 1.0, 1.0, 1.0, 2.0)], "name string, minx double, miny double, maxx double, maxy double")
    got = metres.metre_grid(boxes, 1000.0, ["name"]).collect()
    by = defaultdict(list)
    for r in got:
        assert r.x % 1000 == 0 and r.y % 1000 == 0
        by[r.name].append(r)
    assert set(by) == {"a", "b"}
    # As many as the area holds, within the border.
    area = {"a": 0.3 * 0.3 * 110.57 * 111.32 * math.cos(math.radians(2.95)), "b": 0.5 * 0.2 * 111.41 * 111.41 * math.cos(math.radians(60)) * 1.0}
    assert all(abs(len(by[k]) - area[k]) < 0.08 * area[k] for k in by)
    assert len({(r.name, r.x, r.y) for r in got}) == len(got)


def test_null_and_poles(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (3.0, 90.0), (3.0, -90.0)], "lon double, lat double").select("lat", metres.project(F.col("lon"), F.col("lat")).alias("m"))
    rows = df.collect()
    assert rows[0].m.x is None and rows[1].m.x is None
    assert abs(rows[2].m.x - 500000) < 1e-3 and abs(rows[2].m.y - 9_997_964.943) < 0.01 and abs(rows[3].m.y - 2035.057) < 0.01


def plain_regrid(cells, ratio, origin, how):
    """Overlap areas in fractions."""
    ratio, origin = Fraction(ratio), [Fraction(o) for o in origin]
    weights = defaultdict(lambda: defaultdict(Fraction))
    for (r, c), v in cells.items():
        if v is None:
            continue
        for tr in range(math.floor((r - origin[0]) / ratio), math.ceil((r + 1 - origin[0]) / ratio)):
            for tc in range(math.floor((c - origin[1]) / ratio), math.ceil((c + 1 - origin[1]) / ratio)):
                over = lambda t, a, o: min(a + 1, (t + 1) * ratio + o) - max(a, t * ratio + o)
                weights[tr, tc][v] += over(tr, r, origin[0]) * over(tc, c, origin[1])
    if how == "mode":
        return {k: min(w, key=lambda v: (-w[v], v)) for k, w in weights.items()}
    return {k: float(sum(a * v for v, a in w.items()) / sum(w.values())) for k, w in weights.items()}


@pytest.mark.parametrize("ratio, origin", [("3.7", ("0", "0")), ("2", ("0.5", "-1.25")), ("1", ("0", "0")), ("0.4", ("0.1", "0")), ("5.05", ("7", "2.5"))])
def test_regrid(spark, ratio, origin):
    rng = random.Random(8)
    cells = {(r, c): rng.choice([1, 2, 3, 4, None]) for r in range(18) for c in range(18) if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row int, col int, v int")
    for how in ("mode", "mean"):
        got = {(r.row, r.col): r.v for r in composite.regrid(df, "v", ratio, how, origin=origin).collect()}
        want = plain_regrid(cells, ratio, origin, how)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        composite.regrid(df, "v", 0)


def test_overviews_are_made_level_from_level(spark):
    rng = random.Random(9)
    cells = {(r, c): rng.randrange(3) for r in range(17) for c in range(17)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row int, col int, v int")
    got = defaultdict(dict)
    for r in composite.overviews(df, "v", 3).collect():
        got[r.level][r.row, r.col] = r.v
    for level in (1, 2, 3):
        cells = plain_regrid(cells, "2", ("0", "0"), "mode")
        assert got[level] == cells
