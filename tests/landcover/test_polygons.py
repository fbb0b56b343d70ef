"""Polygons against an even-odd test point by point."""

import random

import pytest
from pyspark.sql import functions as F

from landweave.operators import polygons
from landweave.operators.polygons import Grid
from landweave.plans import overlays


def table(spark, shapes):
    rows = [(i, i * 10, None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "feature int, value int, rings array<array<struct<x:double,y:double>>>")


def inside(rings, x, y):
    odd = False
    for ring in rings or []:
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
            (x0, y0), (x1, y1) = sorted([(px, py), (qx, qy)], key=lambda p: (p[1], p[0]))
            if y0 <= y < y1 and x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x:
                odd = not odd
    return odd


def shapes(rng, n, size=30):
    """Stars and tangles on a lattice of half pixels, so that borders run through pixel centres."""
    out = []
    for _ in range(n):
        half = lambda: rng.randrange(-8, 2 * size + 8) / 2
        out.append([[(half(), half()) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 3))])
    return out


def test_burn_equals_even_odd(spark):
    made = shapes(random.Random(1), 12)
    got = {(r.row, r.col): r.value for r in polygons.burn(table(spark, made), Grid(rows=30, cols=30), "value", "feature").collect()}
    want = {}
    for r in range(30):
        for c in range(30):
            hit = [i * 10 for i, rings in enumerate(made) if inside(rings, c + 0.5, r + 0.5)]
            if hit:
                want[r, c] = hit[0]
    assert got == want and len(want) > 300


def test_grid_of_falling_rows(spark):
    """Rows that run south, in map units."""
    grid = Grid(a=30.0, c=600.0, e=-30.0, f=9000.0, rows=20, cols=20)
    rings = [[(615.0, 8990.0), (1000.0, 8700.0), (700.0, 8400.0)]]
    got = {(r.row, r.col) for r in polygons.burn(table(spark, [rings]), grid, "value", "feature").collect()}
    # In pixels the same triangle, whose half-open sides are then those of the grid.
    flat = [[((x - 600) / 30, (9000 - y) / 30) for x, y in rings[0]]]
    assert got == {(r, c) for r in range(20) for c in range(20) if inside(flat, c + 0.5, r + 0.5)} and got


def test_shared_edges_share_no_pixel(spark):
    """Triangles that tile a square: every pixel has one owner, whatever way the rings run."""
    rng = random.Random(3)
    corners = [(0.0, 0.0), (24.0, 0.0), (24.0, 24.0), (0.0, 24.0)]
    mid = (9.5, 13.0)
    made = []
    for a, b in zip(corners, corners[1:] + corners[:1]):
        ring = [a, b, mid]
        rng.shuffle(ring)
        made.append([ring])
    cells = polygons.spans(table(spark, made), Grid(), ["feature"]).withColumn("col", F.explode(F.sequence("first", "last"))).groupBy("row", "col").count().collect()
    assert len(cells) == 24 * 24 and all(r["count"] == 1 for r in cells)


def test_pixels_and_corrections(spark):
    made = shapes(random.Random(5), 6)
    pixels = spark.createDataFrame([(y, r, c, (r + c) % 2) for y in (1, 2) for r in range(30) for c in range(0, 30, 3)], "year int, row int, col int, label int")
    got = polygons.label_pixels(pixels, table(spark, made), Grid(), "value", "feature", -1).collect()
    assert len(got) == pixels.count()
    for r in got:
        hit = [i * 10 for i, rings in enumerate(made) if inside(rings, r.col + 0.5, r.row + 0.5)]
        assert r.value == (hit[0] if hit else -1)
    fixed = polygons.corrected_labels(pixels, table(spark, made[:3]), table(spark, made[3:]), Grid())
    assert fixed.columns == pixels.columns
    for r in fixed.collect():
        at = r.col + 0.5, r.row + 0.5
        want = 0 if any(inside(s, *at) for s in made[3:]) else 1 if any(inside(s, *at) for s in made[:3]) else (r.row + r.col) % 2
        assert r.label == want


@pytest.mark.parametrize("cell", [1.0, 2.5, 8.0])
def test_cover_equals_even_odd(spark, cell):
    made = shapes(random.Random(7), 8)
    points = spark.createDataFrame([(i, i % 60 / 2, i // 60 / 2) for i in range(3600)], "id int, x double, y double")
    got = polygons.held(points, polygons.cover(table(spark, made), "feature", cell), cell).select("id", "feature").collect()
    assert len(got) == len(set(got))
    assert {(r.id, r.feature) for r in got} == {(i, k) for i in range(3600) for k, rings in enumerate(made) if inside(rings, i % 60 / 2, i // 60 / 2)}
    clipped = polygons.clip(points, table(spark, made[:2]), ["id"], cell)
    assert sorted(r.id for r in clipped.collect()) == [i for i in range(3600) if any(inside(s, i % 60 / 2, i // 60 / 2) for s in made[:2])]


def test_inner_cells_are_taken_whole(spark):
    """A large polygon: few cells, and few points that meet an edge."""
    ring = [[(3.0, 2.0), (130.0, 5.0), (120.0, 140.0), (4.0, 120.0)]]
    covered = polygons.cover(table(spark, [ring]), "feature", 1.0).cache()
    assert covered.where("edges is null").count() < 1500 and covered.agg(F.max("level")).first()[0] == 4
    points = spark.range(20000).select("id", (F.col("id") * 37 % 14001 / 100).alias("x"), (F.col("id") * 91 % 13999 / 100).alias("y"))
    r = polygons.held(points, covered, 1.0).agg(F.count(F.lit(1)).alias("n"), F.count_if("tested").alias("tested")).first()
    assert r.n > 10000 and r.tested < 0.03 * r.n


def test_one_large_polygon_is_many_tasks(spark):
    ring = [[(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0)]]
    cells = polygons.spans(table(spark, [ring]), Grid(), ["feature"]).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert cells.select("p").distinct().count() == 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def meet(a, b):
    def turn(p, q, r):
        d = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (d > 0) - (d < 0)

    def cross(p, q, r, s):
        box = all(max(min(p[i], q[i]), min(r[i], s[i])) <= min(max(p[i], q[i]), max(r[i], s[i])) for i in (0, 1))
        return box and turn(p, q, r) * turn(p, q, s) <= 0 and turn(r, s, p) * turn(r, s, q) <= 0

    sides = lambda rings: [(p, q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
    return any(cross(*s, *t) for s in sides(a) for t in sides(b)) or any(inside(b, *r[0]) for r in a) or any(inside(a, *r[0]) for r in b)


def test_intersecting(spark):
    rng = random.Random(11)
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    some = [box(rng.randrange(60) / 2, rng.randrange(60) / 2, rng.randrange(1, 8) / 2) for _ in range(40)] + [box(-50.0, -50.0, 200.0)]
    hole = [box(0.0, 0.0, 30.0)[0], box(5.0, 5.0, 20.0)[0]]
    for regions in (shapes(rng, 2), [hole], [box(100.0, 100.0, 2.0)]):
        got = {r.feature for r in polygons.intersecting(table(spark, some), table(spark, regions), "feature", 4.0).collect()}
        assert got == {i for i, s in enumerate(some) if any(meet(s, r) for r in regions)}


def test_cases(spark):
    square = [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]
    made = [None, [], [[]], [[(1.0, 1.0)]], [[(0.0, 2.5), (9.0, 2.5)]], [[*square, square[0]]], [[square[0], (2.0, 1.0), (3.0, 1.0), *square[1:]]], [square, square]]
    t = table(spark, made)
    cells = polygons.spans(t, Grid(), ["feature"]).withColumn("col", F.explode(F.sequence("first", "last")))
    got = {(r.feature, r.row, r.col) for r in cells.collect()}
    assert got == {(f, r, c) for f in (5, 6) for r in (1, 2, 3) for c in (1, 2, 3)}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 2.0), (3, 2.0, 4.0), (4, None, 2.0), (5, 3.999, 3.999)], "id int, x double, y double")
    got = {(r.id, r.feature) for r in polygons.held(points, polygons.cover(t, "feature", 1.0), 1.0).collect()}
    assert got == {(1, 5), (1, 6), (5, 5), (5, 6)}
    assert polygons.burn(t.limit(0), Grid(), "value", "feature").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def piled(spark, n=30, size=70.0):
    """Equal squares with a value each, one on the other."""
    return table(spark, [[[(1.0, 1.0), (size, 1.0), (size, size), (1.0, size)]]] * n)


def test_pixels_under_many_polygons_are_not_gathered(spark):
    """Only the first polygon's runs become pixels, so nothing has to bring the others' together."""
    many = piled(spark)
    burnt = polygons.burn(many, Grid(rows=80, cols=80), "value", "feature")
    assert "Aggregate" not in plan(burnt)
    assert {r.value for r in burnt.collect()} == {0} and burnt.count() == 69 * 69


def test_runs_over_several_stretches(spark):
    """Runs that begin and end in different stretches of a row, some behind others."""
    strip = lambda a, b: [[(a, 0.0), (b, 0.0), (b, 2.0), (a, 2.0)]]
    made = [strip(4090.0, 4100.0), strip(-5.0, 9000.0), strip(8000.0, 13000.0)]
    got = {(r.row, r.col): r.value for r in polygons.burn(table(spark, made), Grid(), "value", "feature").collect()}
    assert got == {(r, c): 0 if 4090 <= c < 4100 else 10 if c < 9000 else 20 for r in (0, 1) for c in range(-5, 13000)}


def test_labels_join_only_the_first_polygon(spark):
    """The join's other side has a run for each pixel once, however many polygons lie there."""
    pixels = spark.createDataFrame([(1, r, c) for r in range(0, 80, 7) for c in range(80)] + [(2, None, 3)], "year int, row int, col int")
    out = polygons.label_pixels(pixels, piled(spark), Grid(), "value", "feature", -1)
    assert "Aggregate" not in plan(out)
    got = out.collect()
    assert len(got) == pixels.count() and all(r.value == (0 if r.row is not None and 1 <= r.row < 70 and 1 <= r.col < 70 else -1) for r in got)


def test_corrections_join_only_the_last_word(spark):
    pixels = spark.createDataFrame([(r, c, 0) for r in range(0, 80, 7) for c in range(80)], "row int, col int, label int")
    out = polygons.corrected_labels(pixels, piled(spark), piled(spark, 5, 20.0), Grid())
    assert "Aggregate" not in plan(out)
    assert {(r.row, r.col) for r in out.collect() if r.label} == {(r, c) for r in range(0, 80, 7) for c in range(80) if 1 <= r < 70 and 1 <= c < 70 and not (r < 20 and c < 20)}


def test_cover_of_a_box(spark):
    """Cells beyond a box are not made, and points in it are held as without one."""
    made = shapes(random.Random(19), 6) + [[[(-300.0, -300.0), (300.0, -290.0), (310.0, 300.0)]]]
    points = spark.createDataFrame([(i, i % 60 / 2, i // 60 / 2) for i in range(3600)], "id int, x double, y double")
    boxed, full = (polygons.cover(table(spark, made), "feature", 1.0, box=b) for b in ((0, 0, 30, 30), None))
    assert 2 * boxed.count() < full.count() and boxed.select("feature", "level", "cx", "cy").exceptAll(full.select("feature", "level", "cx", "cy")).count() == 0
    of = lambda covered: {(r.id, r.feature) for r in polygons.held(points, covered, 1.0).collect()}
    assert of(boxed) == of(full) == {(i, k) for i in range(3600) for k, rings in enumerate(made) if inside(rings, i % 60 / 2, i // 60 / 2)}


def test_clip_looks_at_regions_as_one(spark, monkeypatch):
    """Thirty regions that lie on one another are joined like one: a point meets one cell."""
    seen, small = [], polygons.small
    monkeypatch.setattr(polygons, "small", lambda df, *a: seen.append(df) or small(df, *a))
    points = spark.range(3600).select("id", (F.col("id") % 60 * 1.5).alias("x"), (F.floor(F.col("id") / 60) * 1.5).alias("y"))
    wide = [[[(0.0, 0.0), (80.0, 0.0), (80.0, 80.0), (0.0, 80.0)]]]
    got = sorted(r.id for r in polygons.clip(points, table(spark, wide * 30 + [[[(8.0, 8.0), (20.0, 9.0), (9.0, 20.0)]]]), ["id"], 1.0).collect())
    assert got == [i for i in range(3600) if i % 60 * 1.5 < 80 and i // 60 * 1.5 < 80]
    covered = seen[-1]
    whole = covered.where("edges is null")
    assert whole.count() == whole.select("level", "cx", "cy").distinct().count()
    # The triangle's border lies in whole cells of the squares.
    assert covered.where("edges is not null and cx between 4 and 70 and cy between 4 and 70").count() == 0


def test_edges_of_a_small_file_are_dealt_over_tasks(spark):
    """A table of one partition, whose few edges become many rows."""
    one = table(spark, shapes(random.Random(23), 40)).coalesce(1)
    assert polygons.edges(one, ["feature"]).rdd.getNumPartitions() == 4


def test_masks_equal_even_odd(spark):
    """Every pixel of every polygon, also under others, clipped to the grid; none of null and empty rings."""
    made = shapes(random.Random(13), 10) + [None, [], [[(1.0, 1.0), (9.0, 1.0)]], [[(-50.0, -50.0), (80.0, -50.0), (80.0, 80.0), (-50.0, 80.0)]]]
    got = [tuple(r) for r in polygons.masks(table(spark, made), Grid(rows=30, cols=30), ["feature"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, r, c) for k, rings in enumerate(made) for r in range(30) for c in range(30) if inside(rings, c + 0.5, r + 0.5)}


def test_masks_join_no_pixels(spark):
    """A parcel's pixels come from its runs: no grid is joined, and few runs of many pixels stay dealt over all tasks."""
    plan = overlays.book.queries["sc11_polygon_masks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Range" not in plan
    ring = [[(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0)]]
    pixels = polygons.masks(table(spark, [ring]), Grid(rows=400, cols=400), ["feature"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(pixels) == 4 and sum(r["count"] for r in pixels) == 160_000
