"""Hand-made grids and properties of patches, identity and lineage."""

import random

import pytest
from pyspark.sql import functions as F

from landweave.operators import lineage, patches

SHAPE = "year int, row int, col int"


def grid(spark, years):
    """years: {year: list of strings with # for a pixel}."""
    return spark.createDataFrame([(y, r, c) for y, rows in years.items() for r, line in enumerate(rows) for c, x in enumerate(line) if x == "#"], SHAPE)


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.year, r.patch), set()).add((r.row, r.col))
    return out


def flood(cells, eight):
    left, out = set(cells), []
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (eight or not (r and c))]
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            p = stack.pop()
            seen.add(p)
            for dr, dc in steps:
                q = (p[0] + dr, p[1] + dc)
                if q in left:
                    left.discard(q)
                    stack.append(q)
        out.append(seen)
    return sorted(map(sorted, out))


def test_corner_touch(spark):
    g = grid(spark, {1: ["#.", ".#"]})
    assert len(parts(patches.label_patches(g, 4))) == 2
    assert len(parts(patches.label_patches(g, 8))) == 1


def test_u_shape_meets_in_another_tile(spark):
    g = grid(spark, {1: ["#..#", "#..#", "####"]})
    assert len(parts(patches.label_patches(g, 4, tile=2))) == 1


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 7, 100])
def test_random_grids_are_flood_fill(spark, connectivity, tile):
    rng = random.Random(tile * connectivity)
    cells = {y: {(r, c) for r in range(25) for c in range(25) if rng.random() < 0.55} for y in (1, 2)}
    g = spark.createDataFrame([(y, r, c) for y in cells for r, c in cells[y]], SHAPE).repartition(5)
    got = parts(patches.label_patches(g, connectivity, tile=tile))
    for y in cells:
        assert sorted(sorted(v) for (yy, _), v in got.items() if yy == y) == flood(cells[y], connectivity == 8)
    assert all(p == min(r * patches.SPAN + c for r, c in v) + 1 for (_, p), v in got.items())


def test_values_keep_patches_apart(spark):
    g = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 3), (1, 0, 2, 6)], SHAPE + ", class int")
    assert len(parts(patches.label_patches(g, 4, value="class"))) == 2


def test_empty_grid(spark):
    e = spark.createDataFrame([], SHAPE)
    lab = patches.label_patches(e)
    assert lab.count() == 0 and patches.identity(lab).count() == 0 and lineage.edges(lab).count() == 0


def ids(df):
    return {(r.year, r.patch - 1): r.id for r in df.collect()}


def test_identity_rules(spark):
    years = {1: ["###.#.#", ".......", "...#..."], 2: ["#.#.###", ".......", "...##.#"]}
    lab = patches.label_patches(grid(spark, years))
    got = ids(patches.identity(lab))
    first = {k[1]: v for k, v in got.items() if k[0] == 1}
    assert first == {0: 1, 4: 2, 6: 3, 2 * patches.SPAN + 3: 4}
    assert got[2, 0] == got[2, 2] == 1  # a split keeps the identity
    assert got[2, 4] == 5  # a merge gets a new one
    assert got[2, 2 * patches.SPAN + 3] == 4  # growth keeps it
    assert got[2, 2 * patches.SPAN + 6] == 6  # a birth gets a new one
    new = ids(patches.identity(lab, "split_new"))
    assert new[2, 0] != new[2, 2] and min(new[2, 0], new[2, 2]) > 4


def test_growth_apart(spark):
    g = grid(spark, {1: ["#......"], 2: ["#####.."]})
    whole = patches.label_patches(g)
    assert len({r.id for r in patches.identity(whole).collect()}) == 1
    cut = {(r.year, r.apart, r.col) for r in patches.cut_growth(g, 4).collect()}
    assert cut == {(1, 0, 0), (2, 0, 0), (2, 0, 1), (2, 1, 2), (2, 1, 3), (2, 1, 4)}


def test_lost_gained_and_events(spark):
    lab = patches.label_patches(grid(spark, {1: ["#.##"], 2: ["..#.", "", "#..."]}))
    links = lineage.edges(lab)
    what = {(r.year, r.patch - 1): r.what for r in lineage.lost_and_gained(lab, links).collect()}
    assert what == {(1, 0): "lost", (2, 2 * patches.SPAN): "gained"}
    e = {(r.year, r.patch - 1): (r.origin, r.fate) for r in lineage.events(lab, links).collect()}
    assert e[1, 0] == (None, "loss") and e[1, 2] == (None, "continue") and e[2, 2] == ("continue", None) and e[2, 2 * patches.SPAN] == ("birth", None)
    over = links.groupBy("year", "parent").agg(F.sum("overlap_px").alias("n")).join(lineage.nodes(lab).withColumnRenamed("patch", "parent"), ["year", "parent"])
    assert over.where("n > area_px").count() == 0


def test_first_write_wins(spark):
    shape = "year int, patch long, area_px long"
    a, b = spark.createDataFrame([(1, 1, 5)], shape), spark.createDataFrame([(1, 1, 9), (2, 1, 7)], shape)
    assert sorted(map(tuple, lineage.upsert(a, b).collect())) == [(1, 1, 5), (2, 1, 7)]


def test_kept_identities_know_their_labels(spark, tmp_path):
    """One pixel of the third of four years changes: that year and later ones are made anew, earlier ones are left alone."""
    rng = random.Random(2)
    years = {y: {(r, c) for r in range(12) for c in range(12) if rng.random() < 0.45} for y in range(1995, 1999)}
    labels = lambda ys: patches.label_patches(spark.createDataFrame([(y, r, c) for y in sorted(ys) for r, c in sorted(ys[y])], "year int, row int, col int"), 4)
    plain = lambda df: sorted(map(tuple, df.select("year", "patch", "id").collect()))
    store = str(tmp_path / "ids")
    files = lambda y: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "ids" / f"year={y}").glob("*.parquet")}
    first = plain(patches.identity(labels(years), store=store))
    assert first == plain(patches.identity(labels(years)))
    kept = {y: files(y) for y in years}
    # The same rows in another order: nothing is written.
    assert plain(patches.identity(labels(years).orderBy(F.rand(1)), store=store)) == first and {y: files(y) for y in years} == kept
    changed = years | {1997: years[1997] ^ {(3, 3)}}
    got = plain(patches.identity(labels(changed), store=store))
    assert got == plain(patches.identity(labels(changed)))
    assert all((files(y) == kept[y]) == (y < 1997) for y in years)
    # A year that is gone and another policy; then a year whose write did not end.
    fewer = {y: p for y, p in changed.items() if y != 1996}
    again = plain(patches.identity(labels(fewer), "split_new"))
    assert plain(patches.identity(labels(fewer), "split_new", store=store)) == again
    (tmp_path / "ids" / "year=1997" / "_SUCCESS").unlink()
    kept = {y: files(y) for y in years}
    assert plain(patches.identity(labels(fewer), "split_new", store=store)) == again
    assert all((files(y) == kept[y]) == (y < 1997) for y in fewer)
