"""Polygons against grids, points and each other.

A polygon is a row with its rings, arrays of (x, y) in any order and direction; a point lies in it when
an odd number of edges cross the ray to its left. An edge holds its lower end and not its upper one, and
a crossing at the point's own x counts, so left and lower borders belong to a polygon, right and upper
ones do not: polygons that share an edge share no point and leave none out. Edges run from their lower
end on both sides of a border, so both sides compute the same crossing.

Edges are rows of their own. What is decided by grid row or by cell is grouped and joined on it, so one
polygon of any size is the work of many tasks.

Cases: null or empty rings, and rings of no height, hold nothing; a first point repeated at the end, or
points on a line, change nothing; rings that overlap cancel (even-odd); null points lie nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landweave.operators import lines
from landweave.operators.overlay import small
from landweave.storage import discard, materialize, partitions

#: Columns of a grid row that a run of pixels is cut at before it is joined with pixels, and before the first of the runs is found.
RUN, STRETCH = 256, 4096


@dataclass(frozen=True)
class Grid:
    """Pixel (row, col) has its corner at (``a`` col + ``c``, ``e`` row + ``f``), as X8; ``rows`` and ``cols`` bound it where given."""

    a: float = 1.0
    c: float = 0.0
    e: float = 1.0
    f: float = 0.0
    rows: int | None = None
    cols: int | None = None

    def centre(self) -> tuple[Column, Column]:
        return F.col("col") * self.a + (self.c + self.a / 2), F.col("row") * self.e + (self.f + self.e / 2)


def edges(polygons: DataFrame, keys: Sequence[str], rings: str = "rings", grid: Grid | None = None) -> DataFrame:
    """``keys`` and ``x0, y0, x1, y1`` of every edge with ``y0 <= y1``; in pixels from the first pixel's centre with a ``grid``.

    Edges are dealt over all tasks, as a table of polygons is small beside the rows that its edges become.
    """
    ring = polygons.select(*keys, F.explode(rings).alias("__ring")).withColumn("__ring", F.filter("__ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    after = F.concat(F.slice("__ring", 2, F.greatest(F.size("__ring") - 1, F.lit(0))), F.slice("__ring", 1, 1))
    pair = F.explode(F.zip_with("__ring", after, lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
    dealt = ring.select(*keys, pair.alias("__e")).repartition(partitions(polygons.sparkSession))
    ends = dealt.select(*keys, *[F.col(f"__e.{e}.{a}").cast("double").alias(f"{e}{a}") for e in "pq" for a in "xy"])
    if grid:
        for e in "pq":
            ends = ends.withColumn(f"{e}x", (F.col(f"{e}x") - grid.c) / grid.a - 0.5).withColumn(f"{e}y", (F.col(f"{e}y") - grid.f) / grid.e - 0.5)
    up = (F.col("py") < F.col("qy")) | ((F.col("py") == F.col("qy")) & (F.col("px") <= F.col("qx")))
    pick = lambda low, a: F.when(up, F.col(f"{'p' if low else 'q'}{a}")).otherwise(F.col(f"{'q' if low else 'p'}{a}"))
    return ends.select(*keys, pick(True, "x").alias("x0"), pick(True, "y").alias("y0"), pick(False, "x").alias("x1"), pick(False, "y").alias("y1"))


def _at(y: Column) -> Column:
    """Where an edge crosses the height ``y``."""
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))


def _within(low: Column, high: Column, size: int | None) -> tuple[Column, Column]:
    return (low, high) if size is None else (F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1)))


def _crossings(polygons: DataFrame, grid: Grid, keys: Sequence[str], rings: str) -> DataFrame:
    """``keys, row, u``: where every edge crosses each row of pixel centres between its ends."""
    first, last = _within(F.ceil("y0"), F.ceil("y1") - 1, grid.rows)
    crossed = edges(polygons, keys, rings, grid).where("y0 < y1").withColumn("__a", first).withColumn("__b", last).where("__a <= __b")
    return crossed.withColumn("row", F.explode(F.sequence("__a", "__b"))).select(*keys, F.col("row").cast("int").alias("row"), _at(F.col("row")).alias("u"))


def _paired(crossings: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys, "row").orderBy("u")
    paired = crossings.withColumn("__n", F.row_number().over(order)).withColumn("__to", F.lead("u").over(order)).where("__n % 2 = 1 and __to is not null")
    a, b = _within(F.ceil("u"), F.ceil("__to") - 1, grid.cols)
    return paired.select(*keys, "row", a.cast("int").alias("first"), b.cast("int").alias("last")).where("first <= last")


def spans(polygons: DataFrame, grid: Grid, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """``keys, row, first, last``: the runs of pixels whose centres lie in each polygon.

    Every edge gives its crossing of each row between its ends; the crossings of a polygon and row, in
    order, open and close its runs in turn.
    """
    return _paired(_crossings(polygons, grid, keys, rings), grid, keys)


def masks(polygons: DataFrame, grid: Grid, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """SC11: ``keys, row, col`` of every pixel whose centre lies in each polygon.

    Pixels are made from runs as they are given out, so what is shuffled grows with the height of the
    polygons and not with their area; crossings are dealt by number, as a few become many pixels.
    """
    dealt = _crossings(polygons, grid, keys, rings).repartition(partitions(polygons.sparkSession), *keys, "row")
    return _paired(dealt, grid, keys).select(*keys, "row", F.explode(F.sequence("first", "last")).alias("col"))


def _numbered(polygons: DataFrame) -> DataFrame:
    """Polygons that may share value and order are told apart."""
    return polygons.withColumn("__id", F.monotonically_increasing_id())


def _paint(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces on which the same run is the first of those that hold them: index of the run, first and last place."""
    start = int(first.min())
    row = np.full(int(last.max()) - start + 1, -1)
    for i in range(len(first) - 1, -1, -1):
        row[first[i] - start : last[i] - start + 1] = i
    cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    end = np.r_[cut[1:], len(row)] - 1
    held = row[cut] >= 0
    return row[cut][held], cut[held] + start, end[held] + start


def _foremost(polygons: DataFrame, grid: Grid, value: str, order: str, rings: str) -> DataFrame:
    """``row, first, last`` and the value of the first polygon by ``order``; no two runs share a pixel.

    A stretch of a row takes its runs in turn, so that pixels under many polygons are never rows.
    """
    runs = spans(_numbered(polygons), grid, ["__id", value, order], rings)
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    cut = runs.withColumn("__b", F.explode(F.sequence(stretch("first"), stretch("last"))))
    cut = cut.withColumn("first", F.greatest("first", (F.col("__b") * STRETCH).cast("int"))).withColumn("last", F.least("last", (F.col("__b") * STRETCH + (STRETCH - 1)).cast("int")))
    dealt = cut.repartition(partitions(polygons.sparkSession), "row", "__b").sortWithinPartitions("row", "__b", F.struct(order, value)).select("row", "__b", "first", "last", F.col(value).alias("__v"))
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("row", "first", "last")] + [T.StructField(value, polygons.schema[value].dataType)])

    def run(batches):
        for b, new in lines._whole_lines(batches, 2):
            first, last = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            starts = np.flatnonzero(new)
            made = [(lo, *_paint(first[lo:hi], last[lo:hi])) for lo, hi in zip(starts.tolist(), np.r_[starts[1:], b.num_rows].tolist())]
            which = pa.array(np.concatenate([lo + i for lo, i, _, _ in made]))
            places = [pa.array(np.concatenate([m[k] for m in made]), pa.int32()) for k in (2, 3)]
            yield pa.record_batch([b.column(0).take(which), *places, b.column(4).take(which)], names=["row", "first", "last", value])

    return dealt.mapInArrow(run, schema)


def burn(polygons: DataFrame, grid: Grid, value: str, order: str, rings: str = "rings") -> DataFrame:
    """``row, col`` and the value of the first polygon by ``order`` for every pixel that any holds."""
    return _foremost(polygons, grid, value, order, rings).select("row", F.explode(F.sequence("first", "last")).alias("col"), value)


def label_pixels(pixels: DataFrame, polygons: DataFrame, grid: Grid, value: str, order: str, default=None, rings: str = "rings") -> DataFrame:
    """J9 on the pixels of a table: each with the value of the first polygon that holds its centre, else ``default``.

    Only the runs of the first polygon of each pixel are joined. They are cut at multiples of ``RUN`` columns,
    so the join is on row and block, and as they share no pixel a block of a row has ``RUN`` at most.
    """
    block = lambda c: F.floor(F.col(c) / RUN)
    runs = _foremost(polygons, grid, value, order, rings).select(F.col("row").alias("__row"), F.explode(F.sequence(block("first"), block("last"))).alias("__b"), F.col("first").alias("__first"), F.col("last").alias("__last"), value)
    on = (F.col("row") == F.col("__row")) & (block("col") == F.col("__b")) & F.col("col").between(F.col("__first"), F.col("__last"))
    rest = [c for c in pixels.columns if c not in ("row", "col")]
    out = pixels.join(small(materialize(runs)), on, "left").select("row", "col", *rest, value)
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def corrected_labels(pixels: DataFrame, added: DataFrame, removed: DataFrame, grid: Grid, label: str = "label", rings: str = "rings") -> DataFrame:
    """Labels set to 1 inside added polygons and to 0 inside removed ones; removal wins."""
    both = added.select(F.col(rings).alias("rings"), F.lit(1).alias("__set")).unionByName(removed.select(F.col(rings).alias("rings"), F.lit(0).alias("__set"))).withColumn("__order", F.col("__set"))
    marked = label_pixels(pixels, both, grid, "__set", "__order")
    return marked.withColumn(label, F.coalesce("__set", label)).drop("__set").select(*pixels.columns)


def _touched(of: DataFrame, cell: float, rows: tuple[int, int] | None = None) -> DataFrame:
    """Edges with each cell (of some rows of cells) that they touch; a hair more rather than less."""
    hair = 1e-9 * cell
    down = lambda c: F.floor(c / cell)
    held = of.withColumn("cy", F.explode(_between(down(F.col("y0") - hair), down(F.col("y1") + hair), rows)))
    low, high = F.greatest(F.col("y0"), F.col("cy") * cell), F.least(F.col("y1"), (F.col("cy") + 1) * cell)
    flat = F.col("y0") == F.col("y1")
    a, b = F.when(flat, F.col("x0")).otherwise(_at(low)), F.when(flat, F.col("x1")).otherwise(_at(high))
    wide = hair + F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b))
    return held.withColumn("cx", F.explode(F.sequence(down(F.least(a, b) - wide), down(F.greatest(a, b) + wide))))


def _between(low: Column, high: Column, bounds: tuple[int, int] | None) -> Column:
    """Whole numbers from ``low`` to ``high``, of those within ``bounds``."""
    if bounds is None:
        return F.sequence(low, high)
    a, b = F.greatest(low, F.lit(bounds[0]).cast("long")), F.least(high, F.lit(bounds[1]).cast("long"))
    return F.when(a <= b, F.sequence(a, F.greatest(a, b)))


def _bounds(box: Sequence[float] | None, cell: float, levels: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """First and last column and row of cells that meet a box (minx, miny, maxx, maxy), to whole cells of the largest level."""
    if box is None:
        return None, None
    down = lambda v: math.floor(v / (cell * 2**levels)) * 2**levels
    return tuple((down(box[i]), down(box[i + 2]) + 2**levels - 1) for i in (0, 1))


def _parent(c: str, n: int) -> Column:
    return F.shiftright(F.col(c), n)


def _border(of: DataFrame, key: str, cell: float, levels: int, box: Sequence[float] | None) -> DataFrame:
    """``key, cx, cy``: the cells of level 0 that an edge touches, in the rows of a box, written once."""
    return materialize(_touched(of, cell, _bounds(box, cell, levels)[1]).select(key, "cx", "cy").distinct())


def _sides(border: DataFrame, of: DataFrame, key: str, cell: float, levels: int, box: Sequence[float] | None) -> DataFrame:
    """``key, cx, cy, flip, edges`` of border cells."""
    cols, rows = _bounds(box, cell, levels)
    border = border if cols is None else border.where(F.col("cx").between(*cols))
    band = of.where("y0 < y1").withColumn("cy", F.explode(_between(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell), rows)))
    left, right, low, high, hair = F.col("cx") * cell, (F.col("cx") + 1) * cell, F.col("cy") * cell, (F.col("cy") + 1) * cell, 1e-6 * cell
    through = (F.greatest("x0", "x1") < left - hair) & (F.col("y0") <= low) & (F.col("y1") >= high)
    near = (F.least("x0", "x1") <= right + hair) & ~through
    # A cell and an edge right of it are no row; by number, so that small cells that become many edges stay dealt out.
    dealt, n = band.withColumnsRenamed({key: "__key", "cy": "__cy"}), partitions(of.sparkSession)
    met = border.repartition(n, key, "cy").join(dealt.repartition(n, "__key", "__cy"), (F.col(key) == F.col("__key")) & (F.col("cy") == F.col("__cy")) & (near | through), "left")
    return met.groupBy(key, "cx", "cy").agg(
        (F.count_if(through) % 2).cast("int").alias("flip"), F.collect_list(F.when(near, F.struct("x0", "y0", "x1", "y1"))).alias("edges")
    )


def _whole(border: DataFrame, polygons: DataFrame, key: str, cell: float, levels: int, rings: str, box: Sequence[float] | None) -> DataFrame:
    """``key, level, cx, cy``: the largest cells inside each polygon that no edge touches.

    From the border inwards: below the largest level they are cells beside a touched one in the same touched
    parent, and of the largest level all between two touched cells of a row. Each such cell or stretch of
    cells is inside as a whole or not at all. No inner cell of a smaller level is made that a larger one holds.
    """
    cols, rows = _bounds(box, cell, levels)
    beside = [(n, i, j) for n in range(levels) for i in (0, 1) for j in (0, 1)]
    mark = lambda n, x, y, hit: F.struct(F.lit(n).alias("level"), x.alias("cx"), y.alias("cy"), F.lit(hit).alias("hit"))
    marks = [mark(n, _parent("cx", n), _parent("cy", n), True) for n in range(levels)]
    marks += [mark(n, F.shiftleft(_parent("cx", n + 1), 1) + i, F.shiftleft(_parent("cy", n + 1), 1) + j, False) for n, i, j in beside]
    # A largest parent holds all that its cells mark, so that this is the only time they move.
    top = [_parent("cx", levels).alias("__tx"), _parent("cy", levels).alias("__ty")]
    asked = border.select(key, "cx", "cy", *top).repartition(partitions(border.sparkSession), key, "__tx", "__ty").select(key, "__tx", "__ty", F.explode(F.array(*marks)).alias("m")).select(key, "__tx", "__ty", "m.*") if levels else None
    row = Window.partitionBy(key, "cy").orderBy("cx")
    between = border.select(key, top[0].alias("cx"), top[1].alias("cy")).distinct().withColumn("__to", F.lead("cx").over(row) - 1).withColumn("cx", F.col("cx") + 1)
    if cols:
        between = between.withColumn("cx", F.greatest("cx", F.lit(cols[0] >> levels).cast("long"))).withColumn("__to", F.least("__to", F.lit(cols[1] >> levels).cast("long")))
    found = between.where("cx <= __to").select(key, F.lit(levels).alias("level"), "cx", "cy", "__to")
    if levels:
        free = asked.groupBy(key, "__tx", "__ty", "level", "cx", "cy").agg(F.max("hit").alias("hit")).where("not hit")
        free = free if cols is None else free.where(F.col("__tx").between(cols[0] >> levels, cols[1] >> levels))
        found = found.unionByName(free.select(key, "level", "cx", "cy", F.col("cx").alias("__to")))
    runs = None
    for n in range(levels + 1):
        one = spans(polygons, Grid(a=cell * 2**n, e=cell * 2**n), [key], rings).select(key, F.lit(n).alias("level"), F.col("row").cast("long").alias("cy"), "first", "last")
        one = one if rows is None else one.where(F.col("cy").between(rows[0] >> n, rows[1] >> n))
        runs = one if runs is None else runs.unionByName(one)
    inside = found.join(runs, [key, "level", "cy"]).where(F.col("cx").between(F.col("first"), F.col("last")))
    return inside.select(key, "level", F.explode(F.sequence("cx", "__to")).alias("cx"), "cy")


def cover(polygons: DataFrame, key: str, cell: float, levels: int = 4, rings: str = "rings", box: Sequence[float] | None = None) -> DataFrame:
    """Quadtree cells of each polygon: ``key, level, cx, cy, flip, edges``; a cell of a level is ``cell * 2 ** level`` wide.

    Inner cells have no ``edges`` and are whole; four that make up one of the next level are that one.
    Cells that an edge touches are of level 0. They carry the edges that decide about points in them: those
    of their band of height that are neither right of the cell, nor left of it through the whole band; an
    odd number of the latter is ``flip``. Of a ``box`` (minx, miny, maxx, maxy) that all points lie in, only
    the cells that meet it are needed. The cells are written once, as their number is looked at before they are joined.
    """
    of = edges(polygons, [key], rings)
    border = _border(of, key, cell, levels, box)
    sides = _sides(border, of, key, cell, levels, box)
    whole = _whole(border, polygons, key, cell, levels, rings, box).withColumn("flip", F.lit(0)).withColumn("edges", F.lit(None).cast(sides.schema["edges"].dataType))
    out = materialize(whole.unionByName(sides.select(key, F.lit(0).alias("level"), "cx", "cy", "flip", "edges")))
    discard(border)
    return out


def _odd(x: Column, y: Column) -> Column:
    """Whether an odd number of the edges that a border cell knows of lies left of a point in it."""
    crosses = lambda e: (e["y0"] <= y) & (y < e["y1"]) & (e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]) <= x)
    return (F.col("flip") + F.size(F.filter("edges", crosses))) % 2 == 1


def _keyed(points: DataFrame, cell: float, x: Column, y: Column, levels: int) -> DataFrame:
    """``points`` with a place ``__x, __y``, once for each ``__level`` with its cell ``__cx, __cy``."""
    places = points.withColumn("__x", x.cast("double")).withColumn("__y", y.cast("double")).where("__x is not null and __y is not null")
    at = [F.struct(F.lit(n).alias("__level"), F.floor(F.col("__x") / (cell * 2**n)).alias("__cx"), F.floor(F.col("__y") / (cell * 2**n)).alias("__cy")) for n in range(levels + 1)]
    return places.withColumn("__at", F.explode(F.array(*at))).select("*", "__at.*").drop("__at")


def held(points: DataFrame, covered: DataFrame, cell: float, x: Column | str = "x", y: Column | str = "y", levels: int = 4) -> DataFrame:
    """``points`` with each polygon of a :func:`cover` that holds them; ``tested`` says whether edges had to be looked at."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    on = (F.col("__level") == F.col("level")) & (F.col("__cx") == F.col("cx")) & (F.col("__cy") == F.col("cy"))
    met = _keyed(points, cell, x, y, levels).join(small(covered), on).where(F.col("edges").isNull() | _odd(F.col("__x"), F.col("__y")))
    return met.withColumn("tested", F.col("edges").isNotNull()).drop("level", "cx", "cy", "__level", "__cx", "__cy", "flip", "edges", "__x", "__y")


def _cover_of_any(regions: DataFrame, key: str, cell: float, levels: int, box: Sequence[float] | None) -> DataFrame:
    """``level, cx, cy, flip, edges`` of a cover of all regions as one: no cell lies in a whole one, so a point is in one cell at most."""
    of = edges(regions, [key])
    border = _border(of, key, cell, levels, box)
    whole = _whole(border, regions, key, cell, levels, "rings", box).select("level", "cx", "cy").distinct()
    within = border if box is None else border.where(F.col("cx").between(*_bounds(box, cell, levels)[0]))
    rest = materialize(whole.withColumn(key, F.lit(None).cast("long")).unionByName(within.withColumn("level", F.lit(0))))
    read, kept = [border, rest], None
    for n in range(levels, -1, -1):
        these = rest.where(F.col(key).isNull() & (F.col("level") == n)).select("level", "cx", "cy")
        kept = these if kept is None else kept.unionByName(these)
        over = small(these.select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy")))
        under = (F.expr(f"shiftright(cx, {n} - level)") == F.col("__cx")) & (F.expr(f"shiftright(cy, {n} - level)") == F.col("__cy"))
        rest = materialize(rest.where(F.col(key).isNotNull() | (F.col("level") < n)).join(over, under, "left_anti"))
        read.append(rest)
    sides = _sides(rest.select(key, "cx", "cy"), of, key, cell, levels, box).select(F.lit(0).alias("level"), "cx", "cy", "flip", "edges")
    out = materialize(kept.withColumn("flip", F.lit(0)).withColumn("edges", F.lit(None).cast(sides.schema["edges"].dataType)).unionByName(sides))
    discard(*read)
    return out


def clip(points: DataFrame, regions: DataFrame, keys: Sequence[str], cell: float, x: Column | str = "x", y: Column | str = "y", levels: int = 4, rings: str = "rings", box: Sequence[float] | None = None) -> DataFrame:
    """F13, SC11: rows of ``points`` that lie in any region; ``keys`` tell the rows apart, though each is looked at alone.

    Cells that lie in a whole cell of another region are left out first, so that no point meets all regions
    that hold it. A ``box`` as in :func:`cover`.
    """
    named = _numbered(regions.select(F.col(rings).alias("rings"))).withColumnRenamed("__id", "__region")
    covered = _cover_of_any(named, "__region", cell, levels, box)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    on = (F.col("__level") == F.col("level")) & (F.col("__cx") == F.col("cx")) & (F.col("__cy") == F.col("cy"))
    found = _keyed(points, cell, x, y, levels).join(small(covered), on & (F.col("edges").isNull() | _odd(F.col("__x"), F.col("__y"))), "left_semi")
    return found.select(*points.columns)


def _meets(p: str, q: str) -> Column:
    """Whether two segments have a point in common."""

    def turn(s: str, t: str, i: int) -> Column:
        c = lambda n, k: F.col(f"{n}.{k}")
        return (c(s, "x1") - c(s, "x0")) * (c(t, f"y{i}") - c(s, "y0")) - (c(s, "y1") - c(s, "y0")) * (c(t, f"x{i}") - c(s, "x0"))

    apart = lambda a: (F.least(f"{p}.{a}0", f"{p}.{a}1") > F.greatest(f"{q}.{a}0", f"{q}.{a}1")) | (F.least(f"{q}.{a}0", f"{q}.{a}1") > F.greatest(f"{p}.{a}0", f"{p}.{a}1"))
    sides = lambda s, t: F.signum(turn(s, t, 0)) * F.signum(turn(s, t, 1)) <= 0
    return ~apart("x") & ~apart("y") & sides(p, q) & sides(q, p)


def intersecting(features: DataFrame, regions: DataFrame, key: str, cell: float, levels: int = 4, rings: str = "rings") -> DataFrame:
    """Features that share a point with any region, borders included.

    Two polygons meet where edges meet, which is tested for edges that touch a common cell, or one holds a
    ring of the other, and with it the ring's first point.
    """
    named = _numbered(regions.select(F.col(rings).alias("rings"))).withColumnRenamed("__id", "__region")
    edge = lambda df, k: _touched(edges(df, [k], "rings"), cell).select(k, "cx", "cy", F.struct("x0", "y0", "x1", "y1").alias("a" if k == "__f" else "b"))
    mine = features.select(F.col(key).alias("__f"), F.col(rings).alias("rings"))
    crossed = edge(mine, "__f").join(edge(named, "__region"), ["cx", "cy"]).where(_meets("a", "b")).select("__f")
    first = lambda df, k: df.select(k, F.explode("rings").alias("__ring")).select(k, F.get("__ring", F.lit(0)).alias("p")).select(k, "p.x", "p.y")
    inside = held(first(mine, "__f"), cover(named, "__region", cell, levels), cell, levels=levels).select("__f")
    around = held(first(named, "__region"), cover(mine, "__f", cell, levels), cell, levels=levels).select("__f")
    meets = crossed.unionByName(inside).unionByName(around).distinct()
    return features.join(meets, features[key] == F.col("__f"), "left_semi")
