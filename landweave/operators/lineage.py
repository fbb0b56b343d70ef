"""Parent and child patches of consecutive years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.overlay import next_year
from landweave.operators.patches import SPAN, areas


def edges(labels: DataFrame) -> DataFrame:
    """``year, parent, child, overlap_px``, from each patch to those of the next year on its pixels."""
    return next_year(labels, "patch").groupBy("year", "parent", "child").agg(F.count(F.lit(1)).alias("overlap_px"))


def tuples(links: DataFrame, tile: int = 900, tiles_across: int = 1000) -> DataFrame:
    """UD4: lineage as rows of ``step`` (years since the first), ``parent`` and ``child``, each a (tile, patch) pair; a patch is of the tile of its smallest pixel."""
    first = links.agg(F.min("year").alias("__y0"))
    place = lambda p: (F.floor(F.floor((F.col(p) - 1) / SPAN) / tile) * tiles_across + F.floor((F.col(p) - 1) % SPAN / tile)).cast("int")
    pair = lambda p: F.struct(place(p).alias("tile"), F.col(p).alias("patch"))
    return links.crossJoin(F.broadcast(first)).select((F.col("year") - F.col("__y0")).alias("step"), pair("parent").alias("parent"), pair("child").alias("child"))


def tile_edges(labels: DataFrame, tile: int = 900) -> DataFrame:
    """Edges with the parent's pixels in the tiles that parent and child share, as counted tile by tile."""
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    here = labels.select("year", cell("row").alias("ti"), cell("col").alias("tj"), F.col("patch").alias("parent")).groupBy("year", "ti", "tj", "parent").agg(F.count(F.lit(1)).alias("px"))
    pairs = next_year(labels, "patch").groupBy("year", cell("row").alias("ti"), cell("col").alias("tj"), "parent", "child").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(here, ["year", "ti", "tj", "parent"])
    return joined.groupBy("year", "parent", "child").agg(F.sum("n").alias("overlap_px"), F.sum("px").alias("parent_px_in_shared_tiles"))


def with_background(labels: DataFrame) -> DataFrame:
    """K10 as coded: edges that also count the pixels without a patch in one of the years as patch 0."""
    years = labels.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    now = labels.select("year", "row", "col", F.col("patch").alias("parent"))
    after = labels.select((F.col("year") - 1).alias("year"), "row", "col", F.col("patch").alias("child"))
    both = now.join(after, ["year", "row", "col"], "full_outer").crossJoin(F.broadcast(years)).where("year >= lo and year < hi")
    return both.select("year", F.coalesce("parent", F.lit(0)).alias("parent"), F.coalesce("child", F.lit(0)).alias("child")).groupBy("year", "parent", "child").agg(F.count(F.lit(1)).alias("overlap_px"))


def nodes(labels: DataFrame) -> DataFrame:
    """SK4: ``year, patch, area_px``, one a patch and year."""
    return areas(labels)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("year", "patch"), value: str = "area_px") -> DataFrame:
    """SK4: old and new rows with one a key; the first write wins."""
    both = old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    return both.groupBy(*keys).agg(F.min_by(value, F.struct("__o", value)).alias(value))


def lost_and_gained(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``year, patch, what``: patches without a child in the next year, or without a parent in the one before."""
    every = labels.select("year", "patch").distinct()
    ends = labels.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    bounded = every.crossJoin(F.broadcast(ends))
    lost = bounded.where("year < hi").join(links.select("year", F.col("parent").alias("patch")), ["year", "patch"], "left_anti")
    gained = bounded.where("year > lo").join(links.select((F.col("year") + 1).alias("year"), F.col("child").alias("patch")), ["year", "patch"], "left_anti")
    return lost.select("year", "patch", F.lit("lost").alias("what")).unionByName(gained.select("year", "patch", F.lit("gained").alias("what")))


def query_edges(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges to real patches with the areas at both ends."""
    parent = sizes.select("year", F.col("patch").alias("parent"), F.col("area_px").alias("parent_px"))
    child = sizes.select((F.col("year") - 1).alias("year"), F.col("patch").alias("child"), F.col("area_px").alias("child_px"))
    return links.where("child <> 0").join(parent, ["year", "parent"]).join(child, ["year", "child"])


def degrees(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Patches with their numbers of children and parents."""
    out = links.groupBy("year", F.col("parent").alias("patch")).agg(F.count(F.lit(1)).alias("children"), F.sum("overlap_px").alias("kept_px"))
    come = links.groupBy((F.col("year") + 1).alias("year"), F.col("child").alias("patch")).agg(F.count(F.lit(1)).alias("parents"), F.sum("overlap_px").alias("inherited_px"))
    return nodes(labels).join(out, ["year", "patch"], "left").join(come, ["year", "patch"], "left").na.fill(0, ["children", "parents", "kept_px", "inherited_px"])


def events(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Each patch with what became of it: ``origin`` (birth, merge, split, continue) and ``fate`` (loss, split, merge, continue).

    A patch comes of a split if its only parent has several children; its fate is a merge if its only
    child has several parents. In the first year there is no origin, in the last no fate.
    """
    d = degrees(labels, links)
    up = links.join(d.select("year", F.col("patch").alias("parent"), F.col("children").alias("siblings")), ["year", "parent"])
    up = up.groupBy((F.col("year") + 1).alias("year"), F.col("child").alias("patch")).agg(F.max("siblings").alias("siblings"))
    down = links.join(d.select((F.col("year") - 1).alias("year"), F.col("patch").alias("child"), F.col("parents").alias("mates")), ["year", "child"])
    down = down.groupBy("year", F.col("parent").alias("patch")).agg(F.max("mates").alias("mates"))
    ends = labels.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    j = d.join(up, ["year", "patch"], "left").join(down, ["year", "patch"], "left").crossJoin(F.broadcast(ends))
    origin = F.when(F.col("year") == F.col("lo"), None).when(F.col("parents") == 0, "birth").when(F.col("parents") > 1, "merge").when(F.col("siblings") > 1, "split").otherwise("continue")
    fate = F.when(F.col("year") == F.col("hi"), None).when(F.col("children") == 0, "loss").when(F.col("children") > 1, "split").when(F.col("mates") > 1, "merge").otherwise("continue")
    return j.select("year", "patch", "area_px", "parents", "children", origin.alias("origin"), fate.alias("fate"))


def lifecycle(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Per identity its first and last year, lifetime, first, last and largest area, area lost and gained, and merges and splits met."""
    px = areas(labels.join(ids, ["year", "patch"]), ("year", "id"))
    after = px.select((F.col("year") - 1).alias("year"), "id", F.col("area_px").alias("next_px"))
    change = px.join(after, ["year", "id"], "left").withColumn("d", F.col("next_px") - F.col("area_px"))
    d = degrees(labels, edges(labels)).join(ids, ["year", "patch"]).groupBy("id").agg(F.sum((F.col("parents") > 1).cast("int")).alias("merges"), F.sum((F.col("children") > 1).cast("int")).alias("splits"))
    life = change.groupBy("id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), (F.max("year") - F.min("year") + 1).alias("lifetime"), F.max("area_px").alias("largest_px"),
        F.min_by("area_px", "year").alias("first_px"), F.max_by("area_px", "year").alias("last_px"),
        F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0)).alias("lost_px"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("gained_px"),
    )
    return life.join(d, "id")
