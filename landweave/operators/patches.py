"""Connected patches of sparse yearly grids, and their identity over the years.

A patch is named by its smallest pixel, ``row * SPAN + col + 1``, so names do not depend on tiles or
tasks, and 0 is free to mean the background.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators.components import connected_components
from landweave.operators.neighborhood import dilate
from landweave.operators.overlay import small
from landweave.operators.ranking import counted_rows, number_rows
from landweave.storage import exists, materialize

#: Columns a grid may have at most; a year's pixels are numbered below SPAN * SPAN.
SPAN = 100_000


def tiled(pixels: DataFrame, size: int = 600) -> DataFrame:
    """K1: tile keys ``ti, tj`` of each pixel."""
    return pixels.withColumn("ti", F.floor(F.col("row") / size).cast("int")).withColumn("tj", F.floor(F.col("col") / size).cast("int"))


def _offsets(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if connectivity == 8 else [])


def neighbours(pixels: DataFrame, connectivity: int = 4, value: str | None = None, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Pairs of neighbouring pixels (of the same value), each once: the keys, ``row, col`` and ``row2, col2``."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _offsets(connectivity)]))
    same = [value] if value else []
    ahead = pixels.select(*keys, "row", "col", *same, steps.alias("s")).select(*keys, *same, F.col("row").alias("row1"), F.col("col").alias("col1"), (F.col("row") + F.col("s.r")).cast("int").alias("row"), (F.col("col") + F.col("s.c")).cast("int").alias("col"))
    joined = ahead.join(pixels.select(*keys, "row", "col", *same), [*keys, "row", "col", *same])
    return joined.select(*keys, F.col("row1").alias("row"), F.col("col1").alias("col"), F.col("row").alias("row2"), F.col("col").alias("col2"))


def _local(connectivity: int):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, val = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["val"].to_numpy()
        name = rows.astype(np.int64) * SPAN + cols
        order = np.argsort(name, kind="stable")
        sorted_names = name[order]
        lab = np.arange(len(name))
        a, b = [], []
        for dr, dc in _offsets(connectivity):
            target = name + dr * SPAN + dc
            at = np.minimum(np.searchsorted(sorted_names, target), len(name) - 1)
            hit = (sorted_names[at] == target) & (val[order[at]] == val) & (cols + dc >= 0)
            a.append(np.flatnonzero(hit))
            b.append(order[at[hit]])
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = np.minimum(lab[a], lab[b])
            new = lab.copy()
            np.minimum.at(new, lab[a], low)
            np.minimum.at(new, lab[b], low)
            while not np.array_equal(jump := new[new], new):
                new = jump
            if np.array_equal(new, lab):
                break
            lab = new
        least = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(least, lab, name)
        return pd.DataFrame({"part": pdf["part"], "row": rows, "col": cols, "val": val, "local": least[lab]})

    return label


def label_patches(pixels: DataFrame, connectivity: int = 4, value: str | None = None, keys: Sequence[str] = ("year",), tile: int = 600) -> DataFrame:
    """K2, K3, K4, K5: keys, ``row``, ``col`` and ``patch``, named by the smallest pixel of the connected patch (of equal value).

    Tiles are labelled on their own, each a bounded array; then labels that touch across a seam (J11) are
    merged by components over the label table, which is far smaller than the pixels, and mapped back.
    """
    pixels = materialize(pixels.select(*keys, "row", "col", *([value] if value else [])).distinct())
    # Key combinations (years) get whole numbers, so that a label is one number; there are few of them.
    parts = number_rows(pixels.select(*keys).distinct(), list(keys), "part", 0) if keys else None
    base = pixels.join(small(parts), list(keys)) if keys else pixels.withColumn("part", F.lit(0).cast("long"))
    base = base.select("part", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col(value).cast("long") if value else F.lit(1).cast("long")).alias("val"))
    local = tiled(base, tile).groupBy("part", "ti", "tj").applyInPandas(_local(connectivity), "part long, row int, col int, val long, local long")
    node = F.col("part") * (SPAN * SPAN) + F.col("local")
    local = materialize(local.withColumn("node", node))
    edge = lambda c: F.col(c) % tile == tile - 1
    seam = local.where(edge("row") | edge("col") | (F.col("row") % tile == 0) | (F.col("col") % tile == 0)).select("part", "row", "col", "val", "node")
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _offsets(connectivity)]))
    ahead = seam.select("part", "val", F.col("node").alias("a"), "row", "col", steps.alias("s"))
    over = (F.floor((F.col("row") + F.col("s.r")) / tile) != F.floor(F.col("row") / tile)) | (F.floor((F.col("col") + F.col("s.c")) / tile) != F.floor(F.col("col") / tile))
    ahead = ahead.where(over).select("part", "val", "a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    touching = ahead.join(seam, ["part", "val", "row", "col"]).select("a", F.col("node").alias("b"))
    merged = connected_components(touching, "a", "b")
    out = local.join(merged, "node", "left").select("part", "row", "col", (F.coalesce("component", "node") % (SPAN * SPAN) + 1).alias("patch"))
    return (out.join(small(parts), "part") if keys else out).select(*keys, "row", "col", "patch")


def areas(labels: DataFrame, keys: Sequence[str] = ("year", "patch"), hectares=None) -> DataFrame:
    """Pixels (and hectares) of each patch."""
    extra = [F.sum(hectares).alias("area_ha")] if hectares is not None else []
    return labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area_px"), *extra)


def boxes(labels: DataFrame, keys: Sequence[str] = ("year", "patch")) -> DataFrame:
    """Bounding box of each patch."""
    return labels.groupBy(*keys).agg(F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1"))


def drop_small(labels: DataFrame, hectares, more_than: float = 1.0, cap: int | None = None) -> DataFrame:
    """Pixels of patches of more than some hectares; ``cap`` counts at most that many pixels of a patch."""
    px = F.count(F.lit(1))
    area = F.least(px, F.lit(cap)) / px * F.sum(hectares) if cap else F.sum(hectares)
    kept = labels.groupBy("year", "patch").agg(area.alias("ha")).where(F.col("ha") > more_than).select("year", "patch")
    return labels.join(kept, ["year", "patch"], "left_semi")


def relabel(labels: DataFrame, keys: Sequence[str] = ("year",), patch: str = "patch") -> DataFrame:
    """Patches numbered 1, 2, ... in ascending order within each of the (few) key groups."""
    distinct = number_rows(labels.select(*keys, patch).distinct(), [*keys, patch], "__n")
    if keys:
        first = distinct.groupBy(*keys).agg(F.min("__n").alias("__f"))
        distinct = distinct.join(small(first), list(keys)).withColumn("__n", F.col("__n") - F.col("__f") + 1).drop("__f")
    return labels.join(distinct, [*keys, patch]).withColumn("number", F.col("__n")).drop("__n")


def _taken(now: DataFrame, before: DataFrame, policy: str, overlap: str) -> DataFrame:
    """``patch``, ``id`` of the patches that take an identity of the year before (``row``, ``col``, ``id``)."""
    if overlap == "pixels":
        meets = now.join(before, ["row", "col"]).select("patch", "id")
    else:
        size = 64
        bb = boxes(now, ["patch"])
        bb = bb.withColumn("__i", F.explode(F.sequence(F.floor(F.col("row0") / size), F.floor(F.col("row1") / size)))).withColumn("__j", F.explode(F.sequence(F.floor(F.col("col0") / size), F.floor(F.col("col1") / size))))
        cells = before.withColumn("__i", F.floor(F.col("row") / size)).withColumn("__j", F.floor(F.col("col") / size))
        meets = bb.join(cells, ["__i", "__j"]).where("row between row0 and row1 and col between col0 and col1").select("patch", "id")
    taken = meets.groupBy("patch").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("patch", "id")
    if policy == "split_new":
        taken = taken.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("__k = 1").drop("__k")
    return taken


def _held(spark, folder: str, chain: str) -> int:
    """The largest identity of a kept year, 0 if its digest is another or it has none."""
    table = spark.read.parquet(folder)
    if "digest" not in table.columns:
        return 0
    r = table.agg(F.max("id").alias("top"), F.min("digest").alias("a"), F.max("digest").alias("b")).first()
    return r.top if r.a == r.b == chain else 0


def identity(labels: DataFrame, policy: str = "inherit", overlap: str = "pixels", store: str | None = None) -> DataFrame:
    """K6, K7, L4, ST3: ``year, patch, id`` with identities carried over the years.

    A patch that overlaps pixels (or whose bounding box holds pixels) of exactly one identity of the year
    before takes it; others get new ones, after the largest so far in ascending order of patch.
    ``split_new`` gives new identities also where several patches would take the same one.

    The carried state is the table of identities by year. With ``store`` it is kept there, a folder a year,
    each with a digest of the labels it follows from: its own year's, whatever their order, those of all
    years before, and the policy. A later run takes the years whose digests still hold and starts again with
    the first that differs, is missing or was not written to its end; earlier years are left as they are.
    """
    if policy not in ("inherit", "split_new") or overlap not in ("pixels", "box"):
        raise ValueError("policy is inherit or split_new, overlap is pixels or box")
    spark = labels.sparkSession
    # The years are few, and each needs the identities of the one before; each year's pixels are files of their own.
    labels = materialize(labels, by=["year"])
    each = F.sum(F.xxhash64("row", "col", "patch").cast("decimal(38,0)")).alias("sum")
    inputs = {r.year: f"{r.n} {r.sum}" for r in labels.groupBy("year").agg(F.count(F.lit(1)).alias("n"), each).collect()}
    top, before, chain, valid, out = 0, None, f"{policy} {overlap}", store is not None, []
    for year in sorted(inputs):
        now, folder = labels.where(F.col("year") == year), f"{store}/year={year}"
        chain = hashlib.sha256(f"{chain}\n{year} {inputs[year]}".encode()).hexdigest()
        kept = valid and exists(spark, f"{folder}/_SUCCESS") and _held(spark, folder, chain)
        valid = bool(kept)
        if kept:
            ids, top = spark.read.parquet(folder).select(F.lit(year).alias("year"), "patch", "id"), max(top, kept)
        else:
            patches = now.select("patch").distinct()
            taken = None if before is None else materialize(_taken(now, before, policy, overlap))
            new = patches if taken is None else patches.join(taken, "patch", "left_anti")
            fresh, count = counted_rows(new, ["patch"], "id", top + 1)
            found = fresh if taken is None else fresh.unionByName(taken)
            top += count
            if store:
                found.withColumn("digest", F.lit(chain)).write.mode("overwrite").parquet(folder)
                ids = spark.read.parquet(folder).select(F.lit(year).alias("year"), "patch", "id")
            else:
                ids = materialize(found.select(F.lit(year).alias("year"), "patch", "id"))
        out.append(ids)
        before = now.join(ids.drop("year"), "patch").select("row", "col", "id")
    result = out[0] if out else labels.select("year", "patch", F.lit(0).cast("long").alias("id")).limit(0)
    for ids in out[1:]:
        result = result.unionByName(ids)
    return result


def cut_growth(pixels: DataFrame, connectivity: int = 8) -> DataFrame:
    """K8, Q30: ``year, row, col, patch, apart``: pixels over one step from last year's are patches of their own."""
    reach = dilate(pixels.select((F.col("year") + 1).alias("year"), "row", "col"), ["year"]).withColumn("near", F.lit(True))
    first = pixels.agg(F.min("year").alias("y0"))
    split = pixels.join(reach, ["year", "row", "col"], "left").crossJoin(F.broadcast(first)).withColumn("apart", (F.col("near").isNull() & (F.col("year") > F.col("y0"))).cast("int"))
    return label_patches(split.select("year", "row", "col", "apart"), connectivity, keys=("year", "apart"))
