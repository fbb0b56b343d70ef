"""Chips: fixed-size windows as arrays, their augmentation, scoring and resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import arrays
from landweave.operators.sampling import hash_order


def to_chips(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], row: str = "chip_row", col: str = "chip_col") -> DataFrame:
    """SC7, SC8: one row a chip with its pixels as a row-major flat array. A chip's size is fixed, so its group is bounded."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.array(*[F.col(b).cast("double") for b in bands]).alias("v"))))
    return pixels.groupBy(*keys).agg(cells.alias("x")).select(*keys, F.flatten(F.transform("x", lambda e: e["v"])).alias("data"), F.size("x").alias("pixels"))


def to_pixels(chips: DataFrame, w: int, c: int, data: str = "data", keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """UD3: a row for each value of each chip."""
    return chips.select(*keys, F.explode(arrays.rows_of(F.col(data), w, c)).alias("x")).select(*keys, "x.*")


def augmented(chips: DataFrame, h: int, w: int, c: int, data: str = "data") -> DataFrame:
    """Original, rotated, flipped left-right and flipped up-down chips with an ``aug`` tag; square chips."""
    forms = {"original": F.col(data), "rotated": arrays.rotate_90(F.col(data), h, w, c), "left_right": arrays.flip_left_right(F.col(data), h, w, c), "up_down": arrays.flip_up_down(F.col(data), h, w, c)}
    out = None
    for tag, value in forms.items():
        one = chips.withColumn(data, value).withColumn("aug", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    return out


def _gathered(data: str, n: int, at: Callable[[Column], Column]) -> Column:
    """Array of ``n`` values: the one at place ``at(i)`` of the chip, 0 where that is null."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(data, at(i)), F.lit(0.0)))


def randomly_turned(chips: DataFrame, h: int, w: int, c: int, degrees: float = 45.0, seed: int = 0, key: str = "chip_id", data: str = "data") -> DataFrame:
    """A5, Q21: flips and a rotation of up to ``degrees`` decided by each chip's hash; nearest pixel, 0 outside."""
    up, left, turn = (hash_order(key, 3 * seed + i) for i in range(3))
    angle = F.radians((turn / F.lit(2.0**31) - 1) * degrees)
    y0, x0 = (h - 1) / 2, (w - 1) / 2

    def at(i: Column) -> Column:
        r, k = F.floor(i / (w * c)) - y0, F.floor(i / c) % w - x0
        rr = F.rint(r * F.cos("__angle") + k * F.sin("__angle") + y0).cast("int")
        kk = F.rint(k * F.cos("__angle") - r * F.sin("__angle") + x0).cast("int")
        inside = rr.between(0, h - 1) & kk.between(0, w - 1)
        rr, kk = F.when(F.col("__up"), h - 1 - rr).otherwise(rr), F.when(F.col("__left"), w - 1 - kk).otherwise(kk)
        return F.when(inside, (rr * w + kk) * c + i % c)

    half = F.lit(1 << 31)
    marked = chips.withColumns({"__angle": angle, "__up": up < half, "__left": left < half})
    return marked.withColumn(data, _gathered(data, h * w * c, at)).select(*chips.columns)


def resampled(chips: DataFrame, h: int, w: int, c: int, to: tuple[int, int], align_corners: bool = False, data: str = "data") -> DataFrame:
    """Bilinear resampling to another size, with aligned corners or half-pixel centres."""

    def along(i: Column, n: int, m: int) -> Column:
        return i * ((n - 1) / max(m - 1, 1)) if align_corners else F.least(F.greatest((i + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(n - 1.0))

    def value(i: Column) -> Column:
        y, x = along(F.floor(i / (to[1] * c)), h, to[0]), along(F.floor(i / c) % to[1], w, to[1])
        r0, k0 = F.floor(y).cast("int"), F.floor(x).cast("int")
        r1, k1 = F.least(r0 + 1, F.lit(h - 1)), F.least(k0 + 1, F.lit(w - 1))
        of = lambda r, k: F.get(data, (r * w + k) * c + i % c)
        row = lambda k: of(r0, k) * (1 - (y - r0)) + of(r1, k) * (y - r0)
        return row(k0) * (1 - (x - k0)) + row(k1) * (x - k0)

    return chips.withColumn(data, F.transform(F.sequence(F.lit(0), F.lit(to[0] * to[1] * c - 1)), value))


def predict(chips: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: tuple[int, int, int], data: str = "data", out: str = "probability") -> DataFrame:
    """UD1: a user's model on every chip. ``model()`` is called once a task and returns a function from
    (chips, h, w, c) to (chips, h, w) probabilities; null chips (F10) must be dropped before."""

    def run(batches):
        score = model()
        for pdf in batches:
            x = np.stack([np.asarray(d, float).reshape(shape) for d in pdf[data]]) if len(pdf) else np.zeros((0, *shape))
            p = np.asarray(score(x)).reshape(len(pdf), -1)
            yield pd.DataFrame({**{k: pdf[k] for k in pdf.columns if k != data}, out: p.tolist()})

    kept = [f for f in chips.schema.fields if f.name != data]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{out} array<double>"])
    return chips.mapInPandas(run, schema)


def keep_detections(chips: DataFrame, least: float = 0.2, probability: str = "probability") -> DataFrame:
    """chips with any pixel at or over a probability."""
    return chips.where(F.exists(probability, lambda x: x >= least))
