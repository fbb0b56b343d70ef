"""Per-pixel band functions: columns in, columns out. Masked pixels are nulls."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reflectance of pure green vegetation, dry vegetation, soil and cloud by band.
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
ENDMEMBERS = {
    "gv": (0.0119, 0.0475, 0.0169, 0.6250, 0.2399, 0.0675),
    "npv": (0.1514, 0.1597, 0.1421, 0.3053, 0.7707, 0.1975),
    "soil": (0.1799, 0.2479, 0.3158, 0.5437, 0.7707, 0.6646),
    "cloud": (0.4031, 0.8714, 0.7900, 0.8989, 0.7002, 0.6607),
}
#: Scale and offset of optical and thermal digital numbers.
OPTICAL, THERMAL = (0.0000275, -0.2), (0.00341802, 149.0)
#: Bounds of the change classes, the forest threshold and the cloud threshold.
STABLE, CLEARED, FOREST, CLOUDY = 0.095, 0.250, 0.60, 0.05
#: Land-cover codes and their training classes.
CLASS_MAP = {3: 1, 9: 2, 12: 3, 15: 4, 18: 5, 24: 6, 30: 7, 33: 8}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0; null if either is."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a / b)


def select_bands(df: DataFrame, names: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """The bands ``old -> new`` in the given order, after the kept columns."""
    return df.select(*keep, *[F.col(a).alias(b) for a, b in names.items()])


def suffix_bands(df: DataFrame, bands: Sequence[str], suffix: str) -> DataFrame:
    """Bands renamed with a date suffix, other columns as they are."""
    return df.select(*[F.col(c).alias(c + suffix) if c in bands else F.col(c) for c in df.columns])


def composite_bands(df: DataFrame, bands: Sequence[str], keep: Sequence[str] = (), suffix: str = "_median") -> DataFrame:
    """Composite bands by suffix, under their plain names."""
    return df.select(*keep, *[F.col(b + suffix).alias(b) for b in bands])


def scale_factors(df: DataFrame) -> DataFrame:
    """P5: digital numbers of ``SR_B*`` and ``ST_B*`` bands to reflectance and temperature."""
    out = {}
    for c in df.columns:
        if c.startswith("SR_B") or c.startswith("ST_B"):
            scale, offset = OPTICAL if c.startswith("SR_B") else THERMAL
            out[c] = F.col(c) * scale + offset
    return df.withColumns(out) if out else df


def reflectance(df: DataFrame, bands: Sequence[str] = BANDS, by: float = 1000.0) -> DataFrame:
    """Bands divided by a constant."""
    return df.withColumns({b: F.col(b) / by for b in bands})


def unmixing_matrix() -> dict[str, list[float]]:
    """Least-squares weights of each band for each fraction."""
    e = np.array(list(ENDMEMBERS.values())).T
    return dict(zip(ENDMEMBERS, np.linalg.pinv(e).tolist()))


def unmix(df: DataFrame, bands: Sequence[str] = BANDS, by: float = 1000.0) -> DataFrame:
    """``gv``, ``npv``, ``soil``, ``cloud`` by unconstrained least squares, floored at 0."""
    out = {}
    for name, weights in unmixing_matrix().items():
        total = F.lit(0.0)
        for b, w in zip(bands, weights):
            total = total + F.col(b) / by * w
        out[name] = F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))
    return df.withColumns(out)


def shade(byte: bool = False) -> Column:
    """|gv + npv + soil - 1|; ``byte`` truncates to a whole number."""
    s = F.abs(F.col("gv") + F.col("npv") + F.col("soil") - 1)
    return s.cast("byte").cast("double") if byte else s


def gvs() -> Column:
    """Shade-corrected green vegetation."""
    return ratio(F.col("gv"), F.col("gv") + F.col("npv") + F.col("soil"))


def ndfi() -> Column:
    """Normalised difference fraction index."""
    rest = F.col("npv") + F.col("soil")
    return ratio(gvs() - rest, gvs() + rest)


def csfi() -> Column:
    """P10: (gv - shade) / (gv + shade)."""
    return ratio(F.col("gv") - shade(), F.col("gv") + shade())


def normalized_difference(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (a + b)."""
    return ratio(_c(a) - _c(b), _c(a) + _c(b))


def date_difference(band: str, later: str = "_t1", earlier: str = "_t0") -> Column:
    """Later less earlier."""
    return F.col(band + later) - F.col(band + earlier)


def change_class(diff: Column, before: Column) -> Column:
    """1 stable, 2 logging, 3 deforestation, 4 regrowth, else 0; null outside former forest. The first rule that holds wins."""
    kind = (
        F.when((diff >= -STABLE) & (diff <= STABLE), 1)
        .when((diff >= -CLEARED) & (diff <= -STABLE), 2)
        .when(diff <= -CLEARED, 3)
        .when(diff >= STABLE, 4)
        .otherwise(0)
    )
    return F.when((before > FOREST) & diff.isNotNull(), kind)


def logging_label(diff: Column, cloud: Column) -> Column:
    """1 where the loss is that of logging and the later date is clear, else 0."""
    return F.when(diff.isNull(), None).when(F.coalesce(cloud > CLOUDY, F.lit(False)), 0).otherwise(((diff >= -CLEARED) & (diff <= -STABLE)).cast("int"))


def remap(df: DataFrame, column: str, table: dict[int, int] | None = None, default: int = 0, out: str = "label") -> DataFrame:
    """Class codes by a paired list, others to ``default``; null stays null."""
    pairs = df.sparkSession.createDataFrame(list((table or CLASS_MAP).items()), "__from int, __to int")
    joined = df.join(F.broadcast(pairs), F.col(column) == F.col("__from"), "left")
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("__to", F.lit(default)))).drop("__from", "__to")


def is_class(column: str | Column, codes: Sequence[int] = (3, 6)) -> Column:
    """Membership in a set of class codes."""
    return _c(column).isin(*codes)


def at_least(column: str | Column, bound: float, strict: bool = False) -> Column:
    """1 where the value reaches (or, strictly, exceeds) the bound, else 0."""
    return ((_c(column) > bound) if strict else (_c(column) >= bound)).cast("int")


def overwrite(column: str | Column, condition: Column, value) -> Column:
    """``value`` where the condition holds; a null condition or value leaves a masked pixel masked."""
    c = _c(column)
    return F.when(c.isNotNull() & condition, F.lit(value)).otherwise(c)


def mask(column: str | Column, keep: Column) -> Column:
    """Null where ``keep`` is not true."""
    return F.when(keep, _c(column))


def self_mask(column: str | Column) -> Column:
    """Null where the value is 0."""
    return F.when(_c(column) != 0, _c(column))


def unmask(column: str | Column, value=0) -> Column:
    """P20: a constant for masked pixels."""
    return F.coalesce(_c(column), F.lit(value))


def bit_set(column: str | Column, bit: int) -> Column:
    """Whether a quality bit is set."""
    return _c(column).bitwiseAND(1 << bit) != 0


def clean(column: str | Column) -> Column:
    """0 for NaN and infinities."""
    c = _c(column)
    return F.when(F.isnan(c) | c.isin(math.inf, -math.inf), F.lit(0.0)).otherwise(c)


def flip_binary(column: str | Column) -> Column:
    """1 - label."""
    return 1 - _c(column)


def one_hot(label: Column, depth: int) -> Column:
    """Array of 0 and 1; a label out of range gives zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: F.coalesce((k == label).cast("int"), F.lit(0)))


def brightness(column: str | Column, factor: float = 1.5) -> Column:
    """Scaled and clipped to 0..1."""
    c = _c(column)
    return F.when(c.isNotNull(), F.least(F.greatest(c * factor, F.lit(0.0)), F.lit(1.0)))


def min_max(column: str | Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low), 0 for a constant."""
    return ratio(_c(column) - low, high - low)


def percent(column: str | Column) -> Column:
    """Whole percent, cut off toward zero."""
    return (_c(column) * 100).cast("int")


def arg_max(probabilities: str | Column) -> Column:
    """Index of the first largest probability."""
    p = _c(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
