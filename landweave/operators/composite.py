"""Per-pixel and per-region reductions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.functions.bands import min_max
from landweave.operators.overlay import BROADCAST_ROWS
from landweave.storage import discard, materialize


def median(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """G1: median of each band over the scenes of a pixel; masked values do not count."""
    return pixels.groupBy(*keys).agg(*[F.median(b).alias(f"{b}_median") for b in bands])


def total(pixels: DataFrame, value: str | Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Sums over a collection by pixel."""
    return pixels.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in ([value] if isinstance(value, str) else value)])


def region_range(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = (), shared: bool = False) -> DataFrame:
    """Smallest and largest value of each band in a region; ``shared`` takes those of the first band for all."""
    return pixels.groupBy(*keys).agg(*[f(bands[0] if shared else b).alias(f"{b}_{n}") for b in bands for n, f in (("min", F.min), ("max", F.max))])


def normalize_region(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str], shared: bool = False) -> DataFrame:
    """Bands stretched to 0..1 by their region's range."""
    ranged = pixels.join(region_range(pixels, bands, keys, shared), list(keys))
    return ranged.select(*[min_max(c, F.col(f"{c}_min"), F.col(f"{c}_max")).alias(c) if c in bands else F.col(c) for c in pixels.columns])


#: Bins of a power of two, bins of a range, and the number of values of a range that are gathered at most.
OCTAVE, BINS, GATHERED = 256, 4096, 4096


def order_statistics(df: DataFrame, value: str, ranks: Callable[[Column], Sequence[Column]], keys: Sequence[str]) -> DataFrame:
    """``keys, n, rank, v``: of each group's ``n`` values in order, those at some ranks from 0, exactly.

    Successive histograms: first by the logarithm of the value, ``OCTAVE`` bins to a power of two; the bin
    that holds a rank becomes a range, from the smallest to the largest value in it. A range of over
    ``GATHERED`` values that are not all equal has a histogram of ``BINS`` equal bins in turn; the others'
    values are sorted. No value is moved or written but those: each pass reads the input again and shuffles
    counts of bins. A million values take the first histogram, a billion one or two more.

    Null values do not count; NaN is the greatest; groups with null keys are groups; a group without values
    has no rows.
    """
    v, names = F.col("__v"), [f"__{k}" for k in keys]
    values = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v"))
    # Logarithms of doubles lie between -1074 and 1024.
    size_bin = F.floor(F.log2(F.abs(v)) * OCTAVE) + 2000 * OCTAVE
    first_bin = F.when(F.isnan(v), 1 << 30).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 29)).when(v == 0, 0).otherwise(F.signum(v) * size_bin).cast("long")
    counts = F.count(F.lit(1)).alias("size"), F.min(v).alias("lo"), F.max(v).alias("hi")
    place = Window.partitionBy(*names)
    upto = F.sum("size").over(place.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = values.groupBy(*names, first_bin.alias("bin")).agg(*counts).withColumn("n", F.sum("size").over(place)).withColumn("before", upto - F.col("size"))
    ranked = placed.withColumn("rank", F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks(F.col("n"))]))))
    columns = [*names, "n", "rank", "lo", "hi", "before", "size"]
    state = materialize(ranked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))).select(columns))
    single, within = F.col("lo").eqNullSafe(F.col("hi")), (v >= F.col("lo")) & (v <= F.col("hi"))
    unsettled = (F.col("size") > GATHERED) & ~single
    # The number of ranks stays the same from here on.
    rows, left = state.agg(F.count(F.lit(1)), F.count_if(unsettled)).first()
    hint = F.broadcast if rows <= BROADCAST_ROWS else lambda table: table

    def matched(many: DataFrame, few: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        """Rows of both sides with equal keys, null ones too; keys and ``more`` come from the first."""
        shared = (*names, *more)
        renamed = few.select(*[F.col(c).alias(f"{c}__r") if c in shared else F.col(c) for c in few.columns])
        on = reduce(lambda x, y: x & y, [many[c].eqNullSafe(renamed[f"{c}__r"]) for c in shared], F.lit(True))
        return many.join(hint(renamed), on).drop(*[f"{c}__r" for c in shared])

    while left:
        open_ = state.where(unsettled)
        bin_ = F.least(F.floor((v / 2 - F.col("from") / 2) / (F.col("to") / 2 - F.col("from") / 2) * BINS), F.lit(BINS - 1))
        ranges = open_.select(*names, F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        counted = matched(values, ranges).where((v >= F.col("from")) & (v <= F.col("to"))).groupBy(*names, "from", "to", bin_.alias("bin")).agg(*counts)
        # At most BINS rows for each range.
        order = Window.partitionBy(*names, "from", "to").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = matched(counted.withColumn("upto", F.sum("size").over(order)), open_.select(*names, "n", "rank", "before", F.col("lo").alias("from"), F.col("hi").alias("to")), ["from", "to"])
        met = met.withColumn("before", F.col("before") + F.col("upto") - F.col("size")).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
        read, state = state, materialize(state.where(~unsettled).unionByName(met.select(columns)))
        discard(read)
        left = state.where(unsettled).count()
    some = state.where(~single)
    gathered = matched(values, some.select(*names, "lo", "hi").distinct()).where(within).groupBy(*names, "lo", "hi").agg(F.array_sort(F.collect_list(v)).alias("__sorted"))
    found = matched(gathered, some, ["lo", "hi"]).withColumn("v", F.get("__sorted", (F.col("rank") - F.col("before")).cast("int")))
    out = found.select(*names, "n", "rank", "v").unionByName(state.where(single).select(*names, "n", "rank", F.col("lo").alias("v")))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", "rank", "v")


def quantiles(df: DataFrame, value: str, points: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The keys and ``q``, the exact interpolated quantiles of each (large) group; a group without values has none."""
    place = lambda n: [(n - 1) * F.lit(float(p)) for p in points]
    at = order_statistics(df, value, lambda n: [f(h) for h in place(n) for f in (F.floor, F.ceil)], keys)
    found = [F.min(F.when(F.col("rank") == f(h), F.col("v"))).alias(f"__{name}{i}") for i, h in enumerate(place(F.col("n"))) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    got = at.groupBy(*keys, "n").agg(*found)
    between = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (h - F.floor(h)) for i, h in enumerate(place(F.col("n")))]
    return got.select(*keys, F.array(*between).alias("q"))


def region_percentiles(pixels: DataFrame, bands: Sequence[str], points: Sequence[float] = (0.03, 0.98), exact: bool = True) -> DataFrame:
    """Percentiles of each band over a region, exact or approximate; neither gathers the values."""
    names = [(b, i, f"{b}_p{round(p * 100)}") for b in bands for i, p in enumerate(points)]
    if not exact:
        return pixels.agg(*[F.get(F.percentile_approx(F.col(b), F.array(*[F.lit(p) for p in points])), i).alias(name) for b, i, name in names])
    long = pixels.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])).alias("x")).select("x.*")
    q = quantiles(long, "v", points, ["band"])
    return q.agg(*[F.max(F.when(F.col("band") == b, F.get("q", i))).alias(name) for b, i, name in names])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by equal bins, 0 and ``bins + 1`` for what lies outside."""
    b = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, fences at one and a half interquartile ranges, and the number of outliers by group."""
    q = quantiles(df, value, (0.25, 0.5, 0.75), keys)
    q = q.select(*keys, *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    q = q.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = df.join(q, list(keys)).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    return q.join(out.groupBy(*keys).agg(F.count(F.lit(1)).alias("outliers")), list(keys), "left").na.fill(0, ["outliers"])


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, as rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def mosaic(pixels: DataFrame, value: str, order: str, nodata=None, keys: Sequence[str] = ("row", "col"), last: bool = False) -> DataFrame:
    """First (or last) value of a pixel that is not no-data, by an explicit order."""
    real = pixels.where(F.col(value).isNotNull() if nodata is None else F.col(value).isNotNull() & (F.col(value) != nodata))
    return real.groupBy(*keys).agg((F.max_by if last else F.min_by)(value, order).alias(value))


def coarser(pixels: DataFrame, value: str, factor: int, how: str = "mode", keys: Sequence[str] = ()) -> DataFrame:
    """A grid of ``factor`` times larger cells by the most frequent value (ties to the smaller) or the value nearest the cell's middle."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    if how == "mode":
        counted = pixels.where(F.col(value).isNotNull()).groupBy(*keys, *cell, F.col(value).alias(value)).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(*keys, "row", "col").agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))
    middle = (factor - 1) / 2
    away = F.pow(F.col("row") % factor - middle, 2) + F.pow(F.col("col") % factor - middle, 2)
    return pixels.groupBy(*keys, *cell).agg(F.min_by(value, F.struct(away, "row", "col")).alias(value))


def _mode(weighted: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    summed = weighted.groupBy(*keys, "row", "col", value).agg(F.sum("__w").alias("__w"))
    return summed.groupBy(*keys, "row", "col").agg(F.min_by(value, F.struct(-F.col("__w"), value)).alias(value))


def regrid(pixels: DataFrame, value: str, ratio: Fraction | float | str, how: str = "mode", keys: Sequence[str] = (), origin: tuple[Fraction | float | str, Fraction | float | str] = (0, 0)) -> DataFrame:
    """A grid whose cells are ``ratio`` source cells wide and begin at ``origin`` (row, col), by area of overlap.

    The value with the largest area wins (ties: the smaller value), or the mean weighs by area. Ratio and
    origin are taken as decimal fractions and areas counted in units of their denominators, whole numbers
    that add up exactly. A source pixel meets one more cell than it is cells wide in each direction, at most.
    Null values and cells that none meets are left out.
    """
    p, starts = Fraction(str(ratio)), [Fraction(str(o)) for o in origin]
    if p <= 0 or how not in ("mode", "mean"):
        raise ValueError("a ratio above 0, and mode or mean")
    rows, weight = pixels.where(F.col(value).isNotNull()).select(*keys, "row", "col", value), F.lit(1).cast("long")
    for c, start in zip(("row", "col"), starts):
        unit = p.denominator * start.denominator
        wide, shift = int(p * unit), int(start * unit)
        low = F.col(c).cast("long") * unit - shift
        rows = rows.withColumn("__low", low).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__low") / wide), F.floor((F.col("__low") + (unit - 1)) / wide))))
        part = F.least(F.col("__low") + unit, (F.col("__cell") + 1) * wide) - F.greatest(F.col("__low"), F.col("__cell") * wide)
        rows = rows.withColumn(f"__w{c}", part).drop(c).withColumnRenamed("__cell", c).drop("__low")
        weight = weight * F.col(f"__w{c}")
    weighted = rows.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value, weight.alias("__w"))
    if how == "mode":
        return _mode(weighted, value, keys)
    return weighted.groupBy(*keys, "row", "col").agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias(value))


def overviews(pixels: DataFrame, value: str, levels: int, how: str = "mode", keys: Sequence[str] = ()) -> DataFrame:
    """``level, row, col, value`` of grids of 2, 4, 8 ... times larger cells, each made from the one before.

    Every level but the last is written once, so that all levels cost a third more than the first alone.
    """
    out, now = None, pixels.select(*keys, "row", "col", value)
    for level in range(1, levels + 1):
        now = regrid(now, value, 2, how, keys)
        now = materialize(now) if level < levels else now
        one = now.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out
