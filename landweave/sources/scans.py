"""Scans with pruned columns and pushed filters, and writes keyed by partition columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.functions.geo import pixel_to_map


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SC1: ``path, length, modified`` of files by pattern; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_year(grid: DataFrame, year: int, col: str = "year") -> DataFrame:
    """SC2: one year of a grid table; a partition column prunes the files."""
    return grid.where(F.col(col) == year)


def scan_scenes(scenes: DataFrame, start, end, most_cloud: float, box: tuple | None = None, date: str = "acq_date", cloud: str = "cloud_pct") -> DataFrame:
    """SC3, F1, F2, F3: scenes of [start, end) with at most some cloud, overlapping a box."""
    out = scenes.where((F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end)) & (F.col(cloud) <= most_cloud))
    return out.where(overlaps(box)) if box else out


def overlaps(box: tuple, names: Sequence[str] = ("minx", "miny", "maxx", "maxy")) -> Column:
    """whether a row's box and a given one share area or an edge."""
    x0, y0, x1, y1 = (F.col(n) for n in names)
    return (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])


def scan_features(features: DataFrame, **equal) -> DataFrame:
    """SC4, F4: features by attribute equality or membership."""
    for name, value in equal.items():
        features = features.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return features


def complete_chips(chips: DataFrame, size: int, data: str = "data") -> DataFrame:
    """SC5, F6, F10: chips that were fetched and have the expected number of values."""
    return chips.where(F.col(data).isNotNull() & (F.size(data) == size))


def band_array(bands: Sequence[str]) -> Column:
    """SC8: bands of a pixel as one array."""
    return F.array(*[F.col(b) for b in bands])


def property_list(df: DataFrame, columns: Sequence[str], order: str, most: int = 100_000) -> DataFrame:
    """SC9: one row with each column's values as a list, in order; a table of more than ``most`` rows is an error, as its list would be one task's."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: keep them as a table")
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    field = lambda c: lambda x: x[c]
    return df.agg(rows.alias("r")).select(*[F.transform("r", field(c)).alias(c) for c in columns])


def constant(df: DataFrame, value=1, name: str = "constant") -> DataFrame:
    """SC11, P32: a constant band on all pixels of a region."""
    return df.withColumn(name, F.lit(value))


def clip(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """pixels of [first, last) rows and columns."""
    return pixels.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def drop_background(df: DataFrame, ids: str = "id", background: int = 0) -> DataFrame:
    """F8: rows of real objects."""
    return df.where(F.col(ids) != background)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def skip_take(df: DataFrame, order: Sequence[str], skip: int, take: int) -> DataFrame:
    """L2, L3: rows after the first ``skip`` of a total order."""
    return df.orderBy(*order).offset(skip).limit(take)


def scenes_by_id(scenes: DataFrame, wanted: DataFrame, key: str = "scene_id") -> DataFrame:
    """the scenes of the ids in ``wanted``; an id without a scene gives no row, a repeated one gives one.

    Repeated ids are dropped before they move, as a few that repeat a million times would all meet in a few tasks.
    """
    return scenes.join(wanted.select(key).distinct(), key, "left_semi")


def map_images(pixels: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UD2: functions of images applied to a whole collection, one after the other; they are column expressions, so one pass does all."""
    for step in steps:
        pixels = pixels.transform(step)
    return pixels


def write_tiles(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """SK1, SK5: one Parquet table partitioned by its keys; a run replaces the partitions that it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_mosaic(pixels: DataFrame, path: str, transform: tuple[float, float, float, float], keys: Sequence[str]) -> None:
    """SK2: a mosaic in one partitioned write, and its transform (pixel width, left, pixel height, top) as a table beside it."""
    write_tiles(pixels, f"{path}/pixels", keys)
    pixels.sparkSession.createDataFrame([transform], "a double, c double, e double, f double").write.mode("overwrite").parquet(f"{path}/transform")


def read_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of :func:`write_mosaic` with ``x``, ``y``, their map coordinates by the transform that was written."""
    t = spark.read.parquet(f"{path}/transform")
    x, y = pixel_to_map(*[F.col(f"__t.{n}") for n in "acef"], F.col("row"), F.col("col"))
    return spark.read.parquet(f"{path}/pixels").crossJoin(F.broadcast(t.select(F.struct("*").alias("__t")).limit(1))).withColumns({"x": x, "y": y}).drop("__t")


def append_records(records: DataFrame, path: str, split: str = "split") -> None:
    """SK3: records added to the files of their split; earlier ones stay."""
    records.write.mode("append").partitionBy(split).parquet(path)


def place_by_split(items: DataFrame, splits: DataFrame, path: str, key: str = "id", split: str = "split") -> None:
    """SK8, Q16: items copied into a directory for each split; the source is left as it is, and items without a split stay behind."""
    write_tiles(items.join(splits.select(key, split), key), path, [split])


def write_points(df: DataFrame, path: str, after: int, index: str = "idx") -> None:
    """SK6: the points after an index replace the table."""
    df.where(F.col(index) > after).write.mode("overwrite").parquet(path)


def append_metrics(df: DataFrame, path: str, sep: str = ";") -> None:
    """SK7: one line a row, appended."""
    df.write.mode("append").option("sep", sep).option("header", "false").csv(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """SK9, SK10: a new dataset version; earlier ones stay as they are."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
