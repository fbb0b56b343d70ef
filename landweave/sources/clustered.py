"""Pixel tables laid out along a Morton curve, with a zone map that is read before any file.

Rows and columns of tiles are interleaved bit by bit, so that neighbours in the plane are near each other
in the order of the files, and each file is a compact patch of the grid. The zone map holds the smallest
and largest row, column and date of every file; a window opens the files whose zones it meets, and no
others are listed or touched.

Cases: rows with a null row, column or date lie in no window and are left out of the files; an empty table
has no files and every window of it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    """The 31 bits of a whole number with a gap after each."""
    x = x.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in _STEPS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column, tile: int = 1) -> Column:
    """Place on the Morton curve of the tile that holds a pixel, from 0."""
    return F.shiftleft(_spread(F.floor(row / tile)), 1).bitwiseOR(_spread(F.floor(col / tile)))


def write_clustered(pixels: DataFrame, path: str, files: int, tile: int = 64, date: str = "year") -> None:
    """SK1, SC3: ``pixels`` in about ``files`` files along the curve, each in order of tile and date, and their zone map."""
    spark = pixels.sparkSession
    real = pixels.where(F.col("row").isNotNull() & F.col("col").isNotNull() & F.col(date).isNotNull()).withColumn("__m", morton(F.col("row"), F.col("col"), tile))
    real.repartitionByRange(files, "__m").sortWithinPartitions("__m", date, "row", "col").drop("__m").write.mode("overwrite").parquet(f"{path}/pixels")
    ends = [f(c).alias(f"{n}_{c}") for c in ("row", "col", date) for n, f in (("min", F.min), ("max", F.max))]
    written = spark.read.schema(pixels.schema).parquet(f"{path}/pixels")
    zones = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), *ends)
    zones.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")


def read_window(spark: SparkSession, path: str, schema: StructType, rows: tuple[int, int], cols: tuple[int, int], dates: tuple | None = None, date: str = "year") -> DataFrame:
    """SC7, J8: pixels with ``rows[0] <= row < rows[1]`` and so on, from the files whose zones meet the window.

    What is collected is a name for each such file, of which a window of bounded size meets few.
    """
    inside = lambda low, high, c: (F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") < high)
    meets, exact = inside(*rows, "row") & inside(*cols, "col"), (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    if dates is not None:
        meets, exact = meets & inside(*dates, date), exact & (F.col(date) >= dates[0]) & (F.col(date) < dates[1])
    names = [r.file for r in spark.read.parquet(f"{path}/zones").where(meets).select("file").collect()]
    return spark.read.schema(schema).parquet(*[f"{path}/pixels/{n}" for n in sorted(names)]).where(exact) if names else spark.createDataFrame([], schema)
