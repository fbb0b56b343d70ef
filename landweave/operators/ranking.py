"""Dense numbering and running sums of large tables without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.storage import materialize


def running_sum(df: DataFrame, order: Sequence[str], weight: Column, name: str) -> tuple[DataFrame, int]:
    """``df`` with the sum of a whole-number weight up to and including each row of a total order, and the sum of all.

    Range partitions are summed each by itself; their sums, one number a partition, give the offsets.
    """
    ranged = materialize(df.withColumn("__w", weight.cast("long")).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("__p").agg(F.sum("__w").alias("w")).orderBy("__p").collect():
        offsets.append((r["__p"], before))
        before += r["w"] or 0
    table = df.sparkSession.createDataFrame(offsets, "__p int, __b long")
    own = F.sum("__w").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.withColumn("__r", own).join(F.broadcast(table), "__p").withColumn(name, F.col("__r") + F.col("__b"))
    return summed.drop("__p", "__r", "__b", "__w"), before


def number_rows(df: DataFrame, order: Sequence[str], name: str = "n", start: int = 1) -> DataFrame:
    """Rows numbered ``start``, ``start + 1``, ... by a total order."""
    return counted_rows(df, order, name, start)[0]


def counted_rows(df: DataFrame, order: Sequence[str], name: str = "n", start: int = 1) -> tuple[DataFrame, int]:
    """:func:`number_rows`, and the number of rows."""
    numbered, count = running_sum(df, order, F.lit(1), name)
    return (numbered.withColumn(name, F.col(name) + (start - 1)) if start != 1 else numbered), count
