"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and the key's number of ``rows`` in ``count``.

    A key with more than ``1 / share`` of all ``total`` rows is cut into parts of about that size, by a hash
    of the row, and its row of ``table`` is copied to each. There are at most ``share`` such keys and twice
    as many copies; what is broadcast is a number for each such key.
    """
    parts = F.ceil(F.col(count) * share / max(total, 1)).cast("int")
    large = table.where(parts > 1).select(key, parts.alias("__parts"))
    marked = rows.join(F.broadcast(large), key, "left")
    part = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*[c for c in rows.columns if c != key], F.lit(0)), F.col("__parts"))).otherwise(0)
    marked = marked.withColumn("__part", part.cast("int")).drop("__parts")
    copied = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return marked.join(copied, [key, "__part"]).drop("__part")
