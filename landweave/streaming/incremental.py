"""Processing of newly arrived scenes with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from landweave.storage import discard, exists, materialize


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 64) -> DataFrame:
    """ST1: a stream of scenes from Parquet files as they appear, however late they are."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _run_name(checkpoint: str) -> str:
    """Batches count from 0 for every checkpoint; those of different ones are told apart."""
    return uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex


def _finish(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").parquet(path)


def take(batch: DataFrame, number: int, step: Callable[[DataFrame], DataFrame], out: str, finished: str, run: str, key: str = "image_id") -> None:
    """Run ``step`` on the scenes of a batch that no other batch has finished, each once, then note them as finished.

    The output and the note are folders of the batch. A batch that is run again, because it broke off before,
    between or after the two, finds its own note of no account and replaces both.
    """
    spark = batch.sparkSession
    # Rows that repeat an id in one batch: the first by all columns.
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("__first")).select("__first.*")
    if exists(spark, finished):
        done = spark.read.schema(StructType([batch.schema[key]]).add("run", "string").add("batch", "long")).parquet(finished)
        done = done.where((F.col("run") != run) | (F.col("batch") != number))
        first = first.join(done.select(key), key, "left_anti")
    # Whole before it is used twice: what is processed is what is noted.
    new = materialize(first.select(*batch.columns))
    step(new).write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")
    _finish(new.select(key), f"{finished}/run={run}/batch={number}")
    discard(new)


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "image_id", finished: str | None = None) -> StreamingQuery:
    """ST1, J4: run what has arrived since the last run and stop.

    What is finished decides, not time: a scene is skipped if its id is in the table of finished scenes
    (``finished``, by default beside ``out``), and taken otherwise, months after newer ones too. Ids are all
    that is kept, and no state grows in memory. Scenes without an id are left out. ``step`` gets a batch of
    new scenes and may give any rows for them, none too.
    """
    notes, run = finished or f"{out.rstrip('/')}_finished", _run_name(checkpoint)
    return stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, step, out, notes, run, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(rows: DataFrame, time: str = "ts", length: str = "30 days", late: str = "7 days", keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """ST2: scenes counted by time window and tile; the same call on a stream drops state once the watermark passes."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    counted = marked.groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("scenes"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "scenes")
