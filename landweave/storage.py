"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Where neither is set, a session whose executors are threads of the driver gets a temporary folder of
    its own; a cluster has no folder that would do, which is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="landweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in a folder for each value of ``by``, and read it back.

    Cuts the lineage, so that a lost executor costs only the tasks that read the table again. The shuffle
    files of the write are dropped at its end, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/landweave-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._landweave_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_landweave_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
