"""Datasets whose versions are switched in one step.

Data files are never changed. A version is a small file, its manifest, that names the folder of every
bucket of keys and the schema; its number is its name, and it appears by one rename, which fails if
another writer took the number. A reader reads the newest manifest and then only what it names, so that it
sees one whole version whatever is being written, and a write that ends early leaves no version at all.

Rows are dealt to buckets by a hash of their keys. An upsert writes the buckets that it touches anew and
names the folders of the others again.

Cases: null keys are keys like others; of upserted rows that repeat a key all stay; an empty table is a
version without buckets; a version number that does not exist is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landweave.storage import discard, exists, materialize

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer committed first; what was written is no version."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list:
    where, fs = _files(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, ascending."""
    names = [s.getPath().getName() for s in _listed(spark, f"{root}/manifests")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The manifest of a version, the newest if none is given; None where there is no version yet."""
    have = numbers(spark, root)
    if number is None and not have:
        return None
    if number is not None and number not in have:
        raise ValueError(f"no version {number}")
    where, fs = _files(spark, f"{root}/manifests/{number or have[-1]}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, entry: dict) -> int:
    """Make a manifest visible under its number, in one step."""
    hidden, fs = _files(spark, f"{root}/manifests/_{uuid.uuid4().hex}")
    final, _ = _files(spark, f"{root}/manifests/{entry['number']}.json")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    finally:
        stream.close()
    # Local file systems rename onto a file that is there.
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise Conflict(f"version {entry['number']} is there")
    return entry["number"]


def _written(rows: DataFrame, root: str, keys: Sequence[str], buckets: int) -> dict[str, str]:
    """Folder by bucket of rows newly written."""
    folder = f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    names = [s.getPath().getName() for s in _listed(rows.sparkSession, f"{root}/{folder}")]
    return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def replace(rows: DataFrame, root: str, keys: Sequence[str], buckets: int = 64) -> int:
    """SK9, SK10: ``rows`` as the next version, whatever the one before held; returns its number."""
    spark, before = rows.sparkSession, manifest(rows.sparkSession, root)
    entry = {"number": before["number"] + 1 if before else 1, "keys": list(keys), "buckets": buckets, "schema": rows.schema.json()}
    return _commit(spark, root, entry | {"folders": _written(rows, root, keys, buckets)})


def upsert(rows: DataFrame, root: str) -> int:
    """SK4: the next version is the newest one with rows of equal keys replaced and new ones added.

    Only buckets with a key in ``rows`` are read and written.
    """
    spark, before = rows.sparkSession, manifest(rows.sparkSession, root)
    if before is None:
        raise ValueError("there is no version to change")
    keys = before["keys"]
    rows = materialize(rows.select(StructType.fromJson(json.loads(before["schema"])).names))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(before["buckets"])).cast("string")
    touched = {r[0] for r in rows.select(bucket).distinct().collect()}
    old = _of(spark, root, before, [f for b, f in before["folders"].items() if b in touched])
    new_keys = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(new_keys[f"__{k}"]) for k in keys])
    folders = _written(old.join(new_keys, same, "left_anti").unionByName(rows), root, keys, before["buckets"])
    discard(rows)
    return _commit(spark, root, before | {"number": before["number"] + 1, "folders": before["folders"] | folders})


def _of(spark: SparkSession, root: str, entry: dict, folders: Sequence[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in sorted(folders)]) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or one by number, as it was committed."""
    entry = manifest(spark, root, number)
    if entry is None:
        raise ValueError("there is no version yet")
    return _of(spark, root, entry, list(entry["folders"].values()))


def drop_old(spark: SparkSession, root: str, keep: int = 1, hours: float = 24.0) -> None:
    """SK9: versions but the newest ``keep`` go, with the folders that only they name.

    Folders that no version names may belong to a write that is under way; they go once they are ``hours`` old.
    """
    have = numbers(spark, root)
    gone, kept = have[: max(len(have) - keep, 0)], have[max(len(have) - keep, 0) :]
    entries = {n: manifest(spark, root, n) for n in have}
    live = {f for n in kept for f in entries[n]["folders"].values()}
    dead = {f for n in gone for f in entries[n]["folders"].values()} - live
    # Manifests first: a version that can be found has its files.
    for path in [f"manifests/{n}.json" for n in gone] + sorted(dead):
        where, fs = _files(spark, f"{root}/{path}")
        fs.delete(where, True)
    named = {f.split("/")[1] for f in live}
    for s in _listed(spark, f"{root}/data"):
        parts = any(p.getPath().getName().startswith(BUCKET) for p in _listed(spark, s.getPath().toString()))
        old = s.getModificationTime() / 1000 < time.time() - hours * 3600
        if s.getPath().getName() not in named and (old or not parts and exists(spark, f"{s.getPath()}/_SUCCESS")):
            s.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(s.getPath(), True)
