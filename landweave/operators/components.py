"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.storage import discard, materialize

#: Edge tables of up to so many rows (16 bytes each) are solved by one task.
FEW = 1 << 20


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _solved(batches):
    """``node``, ``component`` of all edges at once, by pulling down labels and halving paths."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    ends = np.concatenate([np.array(p, np.int64) for p in parts], axis=1) if parts else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        # The roots of both ends go down too, which joins whole trees at a time.
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            break
        label = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW) -> DataFrame:
    """``node``, ``component`` (the smallest node of its component) for every node of an edge.

    Ends are longs. Up to ``few`` distinct edges, counted first, are solved in one task. Beyond that, each round points a node's larger neighbours at the smallest one (large star), then the rest (small
    star). Rounds grow with the logarithm of the longest path. Self links and null ends are ignored;
    repeated edges do no harm. Each round is written to shared disk and the one before it deleted.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    current = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(current)
    if before[0] <= few:
        out = materialize(current.coalesce(1).mapInArrow(_solved, "node long, component long"))
        discard(current)
        return out
    for _ in range(rounds):
        ends = current.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e")).select("e.*")
        least = ends.groupBy("n").agg(F.min("m").alias("m")).select(F.col("n").alias("v"), F.least("n", "m").alias("m"))
        large = current.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(pairs.where("u <> v").distinct())
        after = _signature(new)
        discard(current)
        current = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
