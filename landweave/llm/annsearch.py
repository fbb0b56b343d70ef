"""Approximate nearest neighbours by collision-counting hashing.

Every projection of a block's vectors on a random direction is one sorted array. A query's window on each
array starts around its own projection and widens (virtual rehashing: a wider window is a union of hash
buckets, nothing is hashed again; growth is 1.1 a step, not 2, to stop soon after enough). A window is a
run of ranks, and each array on which a vector's rank lies in it counts one collision of the vector.
Windows stop once ``enough`` vectors of the block collide on four fifths of the projections; the
collision threshold is then the greatest that as many reach, and all that reach it are verified with
their true inner product. ``enough`` is ``least`` (12 k) vectors, or one in ``share`` of a larger block.

Windows grow over most of a block before enough vectors collide, so collisions are counted array by array
for all vectors at once, by rank in 256 buckets: windows taken to whole buckets give a few vectors more
than collide enough, and these alone are counted by exact rank. The step at which a query before stopped
is tried first; as windows of a step hold those of the step before, the first step with enough is then
found from either side, and is the same whichever was tried.

Largest inner product becomes nearest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm of the block; a query's is 0. Blocks hold vectors whose norms differ by at most a factor of
``RATIO``, so that this coordinate stays small however uneven the norms of the table are. The index is
all rows, in blocks of at most ``block`` vectors, one row each; the queries come in far smaller rows,
which go to every block and follow it in its task. A task holds one block with its arrays and one row of
queries whatever the input. Every query starts from the same width, which a few vectors of the block, as
queries, determine, so that its answer does not depend on the queries before it.

Cases: vectors that are null, empty, zero, of another length than most (they have no inner product with the rest), or with null or non-finite
components take no part, as query or candidate; equal vectors are all candidates together and ties go
to the smaller id; fewer candidates than ``k`` give fewer rows; an empty table gives an empty result.
Ids are taken to be distinct; a query never returns its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.storage import materialize

LEAST_PROJECTIONS, THRESHOLD, GROWTH, RATIO, PROBES = 128, 0.8, 1.1, 1.1, 8


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _directions(dim: int) -> np.ndarray:
    """Random orthonormal bases side by side: directions that repeat nothing within a basis."""
    rng, d = np.random.default_rng(dim), dim + 1
    bases = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-LEAST_PROJECTIONS // d))]
    return np.concatenate(bases, axis=1)


def _extended(x: np.ndarray, query: bool) -> np.ndarray:
    norm = (x * x).sum(1)
    more = np.zeros(len(x)) if query else np.sqrt(norm.max() - norm)
    return np.column_stack([x, more])


def _packed(batches):
    """(block, id, vec) rows sorted by block to one row a block: ids and vectors."""

    def one(block, ids, vecs):
        x, ids = np.concatenate(vecs), np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())], names=["block", "ids", "vecs"])

    now, ids, vecs = None, [], []
    for b in batches:
        block, i = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for lo, hi in zip(edge, np.r_[edge[1:], len(block)].astype(int)):
            if block[lo] != now and ids:
                yield one(now, ids, vecs)
                ids, vecs = [], []
            now = block[lo]
            ids.append(i[lo:hi])
            vecs.append(x[lo:hi])
    if ids:
        yield one(now, ids, vecs)


class Arrays:
    """Sorted projections of the vectors of one block, and the rank of every vector in each of them, exactly and by bucket."""

    def __init__(self, x: np.ndarray, enough: int):
        self.n, self.directions = len(x), _directions(x.shape[1])
        y = np.ascontiguousarray((_extended(x, False) @ self.directions).T)
        order = np.argsort(y, axis=1)
        self.sorted = np.take_along_axis(y, order, 1)
        self.enough, self.need = min(enough, self.n), int(np.ceil(THRESHOLD * len(y)))
        self.rank_kind, self.count_kind = np.min_scalar_type(self.n), np.min_scalar_type(len(y))
        rank = np.empty(order.shape, self.rank_kind)
        np.put_along_axis(rank, order, np.arange(self.n, dtype=self.rank_kind)[None], 1)
        self.bits = max(0, (self.n - 1).bit_length() - 8)
        self.bucket, self.rank = (rank >> self.bits).astype(np.uint8), np.ascontiguousarray(rank.T)
        self.inside = np.empty_like(self.bucket)
        half = 0.5 * float(np.median(self.sorted[:, int(0.75 * (self.n - 1))] - self.sorted[:, int(0.25 * (self.n - 1))]))
        self.widths = [max(half, 1e-6 * float(np.abs(y).max()))]
        probes = Windows(self, _extended(x[:: max(1, self.n // PROBES)][:PROBES], True))
        self.widths = [min(self.widths[self.collide(probes, j)[1]] for j in range(len(probes.q))) / GROWTH]

    def width(self, step: int) -> float:
        while len(self.widths) <= step:
            self.widths.append(self.widths[-1] * GROWTH)
        return self.widths[step]

    def near(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The vectors that lie in the windows on enough arrays, and a few more: windows are taken to whole buckets."""
        lo, size = lo.astype(np.int64), size.astype(np.int64)
        first = np.minimum(lo, self.n - 1) >> self.bits
        last = np.maximum((lo + size - 1) >> self.bits, first)
        np.subtract(self.bucket, first.astype(np.uint8)[:, None], out=self.inside)
        np.less_equal(self.inside, (last - first).astype(np.uint8)[:, None], out=self.inside.view(bool))
        return np.flatnonzero(np.add.reduce(self.inside, axis=0, dtype=self.count_kind) >= self.need)

    def counted(self, rank: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """On how many arrays vectors lie in the windows, by their ranks."""
        inside = (rank - lo) < size
        return np.add.reduce(inside.view(np.uint8), axis=1, dtype=self.count_kind)

    def collide(self, windows: Windows, j: int, guess: int = 0) -> tuple[np.ndarray, int]:
        """Vectors to verify for a query, and the first step at which windows hold enough; the step tried first changes neither."""
        step, down = guess, True
        while True:
            at = windows.at(step, j)
            which = self.near(*at)
            rank = self.rank.take(which, axis=0)
            count = self.counted(rank, *at)
            if (count >= self.need).sum() >= self.enough:
                break
            step, down = step + 1, False
        # Vectors that collide enough in smaller windows do so in these.
        while down and step:
            less = self.counted(rank, *windows.at(step - 1, j))
            if (less >= self.need).sum() < self.enough:
                break
            held = less >= self.need
            which, rank, count, step = which[held], rank[held], less[held], step - 1
        least = np.partition(count, len(count) - self.enough)[len(count) - self.enough]
        return which[count >= least], step


class Windows:
    """Windows of a row of queries on every array of a block, by step; those of a step are looked up for all its queries at once."""

    def __init__(self, arrays: Arrays, extended: np.ndarray):
        self.arrays, self.q, self.steps = arrays, extended @ arrays.directions, {}

    def at(self, step: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """First rank in each window of query ``j``, and the number of ranks."""
        if step not in self.steps:
            width, lo = self.arrays.width(step), np.empty(self.q.shape, self.arrays.rank_kind)
            size = np.empty_like(lo)
            for i, y in enumerate(self.arrays.sorted):
                order = np.argsort(self.q[:, i])
                low, high = (np.searchsorted(y, self.q[order, i] + w) for w in (-width, width))
                lo[order, i], size[order, i] = low, high - low
            self.steps[step] = lo, size
        lo, size = self.steps[step]
        return lo[j], size[j]


def _searched(k: int, least: int, share: int, dim: int, kind: str):
    """Rows of queries that follow the row of their block (``query`` false), answered."""

    def run(batches):
        arrays, ids, x = None, None, None
        for b in batches:
            for query, row_ids, vecs in zip(*(b.column(i) for i in (1, 2, 3))):
                own = np.frombuffer(row_ids.as_py(), np.int64)
                q = np.frombuffer(vecs.as_py(), kind).reshape(-1, dim).astype(np.float64)
                if not query.as_py():
                    ids, x, arrays = own, q, Arrays(q, max(least, len(q) // share))
                    continue
                windows, step = Windows(arrays, _extended(q, True)), 1
                out = [[], [], [], []]
                for j in range(len(own)):
                    # Most queries stop where the one before did.
                    c, step = arrays.collide(windows, j, step)
                    met = len(c)
                    c = c[ids[c] != own[j]]
                    score = (x[c] * q[j]).sum(axis=1)
                    best = np.lexsort((ids[c], -score))[:k]
                    # The number verified goes with the first row.
                    verified = np.zeros(len(best), np.int64)
                    verified[:1] = met
                    for col, v in zip(out, (np.full(len(best), own[j]), ids[c[best]], score[best], verified)):
                        col.append(v)
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score", "verified"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 16384, query_block: int = 512, share: int = 25, least: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best found for every row that meets ``queries``, and ``verified``, the number of vectors that its search verified."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double, verified long"
    element = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast(f"array<{element}>").alias("v"), queries.alias("q"))
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("k")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], empty)
    dim = shape.d
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.where(F.size("v") == dim).withColumn("span", F.coalesce(F.floor(F.log(norm) / (2 * math.log(RATIO))), F.lit(-(1 << 20))).cast("int"))
    # Floating-point norms have a few thousand spans at most.
    spans, blocks = [], 0
    for r in rows.groupBy("span").count().orderBy("span").collect():
        own = -(-r["count"] // block)
        spans.append((r.span, blocks, own))
        blocks += own
    spans = spark.createDataFrame(spans, "span int, begin int, own int")

    def blocked(part: DataFrame, number: Column, count: int) -> DataFrame:
        dealt = part.select(number.cast("int").alias("block"), "i", "v").repartition(count, "block").sortWithinPartitions("block")
        return materialize(dealt.mapInArrow(_packed, "block int, ids binary, vecs binary"))

    index = blocked(rows.join(F.broadcast(spans), "span"), F.col("begin") + F.pmod(F.xxhash64("i"), F.col("own")), blocks)
    parts = max(1, -(-shape.k // query_block))
    asked = blocked(rows.where("q"), F.pmod(F.xxhash64("i"), F.lit(parts)), parts)
    # A stated query set against all rows: a block comes once, its queries' small rows after it, in a task of its own.
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "ids", "vecs")
    both = index.select("block", F.lit(False).alias("query"), "ids", "vecs").unionByName(everywhere).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query")
    kind = "<f4" if element == "float" else "<f8"
    found = both.mapInArrow(_searched(k, least or 12 * k, share, dim, kind), "query_id long, vec_id long, score double, verified long")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("vec_id").alias("vec_id"))))
    best = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"), F.sum("verified").alias("verified"))
    flat = best.select("query_id", F.posexplode("best").alias("at", "x"), "verified")
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"), "verified")


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
