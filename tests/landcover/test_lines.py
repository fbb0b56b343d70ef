"""Running maxima and distances along lines against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from landweave.operators import lines, neighborhood


def sparse(rng, n, size):
    return [(rng.randrange(2), rng.randrange(size), rng.randrange(size), rng.choice([None, -5, 3, 8, 1 << 40])) for _ in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 4, 25])
def test_focal_max_square(spark, radius):
    rows = sparse(random.Random(radius), 60, 40)
    df = spark.createDataFrame([*rows, (0, None, 3, 1), (0, 3, None, 1)], "k int, row int, col int, v long")
    want = {}
    for k, r, c, v in rows:
        if v is not None:
            for i in range(max(0, r - radius), min(40, r + radius + 1)):
                for j in range(max(0, c - radius), min(40, c + radius + 1)):
                    want[k, i, j] = max(v, want.get((k, i, j), v))
    got = neighborhood.focal_max_square(df, "v", radius, ["k"], (40, 40))
    assert {(r.k, r.row, r.col): r.v for r in got.collect()} == want
    free = neighborhood.focal_max_square(df, "v", radius, ["k"])
    assert {(r.k, r.row, r.col) for r in free.collect()} >= set(want)


@pytest.mark.parametrize("radius", [1, 5, 30])
def test_distances(spark, radius):
    rng = random.Random(radius + 7)
    rows = [(k, rng.randrange(50), rng.randrange(50)) for k in (0, 1) for _ in range(25)]
    rows += rows[:3]
    got = {(r.k, r.row, r.col): r.distance for r in neighborhood.distances(spark.createDataFrame(rows, "k int, row int, col int"), radius, ["k"], (50, 50)).collect()}
    want = {}
    for k in (0, 1):
        own = np.array(sorted({(r, c) for q, r, c in rows if q == k}))
        for i in range(50):
            for j in range(50):
                square = int(((own - (i, j)) ** 2).sum(1).min())
                if square <= radius * radius:
                    want[k, i, j] = square**0.5
    assert got == want
    near = neighborhood.near_but_not(spark.createDataFrame(rows, "k int, row int, col int"), radius, ["k"], (50, 50))
    assert near.count() == sum(d > 0 for d in want.values())


def test_work_does_not_depend_on_the_radius(spark):
    """Plans move pixels and places once for each pass and explode nothing; a pixel's places are made once."""
    df = spark.createDataFrame([(r, c, 1) for r in range(0, 60, 2) for c in range(60)], "row int, col int, v int")
    for result in (neighborhood.focal_max_square(df, "v", 20), neighborhood.near_but_not(df, 20)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
    new, at = np.array([True, False, False, True]), np.array([3, 5, 90, 4])
    places = sum(len(p) for _, p, _ in lines.nearest(20)(new, at, None))
    # Each of three islands: 2 x 20 more places than it spans.
    assert places == 43 + 41 + 41


def test_lines_over_batches():
    """A line may be cut by batches anywhere, nulls and texts among the keys."""
    rng = random.Random(4)
    keys = [k for k in ("a", "b", None, "c") for _ in range(rng.randrange(1, 9))]
    whole = pa.record_batch([pa.array(keys), pa.array([7] * len(keys)), pa.array(range(len(keys)))], names=["k", "q", "p"])
    for _ in range(50):
        cuts = sorted({0, len(keys), *[rng.randrange(len(keys)) for _ in range(rng.randrange(9))]})
        parts = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])] + [whole.slice(0, 0)]
        got = []
        for b, new in lines._whole_lines(parts, 2):
            assert new[0]
            got += list(zip(np.cumsum(new).tolist(), b.column(0).to_pylist(), b.column(2).to_pylist()))
            ends = [i for i, n in enumerate(new) if n] + [len(new)]
            for lo, hi in zip(ends, ends[1:]):
                own = b.slice(lo, hi - lo)
                assert len(set(own.column(0).to_pylist())) == 1 and own.num_rows == keys.count(own.column(0)[0].as_py())
        assert [g[2] for g in got] == list(range(len(keys)))


def test_types_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (5, 5, float("-inf"))], "row int, col int, v float")
    got = neighborhood.focal_max_square(df, "v", 1)
    assert got.schema["v"].dataType.simpleString() == "float"
    by = {(r.row, r.col): r.v for r in got.collect()}
    assert by[1, 0] == 0.5 and np.isnan(by[1, 1]) and by[6, 6] == float("-inf")
    assert neighborhood.focal_max_square(df.limit(0), "v", 3).count() == neighborhood.distances(df.limit(0), 3).count() == 0
