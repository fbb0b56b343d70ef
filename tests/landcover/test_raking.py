"""Sample sizes that bring class shares to their targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.operators import raking


def chips(spark, n, classes, seed):
    """Shares of one to three classes in each chip."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        own = rng.choice(classes, rng.integers(1, min(4, len(classes) + 1)), replace=False)
        part = rng.dirichlet(np.ones(len(own)))
        rows += [(i, int(c), float(p)) for c, p in zip(own, part)]
    return spark.createDataFrame(rows, "chip_id long, class int, share double")


def test_targets_are_met_within_a_sample(spark):
    shares = chips(spark, 3000, [3, 9, 15, 30], 1)
    targets = {3: 0.45, 9: 0.25, 15: 0.2, 30: 0.1}
    quotas, report = raking.raked(shares, targets, 600, 300)
    rows = quotas.collect()
    assert sum(r.quota for r in rows) == 600 and all(0 <= r.quota <= r.chips and abs(r.quota - r.expected) < 1 for r in rows)
    assert all(r.within and abs(r.expected - r.target) < 1e-4 for r in report.collect())
    taken = raking.sample(shares, quotas)
    assert taken.count() == 600
    by = {tuple(r.classes): r["count"] for r in taken.groupBy("classes").count().collect()}
    assert by == {tuple(r.classes): r.quota for r in rows if r.quota}


def test_rounds_are_proportional_fitting():
    """Disjoint classes: one round sets every cell to its target exactly; overlapping ones keep going towards theirs."""
    count, share = np.array([600.0, 300.0, 100.0]), np.eye(3)
    got = raking.fitted(count, share, np.array([0.2, 0.3, 0.5]), 100, 1)
    assert np.allclose(got, [20, 30, 50])
    mixed = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    far = [np.abs(x @ mixed / x.sum() - [0.2, 0.8]).max() for x in (raking.fitted(count, mixed, np.array([0.2, 0.8]), 50, r) for r in (0, 1, 5, 100))]
    assert far[0] > far[1] > far[2] > far[3] and far[3] < 1e-6


def test_what_cannot_be_met_is_said(spark):
    shares = spark.createDataFrame([(i, 3, 1.0) for i in range(90)] + [(100 + i, 9, 1.0) for i in range(5)] + [(200 + i, 12, 1.0) for i in range(50)], "chip_id long, class int, share double")
    quotas, report = raking.raked(shares, {3: 0.5, 9: 0.4, 33: 0.1}, 60)
    by = {r["class"]: r for r in report.collect()}
    # Class 9 has five chips, class 33 none, class 12 no target.
    assert by[9].sampled < 0.2 and not by[9].within and not by[33].within and by[12].sampled == 0 and by[12].within
    got = {tuple(r.classes): r.quota for r in quotas.collect()}
    assert got[(12,)] == 0 and got[(9,)] == 5 and got[(3,)] <= 90


@pytest.mark.parametrize("n", [0, 1, 10_000])
def test_sizes(spark, n):
    shares = chips(spark, 50, [1, 2], 3)
    quotas, _ = raking.raked(shares, {1: 0.5, 2: 0.5}, n)
    total = quotas.agg(F.sum("quota")).first()[0]
    assert total == n if n < 50 else 0 < total <= 50
    assert raking.raked(shares.limit(0), {1: 1.0}, n)[0].count() == 0
