"""Sample sizes by class combination that bring the classes' shares of a sample to their targets.

Chips with the same set of classes are one cell, with the number of its chips and their mean share of each
class. Iterative proportional fitting starts from a sample in proportion to the cells: in every round a
cell is multiplied by the product, over its classes, of target over present share to the power of the
cell's share of the class, the cells are scaled to the sample's size, and none gets more than it has.
Controlled rounding then takes the whole parts and adds one sample at a time where it brings the classes
nearest their targets.

A cell is a set of classes, so that there are at most two to the number of classes, whatever the number of
chips; more than ``MOST_CELLS`` are an error. Cells are made by Spark, the rounds run on their table.

Cases: a target that no cell's chips have cannot be met, and the report says so; a class without a target
has target 0, and cells that hold it get nothing; where cells run out of chips the sample is smaller than asked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.sampling import class_combination

MOST_CELLS = 1 << 16


def cells(shares: DataFrame, key: str = "chip_id", column: str = "class") -> DataFrame:
    """``classes, chips, class, share``: the mean share of each class in the chips of each combination, from ``key, class, share``."""
    real = shares.where(F.col("share") > 0)
    combined = class_combination(real, key, column)
    sizes = combined.groupBy("classes").agg(F.count(F.lit(1)).alias("chips"))
    sums = real.join(combined, key).groupBy("classes", column).agg(F.sum("share").alias("sum"))
    return sums.join(sizes, "classes").select("classes", "chips", column, (F.col("sum") / F.col("chips")).alias("share"))


def fitted(chips: np.ndarray, share: np.ndarray, target: np.ndarray, n: float, rounds: int) -> np.ndarray:
    """Samples of each cell after some rounds; ``share`` has a row for each cell and a column for each class."""
    x = np.minimum(chips, n * chips / chips.sum())
    for _ in range(rounds):
        have = x @ share
        ratio = np.where(have > 0, target * x.sum() / np.where(have > 0, have, 1), 1.0)
        # A class of target 0 takes its cells with it; elsewhere the power of a share of 0 is 1.
        x = x * np.prod(np.where(share > 0, ratio[None, :] ** np.where(share > 0, share, 0), 1.0), axis=1)
        if x.sum() == 0:
            break
        x = np.minimum(chips, n * x / x.sum())
    return x


def rounded(x: np.ndarray, chips: np.ndarray, share: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers that add up to ``n`` (or as many as cells with a part have), each the part below or above its cell's."""
    quota = np.floor(x + 1e-9).astype(np.int64)
    room = (quota < chips) & (x > quota + 1e-9)
    left = int(min(n, round(float(x.sum())))) - int(quota.sum())
    away = quota @ share - target * n
    for _ in range(min(left, int(room.sum()))):
        after = ((away[None, :] + share) ** 2).sum(1)
        best = int(np.where(room, after, np.inf).argmin())
        quota[best] += 1
        room[best] = False
        away = away + share[best]
    return quota


def raked(shares: DataFrame, targets: dict[int, float], n: int, rounds: int = 100, key: str = "chip_id", column: str = "class") -> tuple[DataFrame, DataFrame]:
    """M6, M3: ``classes, chips, expected, quota`` of each cell; and ``class, target, expected, sampled, within`` of each class.

    ``expected`` and ``sampled`` are shares of the fitted and of the rounded sample; ``within`` says whether
    the latter is within one sample of the target.
    """
    spark = shares.sparkSession
    table = cells(shares, key, column).limit(MOST_CELLS * 64 + 1).collect()
    names = sorted({tuple(r.classes) for r in table})
    classes = sorted({r[column] for r in table} | set(targets))
    if len(names) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of classes")
    at, of = {c: i for i, c in enumerate(names)}, {c: i for i, c in enumerate(classes)}
    chips, share = np.zeros(len(names)), np.zeros((len(names), len(classes)))
    for r in table:
        chips[at[tuple(r.classes)]] = r.chips
        share[at[tuple(r.classes)], of[r[column]]] = r.share
    goal = np.array([targets.get(c, 0.0) for c in classes])
    goal = goal / goal.sum() if goal.sum() else goal
    x = fitted(chips, share, goal, n, rounds) if names else np.zeros(0)
    quota = rounded(x, chips, share, goal, n) if names else np.zeros(0, np.int64)
    kind = shares.schema[column].dataType.simpleString()
    by_cell = [(list(c), int(chips[i]), float(x[i]), int(quota[i])) for c, i in at.items()]
    expected, sampled = (v @ share / max(v.sum(), 1e-300) if names else np.zeros(len(classes)) for v in (x, quota))
    by_class = [(c, float(goal[i]), float(expected[i]), float(sampled[i]), bool(abs(sampled[i] - goal[i]) * max(quota.sum(), 1) <= 1)) for c, i in of.items()]
    return (
        spark.createDataFrame(by_cell, f"classes array<{kind}>, chips long, expected double, quota int"),
        spark.createDataFrame(by_class, f"{column} {kind}, target double, expected double, sampled double, within boolean"),
    )


def sample(shares: DataFrame, quotas: DataFrame, key: str = "chip_id", column: str = "class") -> DataFrame:
    """The chips of a raked sample: as many of each cell as its quota, by the order of :func:`sampling.quota_sample`."""
    from landweave.operators.sampling import quota_sample

    combined = class_combination(shares.where(F.col("share") > 0), key, column).withColumn("cell", F.to_json(F.struct("classes")))
    return quota_sample(combined, quotas.select(F.to_json(F.struct("classes")).alias("cell"), "quota"), key, "cell").select(key, "classes")
