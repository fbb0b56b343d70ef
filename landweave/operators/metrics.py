"""Segmentation metrics as aggregates of a prediction table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators.neighborhood import moving_max

#: Fixed value: the small number that keeps the metrics' quotients finite.
EPSILON = 1e-7


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _rounded_sum(c: Column) -> Column:
    """Sum of values rounded half to even."""
    return F.sum(F.bround(_clip(c)))


def recall(t: Column, p: Column) -> Column:
    """G13."""
    return _rounded_sum(t * p) / (_rounded_sum(t) + EPSILON)


def precision(t: Column, p: Column) -> Column:
    """G13."""
    return _rounded_sum(t * p) / (_rounded_sum(p) + EPSILON)


def f1(t: Column, p: Column) -> Column:
    """G13."""
    a, b = precision(t, p), recall(t, p)
    return 2 * a * b / (a + b + EPSILON)


def soft_dice(t: Column, p: Column, smooth: float = 1.0) -> Column:
    """One less the Dice coefficient on squares."""
    return 1 - (2 * F.sum(t * p) + smooth) / (F.sum(t * t) + F.sum(p * p) + smooth)


#: UD5: metrics by name.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"recall": recall, "precision": precision, "f1": f1, "soft_dice": soft_dice}


def evaluate(scores: DataFrame, names: Sequence[str] = tuple(METRICS), t: str = "y_true", p: str = "y_pred", keys: Sequence[str] = ()) -> DataFrame:
    """UD5, G13, G17: the named metrics in one pass."""
    return scores.groupBy(*keys).agg(*[METRICS[n](F.col(t), F.col(p)).alias(n) for n in names])


def batch_dice(scores: DataFrame, key: str = "chip_id", t: str = "y_true", p: str = "y_pred", smooth: float = 1.0) -> DataFrame:
    """Mean over chips of one less the Dice coefficient on sums."""
    one = scores.groupBy(key).agg((1 - (2 * F.sum(F.col(t) * F.col(p)) + smooth) / (F.sum(t) + F.sum(p) + smooth)).alias("d"))
    return one.agg(F.avg("d").alias("batch_dice"))


def softmax_dice(logits: DataFrame, classes: Sequence[str], label: str, smooth: float = 1.0) -> DataFrame:
    """Dice loss of the softmax of class columns against the one-hot label."""
    top = F.greatest(*[F.col(c) for c in classes])
    e = [F.exp(F.col(c) - top) for c in classes]
    whole = sum(e[1:], e[0])
    hit = [F.when(F.col(label) == i, x / whole).otherwise(0.0) for i, x in enumerate(e)]
    seen = F.when(F.col(label).between(0, len(classes) - 1), 1.0).otherwise(0.0)
    return logits.agg((1 - (2 * F.sum(sum(hit[1:], hit[0])) + smooth) / (F.sum(seen) + F.count(F.lit(1)) + smooth)).alias("softmax_dice"))


def confusion(pred: DataFrame, t: str, p: str) -> DataFrame:
    """Counts by true and predicted class."""
    return pred.groupBy(F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, t: str, p: str) -> DataFrame:
    """True and false counts, recall, precision, F1 and IoU of each class."""
    c = confusion(pred, t, p)
    one = F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(True).alias("true")), F.struct(F.col("p").alias("class"), F.lit(False).alias("true")))).alias("x")
    rows = c.select("t", "p", "n", one).select(F.col("x.class").alias("class"), "n", (F.col("t") == F.col("p")).alias("hit"), F.col("x.true").alias("true"))
    s = rows.groupBy("class").agg(*[F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).alias(a) for a, w in (("tp", F.col("hit") & F.col("true")), ("fn", ~F.col("hit") & F.col("true")), ("fp", ~F.col("hit") & ~F.col("true")))])
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    quotient = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return s.select("class", "tp", "fp", "fn", quotient(tp, tp + fn).alias("recall"), quotient(tp, tp + fp).alias("precision"), quotient(2 * tp, 2 * tp + fp + fn).alias("f1"), quotient(tp, tp + fp + fn).alias("iou"))


def macro(pred: DataFrame, t: str, p: str) -> DataFrame:
    """Means over classes, and accuracy."""
    means = per_class(pred, t, p).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("recall", "precision", "f1", "iou")])
    right = pred.agg(F.avg((F.col(t) == F.col(p)).cast("double")).alias("accuracy"))
    return means.crossJoin(right)


def local_max_loss(scores: DataFrame, size: int = 8, alpha: float = 0.25, keys: Sequence[str] = ("chip_id",), t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Weighted log loss of each pixel times its largest value nearby; needs ``row`` and ``col``."""
    q = F.least(F.greatest(F.col(p), F.lit(EPSILON)), F.lit(1 - EPSILON))
    loss = -F.col(t) * F.log(q) * alpha - (1 - F.col(t)) * F.log(1 - q) * (1 - alpha)
    return moving_max(scores.withColumn("point_loss", loss), "point_loss", size, keys).withColumn("loss", F.col("point_loss") * F.col("local_max"))


def best_so_far(log: DataFrame, value: str = "val_loss", order: str = "epoch", patience: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Running best of each run's metric log, whether a row improves it, and whether training would have stopped."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = log.withColumn("before", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    best = best.withColumn("improves", F.col("before").isNull() | (F.col(value) < F.col("before"))).withColumn("best", F.least(value, "before"))
    numbered = best.withColumn("__n", F.row_number().over(w))
    last = F.max(F.when(F.col("improves"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("since_best", F.col("__n") - last).withColumn("stopped", F.col("since_best") >= patience).drop("__n", "before")
