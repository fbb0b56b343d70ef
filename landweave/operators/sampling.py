"""Splits, quotas and sample design over tables of any size. Order by hash makes every choice repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators.overlay import small
from landweave.operators.ranking import number_rows
from landweave.storage import materialize


def hash_order(key: str | Column, seed: int = 0) -> Column:
    """A spread-out whole number for an integer key: multiplicative hashing of its last 31 bits modulo 2^32."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    return F.pmod((k + seed) % 2147483648 * 2654435761, F.lit(4294967296))


def split(df: DataFrame, key: str, shares: Sequence[tuple[str, float]] = (("train", 0.6), ("validation", 0.2), ("test", 0.2)), seed: int = 0) -> DataFrame:
    """A shuffled positional split; the cut points are the whole parts of the summed shares of the count."""
    numbered = number_rows(df.withColumn("__h", hash_order(key, seed)), ["__h", key], "__n", 0)
    n, total, cond = df.count(), 0.0, None
    for name, share in shares[:-1]:
        total = round(total + share, 9)
        step = F.col("__n") < int(total * n + 1e-9)
        cond = F.when(step, name) if cond is None else cond.when(step, name)
    return numbered.withColumn("split", cond.otherwise(shares[-1][0]) if cond is not None else F.lit(shares[-1][0])).drop("__h", "__n")


def _within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order))


def quota_sample(df: DataFrame, quota: DataFrame, key: str, group: str, count: str = "quota", salts: int = 64, seed: int = 0) -> DataFrame:
    """Up to ``count`` rows of each group, lowest hash first.

    Each of ``salts`` parts of a group first keeps its own lowest, so a class with most of the rows is
    never sorted in one task; what is left is at most salts x quota rows.
    """
    joined = df.where(F.col(group).isNotNull()).join(small(quota), group).withColumn("__h", hash_order(key, seed))
    joined = joined.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = joined.withColumn("__r", _within(joined, [group, "__s"], ["__h", key])).where(F.col("__r") <= F.col(count))
    return part.withColumn("__r", _within(part, [group], ["__h", key])).where(F.col("__r") <= F.col(count)).drop("__h", "__s", "__r")


def quotas(spark, shares: dict[int, float], n: int = 3000, column: str = "class") -> DataFrame:
    """M2: whole number of samples of each class; shares need not add up to one."""
    return spark.createDataFrame([(k, int(round(v * n, 6))) for k, v in shares.items()], f"{column} int, quota int")


def class_combination(profiles: DataFrame, key: str = "chip_id", column: str = "class") -> DataFrame:
    """The exact set of classes of each chip, as a sorted array."""
    return profiles.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias("classes"))


def share_sample(df: DataFrame, groups: Sequence[str], key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """M3: the whole part of ``share`` of each group, lowest hash first."""
    sizes = df.groupBy(*groups).agg(F.floor(F.count(F.lit(1)) * share).cast("long").alias("__q"))
    ranked = number_rows(df.withColumn("__h", hash_order(key, seed)), [*groups, "__h", key], "__n")
    first = ranked.groupBy(*groups).agg(F.min("__n").alias("__f"))
    limits = sizes.join(first, list(groups))
    return ranked.join(limits, list(groups)).where(F.col("__n") - F.col("__f") < F.col("__q")).drop("__h", "__n", "__f", "__q")


def class_shares(pixels: DataFrame, key: str = "chip_id", column: str = "class") -> DataFrame:
    """``key, class, n, share`` of each class in each chip."""
    n = pixels.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def wide_shares(shares: DataFrame, classes: Sequence[int], key: str = "chip_id", column: str = "class") -> DataFrame:
    """One column a class, 0 where it is absent."""
    return shares.groupBy(key).pivot(column, list(classes)).agg(F.first("share")).na.fill(0.0).select(key, *[F.col(str(c)).alias(f"c{c}") for c in classes])


def distribution(sample: DataFrame, target: DataFrame, column: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """Share of each class in a sample (of each of the few key values) beside its target, and the difference."""
    n = sample.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    got = target.crossJoin(F.broadcast(total)).join(n, [*keys, column], "left").na.fill(0, ["n"])
    share = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    return got.select(*keys, column, "n", share.alias("share"), "target", (share - F.col("target")).alias("difference"))


def adjusted_quotas(found: DataFrame, n: int, column: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """M6: quotas scaled by target over found share, for another draw."""
    return found.select(*keys, column, F.round(F.try_divide(F.col("target"), F.col("share")) * F.col("target") * n).cast("int").alias("quota"))


def cluster_quotas(clusters: DataFrame, n: int, equal: bool = False, column: str = "cluster") -> DataFrame:
    """M5: samples of each cluster, in proportion to its size or the same for all."""
    sizes = clusters.groupBy(column).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("k"))
    q = F.floor(F.lit(n) / F.col("k")) if equal else F.bround(F.lit(n) * F.col("size") / F.col("total"))
    return sizes.crossJoin(F.broadcast(total)).select(column, "size", q.cast("int").alias("quota"))


def cluster_profiles(wide: DataFrame, columns: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """M4: chips with the ``cluster`` of the best k-means by silhouette, and the silhouette of each k.

    The profiles are written once: every k reads them several times, and they are far smaller than what they are made from.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(materialize(wide))
    found = {}
    for k in ks:
        done = KMeans(k=k, seed=seed).fit(data).transform(data)
        found[k] = (ClusteringEvaluator().evaluate(done), done)
    best = max(found, key=lambda k: (found[k][0], -k))
    return found[best][1].withColumnRenamed("prediction", "cluster").drop("features"), {k: v[0] for k, v in found.items()}


def principal_components(wide: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """M7: profiles reduced to ``k`` components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(wide)
    out = PCA(k=k, inputCol="features", outputCol="pc").fit(data).transform(data).withColumn("pc", vector_to_array("pc"))
    return out.select(*[c for c in wide.columns if c not in columns], *[F.get("pc", i).alias(f"pc{i + 1}") for i in range(k)])


def shares_of_work(df: DataFrame, order: Sequence[str], ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """M8, Q23: rows numbered from 0 by a total order, with the number of the half-open range that holds them; rows in none go."""
    numbered = number_rows(df, order, "idx", 0)
    who = None
    for i, (a, b) in enumerate(ranges):
        inside = (F.col("idx") >= a) & (F.col("idx") < b)
        who = F.when(inside, i) if who is None else who.when(inside, i)
    return numbered.withColumn("analyst", who).where(F.col("analyst").isNotNull())
