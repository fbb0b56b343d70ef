"""Edge values of band, array, window, sampling and metric functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.functions import arrays, bands, geo
from landweave.operators import chips, composite, metrics, neighborhood, overlay, ranking, sampling
from landweave.sources import scans


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_change_class_borders(spark):
    diffs = [-0.3, -0.25, -0.1, -0.095, 0.0, 0.095, 0.2, None, float("nan")]
    assert column(spark, diffs, lambda v: bands.change_class(v, F.lit(0.7))) == [3, 2, 2, 1, 1, 1, 4, None, 4]
    assert column(spark, [0.0], lambda v: bands.change_class(v, F.lit(0.6))) == [None]
    assert column(spark, [-0.25, -0.095, -0.3, None], lambda v: bands.logging_label(v, F.lit(0.05))) == [1, 1, 0, None]
    assert column(spark, [-0.2], lambda v: bands.logging_label(v, F.lit(0.06))) == [0]


def test_clean_ratio_percent(spark):
    assert column(spark, [math.nan, math.inf, -math.inf, 2.0, None], bands.clean) == [0.0, 0.0, 0.0, 2.0, None]
    assert column(spark, [0.0, 4.0, None], lambda v: bands.ratio(F.lit(1.0), v)) == [0.0, 0.25, None]
    assert column(spark, [0.999, -0.999, 0.5], bands.percent) == [99, -99, 50]
    assert column(spark, [0.5, 0.9, -1.0, None], bands.brightness) == [0.75, 1.0, 0.0, None]
    assert column(spark, [8, 7, None], lambda v: bands.bit_set(v, 3), "int") == [True, False, None]


def test_one_hot_out_of_range(spark):
    assert column(spark, [0, 2, 3, -1, None], lambda v: bands.one_hot(v, 3), "int") == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_remap_default(spark):
    df = spark.createDataFrame([(3,), (33,), (7,), (None,)], "c int")
    assert sorted(((r.c, r.label) for r in bands.remap(df, "c").collect()), key=str) == sorted([(3, 1), (33, 8), (7, 0), (None, None)], key=str)


def test_unmixing_finds_pure_members(spark):
    rows = [tuple(v * 1000 for v in bands.ENDMEMBERS[n]) for n in bands.ENDMEMBERS]
    df = bands.unmix(spark.createDataFrame(rows, ", ".join(f"{b} double" for b in bands.BANDS)))
    got = np.array([[r[n] for n in bands.ENDMEMBERS] for r in df.collect()])
    assert np.abs(got - np.eye(4)).max() < 1e-9


@pytest.fixture
def chip(spark):
    x = np.arange(4 * 4 * 3).astype(float)
    return spark.createDataFrame([(1, x.tolist())], "chip_id int, data array<double>"), x.reshape(4, 4, 3)


def test_chip_moves(chip):
    df, x = chip
    one = lambda c: np.array(df.select(c.alias("o")).first()[0])
    d = F.col("data")
    assert (one(arrays.flip_up_down(d, 4, 4, 3)).reshape(4, 4, 3) == x[::-1]).all()
    assert (one(arrays.flip_left_right(d, 4, 4, 3)).reshape(4, 4, 3) == x[:, ::-1]).all()
    assert (one(arrays.rotate_90(d, 4, 4, 3)).reshape(4, 4, 3) == np.rot90(x)).all()
    turned = d
    for _ in range(4):
        turned = arrays.rotate_90(turned, 4, 4, 3)
    assert (one(turned).reshape(4, 4, 3) == x).all()
    assert (one(arrays.to_channel_first(d, 4, 4, 3)).reshape(3, 4, 4) == x.transpose(2, 0, 1)).all()
    assert (one(arrays.to_channel_last(arrays.to_channel_first(d, 4, 4, 3), 4, 4, 3)).reshape(4, 4, 3) == x).all()
    assert (one(arrays.gather_channels(d, 4, 4, 3, [2, 0])).reshape(4, 4, 2) == x[..., [2, 0]]).all()
    f, y = arrays.split_label(d, 4, 4, 3)
    assert (one(f).reshape(4, 4, 2) == x[..., :2]).all() and (one(y).reshape(4, 4) == x[..., 2]).all()


def test_rotation_of_oblong_chips(spark):
    x = np.arange(2 * 3 * 2).astype(float)
    df = spark.createDataFrame([(x.tolist(),)], "data array<double>")
    got = df.select(arrays.rotate_90(F.col("data"), 2, 3, 2)).first()[0]
    assert (np.array(got).reshape(3, 2, 2) == np.rot90(x.reshape(2, 3, 2))).all()


def test_constant_channel_is_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0, 5.0],)], "data array<double>")
    assert df.select(arrays.normalize_channels(F.col("data"), 1, 2, 2)).first()[0] == [0.0, 0.0, 1.0, 0.0]


def test_resample_keeps_corners_and_constants(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, [7.0] * 4)], "chip_id int, data array<double>")
    got = {r.chip_id: np.array(r.data).reshape(3, 3) for r in chips.resampled(df, 2, 2, 1, (3, 3), align_corners=True).collect()}
    assert got[1].tolist() == [[0, 0.5, 1], [1, 1.5, 2], [2, 2.5, 3]] and (got[2] == 7).all()


def test_detections_and_mosaic(spark):
    p = spark.createDataFrame([(1, [0.1, 0.19]), (2, [0.1, 0.2])], "chip_id int, probability array<double>")
    assert [r.chip_id for r in chips.keep_detections(p).collect()] == [2]
    m = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 5, 2), (0, 1, None, 1)], "row int, col int, v int, o int")
    assert [tuple(r) for r in composite.mosaic(m, "v", "o", 0).collect()] == [(0, 0, 5)]


def test_windows_against_plain(spark):
    rng = np.random.default_rng(1)
    x = rng.random((9, 11))
    df = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(9) for c in range(11)], "row int, col int, v double")
    for got in neighborhood.moving_max(df, "v", 8).collect():
        assert got.local_max == x[max(0, got.row - 3) : got.row + 5, max(0, got.col - 3) : got.col + 5].max()
    some = df.where("v > 0.9")
    square = {(r.row, r.col): r.v for r in neighborhood.focal_max_square(some, "v", 2, shape=(9, 11)).collect()}
    for r in range(9):
        for c in range(11):
            near = [v for v in x[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].ravel() if v > 0.9]
            assert square.get((r, c)) == (max(near) if near else None)


def test_numbering_is_dense(spark):
    df = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "k int").repartition(6)
    got = ranking.number_rows(df, ["k"]).collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 1000
    assert ranking.number_rows(df.limit(0), ["k"]).count() == 0


def test_split_sizes_and_repeatability(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in sampling.split(df, "k").collect()}
    assert a == {r.k: r.split for r in sampling.split(df.repartition(9), "k").collect()}
    sizes = [list(a.values()).count(n) for n in ("train", "validation", "test")]
    assert sizes == [61, 21, 21]


def test_quota_with_one_hot_class(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2900, 1).when(F.col("id") < 2999, 2).alias("class"))
    q = sampling.quotas(spark, {1: 0.5, 2: 0.9, 3: 0.1}, 100)
    got = [tuple(r) for r in sampling.quota_sample(df, q, "id", "class").groupBy("class").count().orderBy("class").collect()]
    assert got == [(1, 50), (2, 90)]


def test_metrics_of_perfect_and_empty(spark):
    s = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "y_true double, y_pred double")
    r = metrics.evaluate(s).first()
    assert abs(r.recall - 1) < 1e-6 and abs(r.f1 - 1) < 1e-6 and abs(r.soft_dice) < 1e-12
    m = metrics.per_class(spark.createDataFrame([(0, 1), (1, 1)], "t int, p int"), "t", "p").orderBy("class").collect()
    assert [(r["class"], r.tp, r.fp, r.fn) for r in m] == [(0, 0, 0, 1), (1, 1, 1, 0)]


def test_best_so_far(spark):
    log = spark.createDataFrame([(e, v) for e, v in enumerate([3.0, 2.0, 2.5, 2.5, 1.0])], "epoch int, val_loss double")
    got = metrics.best_so_far(log, patience=2).orderBy("epoch").collect()
    assert [r.improves for r in got] == [True, True, False, False, True] and [r.stopped for r in got] == [False, False, False, True, False]


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    p = spark.range(1).select(geo.centroid(ring).alias("p")).first().p
    assert (p.x, p.y) == (2.0, 1.0)
    d = spark.sql("select date'2020-12-31' d")
    first, after = geo.month_window(F.year("d"), F.month("d"))
    assert [str(v) for v in d.select(first, after, geo.analysis_year(F.col("d"))).first()] == ["2020-12-01", "2021-01-01", "2021"]


def test_points_on_edges_take_the_first_region(spark):
    regions = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0), ("b", 1, 0.5, 0.0, 2.0, 1.0)], "name string, o int, minx double, miny double, maxx double, maxy double")
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.75, 0.5), (3, 1.0, 0.5), (4, 2.0, 0.5), (4, 2.0, 0.5)], "id int, x double, y double")
    got = sorted((r.id, r.name) for r in overlay.points_in(pts, regions, "name", "o", "none").collect())
    assert got == [(1, "a"), (2, "a"), (3, "b"), (4, "none"), (4, "none")]


def test_quantiles_are_exact_and_interpolated(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 501)) for v in np.round(rng.normal(size=n), 1)] + [(3, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    points = (0.0, 0.03, 0.5, 0.98, 1.0)
    got = {r.k: r.q for r in composite.quantiles(df, "v", points, ["k"]).collect()}
    assert set(got) == {1, 2, 3}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for i, v in rows if i == k and v is not None], points))


@pytest.mark.parametrize("few", [1, 4096])
def test_order_statistics_by_histograms(spark, monkeypatch, few):
    """Wide and narrow ranges, ties, infinities, NaN and null keys; with every range refined, and with the last ones sorted."""
    monkeypatch.setattr(composite, "GATHERED", few)
    rng = np.random.default_rng(5)
    inf, nan = float("inf"), float("nan")
    groups = {
        "normal": rng.normal(size=700), "wide": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500), "ties": np.repeat([-0.0, 1.0, 1.0 + 2**-52, -7.5], 90), "near": 1e6 + rng.uniform(0, 1e-6, 400),
        "odd": np.array([inf, -inf, nan, nan, 0.0, -1e308, 1e308, 5e-324]), None: np.arange(50.0), "one": np.array([3.5]),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = composite.order_statistics(df, "v", lambda n: [F.lit(0), F.floor(n / 3), F.floor(n / 2), n - 1], ["k"]).collect()
    assert {r.k for r in got} == set(groups)
    for k, x in groups.items():
        own = {r["rank"]: r.v for r in got if r.k == k}
        assert set(own) == {0, len(x) // 3, len(x) // 2, len(x) - 1}
        assert all(np.array_equal(own[i], np.sort(x)[i], equal_nan=True) for i in own)


def test_selection_moves_counts_only(spark):
    df = spark.range(100000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 99991 / 7).alias("v"))
    plan = composite.quantiles(df, "v", (0.25, 0.5), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_property_lists_are_bounded(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert scans.property_list(df, ["k"], "k").first().k == list(range(20))
    with pytest.raises(ValueError):
        scans.property_list(df, ["k"], "k", most=19)
