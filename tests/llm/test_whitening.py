import math
import random
from fractions import Fraction

import numpy as np
import pytest

from landweave.llm import whitening

SF = "/root/testdata/sf0.01"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string")


def plain(vectors):
    """Covariance of the whole numbers in fractions."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[Fraction(n * a - s, n) for a, s in zip(r, sums)] for r in x]
    d = len(sums)
    return x, n, sums, np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])


def test_whole_table_equals_eigh(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: list(r.embedding) for r in df.collect()}
    x, n, sums, v = plain(list(rows.values()))
    got = {}
    for r in whitening.digest(df).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(rows) and all(sorted(c) == list(range(1, 9)) for c in got.values())
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.array([[got[i][c].whitened for c in range(1, 9)] for i in rows])
    want = (np.array(x) - np.array(sums) / n) @ vectors[:, :8] / np.sqrt(values[:8])
    want *= np.sign((want * white).sum(0))
    assert np.abs(white - want).max() < 1e-7
    for i, own in zip(rows, x):
        assert got[i][1].n == n and got[i][3].deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums))
    first = next(iter(got.values()))
    assert np.allclose([first[c].explained for c in range(1, 9)], values[:8] / values.sum(), rtol=1e-12)
    assert first[1].identity_error < 1e-10
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-10


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16):
        a = rng.standard_normal((d, d + 3)) * np.logspace(0, 6, d)[:, None]
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[order][:, order], rtol=1e-12)
        assert np.all(np.triu(factor, 1) == 0)
        turned = whitening.one_sided_jacobi(factor)
        gram = turned.T @ turned
        norm = np.sqrt(gram.diagonal())
        assert np.abs(gram / np.outer(norm, norm) - np.eye(d)).max() < 1e-13
        # Singular values of the data are right to more places than eigenvalues of v by a dense solver.
        assert np.allclose(np.sort(norm), np.linalg.svd(a, compute_uv=False)[::-1], rtol=1e-7)
    low = rng.standard_normal((6, 2)) @ rng.standard_normal((2, 6))
    assert whitening.pivoted_cholesky(low @ low.T)[0].shape[1] == 2


def test_scatter_is_exact():
    rng = random.Random(2)
    for bits in (5, 19, 21, 40, 53):
        z = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(40)]
        want = [[sum(r[i] * r[j] for r in z) for j in range(3)] for i in range(3)]
        assert whitening.exact_scatter(np.array(z, np.int64)).tolist() == want


def test_small_variances_beside_large_ones(spark):
    """Graded scales: the eighth component is right although its variance is 1e-9 of the first one's."""
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((400, 9)) * np.logspace(5, 0.5, 9)).tolist()
    rows = whitening.digest(table(spark, data)).collect()
    _, _, _, v = plain(data)
    values = np.linalg.eigvalsh(v)[::-1]
    got = {r.component: r.explained for r in rows}
    assert np.allclose([got[c] for c in range(1, 9)], values[:8] / values.sum(), rtol=1e-6)
    assert rows[0].identity_error < 1e-8


def test_same_for_every_partitioning(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = whitening.fit(df.repartition(1)), whitening.fit(df.repartition(7))
    assert a.sums == b.sums and (a.values == b.values).all() and (a.vectors == b.vectors).all()


def test_cases(spark):
    good = [[0.5, 1.0, 2.0], [1.5, -1.0, 2.0], [0.25, 0.0, 2.0], [0.25, 0.0, 2.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0]]
    rows = whitening.digest(table(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 3} and len(rows) == 12 and {r.n for r in rows} == {4}
    # The third dimension is constant.
    assert all((r.whitened is None, r.explained == 0) == ((r.component == 3,) * 2) for r in rows)
    assert abs(sum(r.explained for r in rows if r.vec_id == 0) - 1) < 1e-12
    same = {r.component: r.whitened for r in rows if r.vec_id == 2}
    assert same == {r.component: r.whitened for r in rows if r.vec_id == 3}
    one = whitening.digest(table(spark, good[:1])).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(c, None, 0.0, 0, None) for c in (1, 2, 3)]
    assert whitening.digest(table(spark, bad[:2])).count() == 0
    assert whitening.digest(table(spark, good).limit(0)).count() == 0
    huge = whitening.digest(table(spark, [[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0]])).collect()
    assert {r.deviation for r in huge if r.vec_id == 0} == {None} and {r.n for r in huge} == {3}
    with pytest.raises(ValueError):
        whitening.fit(table(spark, [[0.0] * 4097]))
