import numpy as np
from pyspark.sql import functions as F

from landweave.llm import annsearch


def exact(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(1)
            o = np.lexsort((ids, -s))
            out[i] = [(int(ids[j]), float(s[j])) for j in o if ids[j] != i][:k]
    return out


def results(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()])
    got = results(annsearch.digest(df).collect())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    assert all(abs(s - (x[q] * x[i]).sum()) < 1e-12 for q in list(got)[:50] for i, s in got[q])


def test_recall_and_rows_verified_over_blocks(spark):
    """Uniform directions, the hardest case, in two blocks and with a share of rows verified."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.sqrt((x * x).sum(1))[:, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = annsearch.search(df, F.col("vec_id") % 20 == 0, block=8192).collect()
    got, want = results(found), exact([(r.vec_id, r.embedding) for r in df.collect()])
    assert set(got) == set(want) and recall(got, want) >= 0.95
    verified = [r.verified for r in found if r.rank == 1]
    assert max(verified) <= 0.1 * len(rows) and sum(verified) / len(verified) <= 0.05 * len(rows)


def test_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    bad = [(20 * 300, None), (20 * 301, []), (20 * 302, [0.0] * 8), (20 * 303, [float("nan")] * 8), (20 * 304, [None] + [1.0] * 7), (20 * 305, [float("inf")] * 8), (20 * 306, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, block string")
    got, want = results(annsearch.digest(df).collect()), exact(rows)
    assert set(got) == set(want) and recall(got, want) > 0.9
    same = [i for i, _ in got[1000] if i >= 1000]
    assert len(same) > 5 and same == list(range(1001, 1001 + len(same)))
    few = df.where(F.col("vec_id").between(0, 4))
    assert results(annsearch.digest(few).collect()) == exact(rows[:5])
    assert annsearch.digest(df.limit(0)).count() == 0


def test_recall_with_uneven_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    one = x.copy()
    one[7] *= 3
    for y in (one, x * rng.uniform(0.5, 2, (3000, 1))):
        rows = [(i, v.tolist()) for i, v in enumerate(y)]
        got = results(annsearch.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
        assert recall(got, exact(rows)) >= 0.95


def test_rows_do_not_depend_on_the_order_of_queries(spark):
    """Queries by twos and threes, all together, and dealt by other numbers of tasks: the same rows, with the same numbers verified."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, annsearch.search(df.repartition(p), F.col("vec_id") % 20 == 0, block=1500, query_block=q).collect())) for p, q in ((1, 512), (3, 3), (5, 50))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 4000


def test_a_block_comes_once(spark, monkeypatch):
    """Many rows of queries share the one row of their block."""
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 8)))], "vec_id long, embedding array<double>")
    made, searched = [], annsearch._searched

    def counted(*args):
        run = searched(*args)

        def count(batches):
            for b in batches:
                made.append((b.num_rows, b.column(1).to_pylist().count(False)))
                yield b

        return lambda batches: run(count(batches))

    # The function itself, on rows as Spark hands them over.
    x = np.array([r.embedding for r in df.collect()])
    import pyarrow as pa

    row = lambda query, ids: (0, query, np.array(ids, np.int64).tobytes(), x[ids].tobytes())
    batch = [row(False, list(range(2000)))] + [row(True, [q]) for q in range(0, 2000, 20)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*batch)], names=["block", "query", "ids", "vecs"])]
    out = pa.Table.from_batches(list(counted(20, 240, 25, 8, "<f8")(iter(batches))))
    assert made == [(101, 1)] and out.num_rows == 2000


def test_collisions_are_those_of_plain_windows():
    """Random, clustered, equal and far vectors, whatever step is tried first, in blocks whose ranks fill one byte and more."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((7, 12))
    tables = [rng.standard_normal((n, 12)) for n in (1, 3, 256, 257, 1500)] + [centres[rng.integers(0, 7, 900)] + 0.1 * rng.standard_normal((900, 12)), np.ones((300, 12)), rng.standard_normal((600, 300))]
    for x in tables:
        queries = np.concatenate([x[:6], 30 * x[:2], -x[:1]])
        arrays = annsearch.Arrays(x, 240)
        windows = annsearch.Windows(arrays, annsearch._extended(queries, True))
        y = annsearch._extended(x, False) @ arrays.directions
        for j, q in enumerate(annsearch._extended(queries, True) @ arrays.directions):
            step, need, enough = 0, int(np.ceil(0.8 * len(q))), min(240, len(x))
            while True:
                count = ((y >= q - arrays.width(step)) & (y < q + arrays.width(step))).sum(axis=1)
                if (count >= need).sum() >= enough:
                    break
                step += 1
            want = np.flatnonzero(count >= np.sort(count)[-enough]).tolist()
            for guess in (0, 1, 4, step, step + 5):
                which, at = arrays.collide(windows, j, guess)
                assert (which.tolist(), at) == (want, step)


def test_each_block_is_a_task_of_its_own(spark, monkeypatch):
    """Blocks are dealt by number: none waits behind another that a hash put into the same task."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 8)))], "vec_id long, embedding array<double>")

    def blocks_only(*args):
        def run(batches):
            from pyspark import TaskContext

            import pyarrow as pa

            seen = [b.column(1).to_pylist().count(False) for b in batches]
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([0]), pa.array([float(sum(seen))]), pa.array([0])], names=["query_id", "vec_id", "score", "verified"])

        return run

    monkeypatch.setattr(annsearch, "_searched", blocks_only)
    held = [r.score for r in annsearch.search(df, F.col("vec_id") % 20 == 0, block=100).collect()]
    assert len(held) >= 30 and set(held) == {1.0}
