import random

import duckdb

from landweave.llm import fixity


def test_whole_table(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = con.sql(f'select file, "offset", kind from ({fixity.ORACLE})').fetchall()
    got = fixity.digest(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def plain(a, b):
    def bags(rows):
        out = {}
        for f, o, h in rows:
            if f is not None and o is not None:
                out.setdefault((f, o), []).append(h)
        return {k: sorted(v) for k, v in out.items()}

    a, b = bags(a), bags(b)
    return sorted((*k, "missing" if k not in b else "extra" if k not in a else "changed") for k in {*a, *b} if a.get(k) != b.get(k))


def test_random_replicas(spark):
    rng = random.Random(4)
    shape = "file long, offset long, hash string"
    rows = [(f, o * 37, str(rng.random())) for f in range(40) for o in range(30)] + [(2, 37, "twice"), (None, 1, "x"), (1, None, "y")]
    other = [(f, o, h if rng.random() > 0.03 else "bad") for f, o, h in rows if rng.random() > 0.02] + [(70, 5, "new"), (3, 36, "new")]
    df = lambda x: spark.createDataFrame(x, shape)
    run = lambda x, y: sorted(map(tuple, fixity.audit(df(x), df(y), range_bytes=100, fan=3).collect()))
    assert run(rows, other) == plain(rows, other)
    assert run(rows, rows[::-1]) == [] == run([], [])
    assert run(rows[:3], []) == plain(rows[:3], [])


def test_page_layout_cases(spark):
    pages = spark.createDataFrame([(13, None, None, 1), (13, None, None, 1), (None, "u", "h", 2), (7, "é", "z" * 200000, 3), (600, "u", "", 4)], "page_id long, url string, html string, file int")
    rows = fixity.records(pages, per_file=2).collect()
    assert len(rows) == 4
    assert [(r.file, r.page_id) for r in sorted(rows, key=lambda r: (r.file, r.offset))] == [(0, 7), (0, 13), (1, 13), (1, 600)]
    ends = {(r.file, r.offset + r.length) for r in rows} | {(0, 0), (1, 0)}
    assert all((r.file, r.offset) in ends for r in rows)
    assert {r.kind for r in fixity.digest(pages).collect()} == {"missing", "changed"}
    assert fixity.digest(pages.limit(0)).count() == 0
