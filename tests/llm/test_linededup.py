import hashlib

import duckdb

from landweave.llm import linededup

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(rows, least=40, docs=5):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < docs or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_whole_table(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}'")
    want = con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({linededup.ORACLE})").fetchall()
    docs = spark.read.parquet(DATA)
    assert sorted(map(tuple, linededup.digest(docs).collect())) == sorted(want) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    line = "This Line is long enough to be a key, é, of forty"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x\n" * 3000 + line)]
    rows += [(10 + i, f"a\n \t{line.upper() if i % 2 else line}\x0b\n{line}\nb") for i in range(7)] + [(30, line), (31, line + "\n"), (9, "é" * 40), (8, "z" * 39)]
    rows += [(40 + i, "y" * 40) for i in range(4)] + [(12, rows[6][1])]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, row long, h string")
    assert sorted(map(tuple, linededup.digest(docs).collect())) == plain(rows)
    assert linededup.digest(docs.limit(0)).count() == 0


def test_bitmaps_are_runs(spark):
    long = "the same forty letters and then some more of them"
    docs = spark.createDataFrame([(i, f"{long}\n{long}\nkept\n{long}\nkept") for i in range(5)], "doc_id long, text string")
    runs = {r.doc_id: (r.n_dropped, [tuple(x) for x in r.dropped]) for r in linededup.keep_bitmaps(docs).collect()}
    assert runs == {i: (3, [(0, 2), (3, 1)]) for i in range(4)}


def test_work_grows_in_proportion_to_the_lines_of_one_text(spark):
    import time

    def took(n):
        text = "\n".join(f"a line that is longer than forty characters, {i}\nshort {i}" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
        began = time.perf_counter()
        assert {r.n_dropped for r in linededup.digest(docs).collect()} == {0, n}
        return time.perf_counter() - began

    took(10)
    assert took(80000) < 16 * max(took(10000), 1)
