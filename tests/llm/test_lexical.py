import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from landweave.llm import lexical

SF = "/root/testdata/sf0.01"


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k=20):
    """Rows (item, rank, doc, score) by counting every term of every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_whole_table_equals_plain_and_sql(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows(lexical.digest(docs, bench))
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(con.sql(lexical.ORACLE).select("item_id, rank, doc_id, score").fetchall(), key=str) == got


DOCS = [
    (1, "Red apple, red\tAPPLE!red"), (2, None), (3, ""), (4, " .,;\x00\n"), (5, "apple\x00pie é x ÀB"), (6, "red"), (6, "red"), (7, "app le pple appl"),
    (None, "red"), (8, "red " * 5000 + "pie"), (9, "[red]{apple}@pie`red_apple^"), (10, "日本 日本語 red"),
]
ITEMS = [(1, "red apple"), (1, "red apple"), (1, "pie"), (2, None), (3, ""), (4, "?!"), (5, "red RED Apple À àb"), (6, "日本語"), (7, "nowhere"), (None, "apple é x")]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    want = sorted(plain(DOCS, sorted(set(ITEMS), key=str)), key=str)
    assert want and rows(lexical.search(docs, bench)) == want
    # Blocks of a few items, and items dealt over several blocks.
    assert rows(lexical.search(docs, bench, block_chars=20)) == want
    assert rows(lexical.search(docs, bench, block_chars=8)) == want
    assert rows(lexical.search(docs, bench, k=2)) == sorted((r for r in want if r[1] <= 2), key=str)
    assert lexical.search(docs.limit(0), bench).count() == lexical.search(docs, bench.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id = 4"), bench).count() == 0


def test_blocks_of_a_large_benchmark(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert rows(lexical.search(docs, bench, block_chars=2500)) == rows(lexical.digest(docs, bench))


def test_best_keeps_ties_by_id():
    best = lexical.Best(2, 3)
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 4, (500, 2))
    for lo in range(0, 500, 50):
        d, item = np.nonzero(scores[lo : lo + 50][::-1] >= best.least)
        best.add(item, lo + 49 - d, np.zeros(len(d), np.int64), scores[lo + 49 - d, item])
        best.cut()
    item, ids, _, score = best.cut()
    for i in range(2):
        want = sorted((-s, d) for d, s in enumerate(scores[:, i].tolist()) if s)[:3]
        assert list(zip((-score[item == i]).tolist(), ids[item == i].tolist())) == want


def test_scores_do_not_depend_on_the_runs(monkeypatch):
    class Row:
        def __init__(self, i, t, n):
            self.item_id, self.text_key, self.term, self.times = i, "a", t, n

    block = lexical.Block([Row(i, f"w{j}", 1 + (i + j) % 3) for i in range(40) for j in range(i, 60, 7)])
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 90, rng.integers(0, 9))) for _ in range(60)])
    found = []
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(lexical.Scorer, "CELLS", cells)
        scorer = lexical.Scorer(block, 60, 240, np.full(60, 5))
        found.append(sorted(map(tuple, np.concatenate([np.column_stack(x) for x in scorer.scores(texts, np.ones(40, np.int64))]).tolist())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_large_sums_are_whole_numbers():
    class Row:
        item_id, text_key, term, times = 1, "a", "x", 1 << 20

    block = lexical.Block([Row])
    scorer = lexical.Scorer(block, 10**9, 10**9, np.array([0]))
    assert not scorer.doubles
    _, _, out = next(scorer.scores(pa.array(["x y"]), np.ones(1, np.int64)))
    m = 75 + 25 * 2 * 10**9 // 10**9
    assert out[0] == (1 << 20) * math.floor(1000 * math.log(2 * 10**9 + 2)) * (10**9 // (1000 + 12 * m))
    assert lexical._measure(np.array([10**10]), 10**10, 10**10)[0] == 75 + 25 * 10**10
