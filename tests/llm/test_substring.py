import hashlib
import random
import re

from landweave.llm import substring

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(rows, k=13):
    first, split = {}, []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append((d, words))
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            first[w] = min(d, first.get(w, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - k + 1):
            if first[tuple(words[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(docs):
    return sorted(tuple(r)[:4] for r in substring.digest(docs).collect())


def test_whole_table(spark):
    docs = spark.read.parquet(DATA)
    assert run(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice(["a", "b", "cc", "é"]) for _ in range(n))
    hot = word(30)
    rows = [(1, None), (2, ""), (3, " \t "), (4, word(12)), (5, word(13)), (9, "x"), (-4, word(40) + hot)]
    rows += [(10 + i, word(rng.randrange(60)) + " " + hot + "\n" + word(5)) for i in range(60)]
    rows += [(100 + i, hot) for i in range(20)] + [(110, hot), (200, hot + " " + hot + " " + hot), (201, word(5000)), (202, "z " * 3000), (7, "z " * 20)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, d int, tag string").repartition(7)
    assert run(docs) == plain(rows)
    assert run(docs.limit(0)) == []


def test_nul_bytes_are_word_characters(spark):
    text = "a\x00b " * 13
    docs = spark.createDataFrame([(1, text), (2, "ab " * 13), (3, text + "q")], "doc_id long, text string")
    assert run(docs) == plain([(1, text), (2, "ab " * 13), (3, text + "q")])


def test_spans_hold_source_coordinates(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "p q " + body), (2, "r " + body + " s"), (None, "t")], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.dedup(docs).collect()}
    assert spans == {None: [], 1: [], 2: [(1, 60, 1, 2)]}


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    rng = random.Random(9)
    body = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(20)) for c in "abc"]
    rows = [(1, body[0]), (1, body[1]), (5, "x y " + body[0]), (5, "z " * 9 + body[1]), (5, body[2]), (None, body[2] + " q"), (None, body[0] + " r"), (5, "x y " + body[0])]
    got = [tuple(r) for r in substring.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(plain_by_row(rows), key=str)


def plain_by_row(rows, k=13):
    first = {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        words = t.split()
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            first[w] = min(key(d), first.get(w, 1 << 62))
    for d, t in rows:
        words = t.split()
        gone = {i + j for i in range(len(words) - k + 1) if first[tuple(words[i : i + k])] < key(d) for j in range(k)}
        yield d, len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_long_words_that_swap_blocks_differ():
    import pyarrow as pa

    from landweave.llm import textkit

    x, y = "a" * 4096, "b" * 4096
    for which in (0, 1):
        h = [textkit.Words(buf, off).hashes(which) for t in (x + y, y + x) for _, buf, off in textkit.chunks(pa.array([t]))]
        assert h[0] != h[1]


def test_paths_are_walks_cut_at_branches(spark):
    """Every edge of a walk lies in one path; walks begin and end at ends of paths; depths are right."""
    rng = random.Random(2)
    rows = [(t, p0, s, q, n) for t in range(60) for p0, s, q, n in [(rng.randrange(5), rng.randrange(3), rng.randrange(40), rng.randrange(1, 20))]] * 1 + [(99, 0, 7, 3, 4)] * 3
    spans = spark.createDataFrame(rows, "t long, p int, s long, q int, edges int")
    compact = substring.paths(spans)
    got = {(r.s, r.q): (r.edges, r.texts) for r in compact.collect()}
    depth = {}
    for _, _, s, q, n in rows:
        for e in range(q, q + n):
            depth[s, e] = depth.get((s, e), 0) + 1
    covered = {}
    for (s, q), (n, texts) in got.items():
        for e in range(q, q + n):
            assert (s, e) not in covered and depth[s, e] == texts
            covered[s, e] = (s, q)
    assert covered.keys() == depth.keys()
    ends = {(s, q) for _, _, s, q, _ in rows} | {(s, q + n) for _, _, s, q, n in rows}
    assert all((s, q) in ends and (s, q + n) in ends for (s, q), (n, _) in got.items())
    assert all(not any((s, e) in ends for e in range(q + 1, q + n)) for (s, q), (n, _) in got.items())
    parts = sorted((r.t, r.p - r.q, r.s, e) for r in substring.walked(spans.distinct(), compact).collect() for e in range(r.q, r.q + r.edges))
    assert parts == sorted({(t, p0 - q, s, e) for t, p0, s, q, n in set(rows) for e in range(q, q + n)})
