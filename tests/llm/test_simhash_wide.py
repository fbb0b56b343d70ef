import random
from collections import defaultdict

import numpy as np

from landweave.llm import simhash_wide as wide


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def classes(rows, least=0.8):
    """(id, text) to the smallest id of each class, from every pair that shares a shingle."""
    held = defaultdict(list)
    for d, t in rows:
        held[shingle_set(t)].append(d)
    keys = list(held)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, tried = defaultdict(list), set()
    for i, s in enumerate(keys):
        for j in {j for x in s for j in holders[x]}:
            o = keys[j]
            common = len(s & o)
            if common >= least * (len(s) + len(o) - common):
                root[find(i)] = find(j)
                tried.add((j, i))
        for x in s:
            holders[x].append(i)
    small = {}
    for i, k in enumerate(keys):
        small[find(i)] = min(min(held[k]), small.get(find(i), 1 << 60))
    return {d: small[find(i)] for i, k in enumerate(keys) for d in held[k]}, len(tried)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want, links = classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(docs).collect()}
    assert got.keys() == want.keys() and links >= 30
    # Every class found is part of a true one, and few of the documents that have a partner are lost.
    assert all(want[d] == want[c] for d, c in got.items())
    lost = sum(got[d] != want[d] for d in want)
    print("links", links, "documents not in their class", lost, "kept", len(set(got.values())), "true", len(set(want.values())))
    assert lost <= 0.1 * links


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, edited(rng, base, 1)) for i in range(600)] + [(1000 + i, edited(rng, base, 60)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)[0]


def test_cases(spark):
    long = " ".join(f"w{i % 5000}v{i // 7}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, long), (7, long), (8, long + " end"), (9, "é x y z"), (None, "é x y Z")]
    docs = spark.createDataFrame([(*r, "c", 0) for r in rows], "doc_id long, text string, node string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in wide.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 7), (9, 9), (None, 9)], key=str)
    assert wide.near_duplicates(docs.limit(0)).count() == 0


def family(pages, pairs, rng):
    """Pages of one template with 0.77 of their shingles in common, and near copies (0.82) of the first ``pairs``."""
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    base = new(400)
    tails = [new(59) for _ in range(pages)]
    tails += [t[:14] + new(45) for t in tails[:pairs]]
    return [(i, " ".join(base + t)) for i, t in enumerate(tails)]


def test_near_copies_in_a_family_of_one_template(spark):
    rows = family(300, 60, random.Random(3))
    want = classes(rows)[0]
    assert sum(want[d] != d for d in want) == 60
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[300 + i] == i for i in range(60))
    print("found", found, "of 60")
    assert all(got[d] in (d, want[d]) for d in got) and found >= 54


def test_large_keys_in_blocks_lose_no_pair(spark, monkeypatch):
    """One key holds nearly everything: a class of copies, and pages of one template that are all apart."""
    monkeypatch.setattr(wide, "BLOCK", 16)
    monkeypatch.setattr(wide, "SAMPLE", 2)
    monkeypatch.setattr(wide, "plan", lambda count, similarity, recall: (1, 2, 2))
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = family(40, 10, rng) + [(100 + i, edited(rng, base, 1)) for i in range(120)] + [(300 + i, edited(rng, base, 5)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows)[0]
    assert sum(want[d] == 100 for d in want) >= 120 and sum(want[d] != d for d in want if d < 50) == 10
    lost = [d for d in got if got[d] != want[d]]
    assert all(want[d] == want[c] for d, c in got.items()) and len(lost) <= 3


def test_rows_with_links_held_back_are_named():
    import pyarrow as pa

    size = wide.BITS // 8 + 4
    more = np.zeros(90, wide._SIDE)
    more["node"] = more["class"] = np.arange(90)
    more["inner"] = more["asks"] = 1
    raw = np.concatenate([np.tile(np.frombuffer(bytes(size - 4) + (50).to_bytes(4, "little"), np.uint8), (90, 1)), more.view(np.uint8).reshape(90, -1)], axis=1)
    k, none = np.repeat([1, 2], [20, 70]), pa.array([[5]] + [None] * 89, pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(k), wide._fixed(raw), none], names=["k", "row", "failed"])
    out = [x for o in wide._apart(0.5, 3)([batch.slice(0, 33), batch.slice(33)]) for x in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
    links, named = {x for x in out if x[0] != x[1]}, {a for a, b in out if a == b}
    assert (0, 5) not in links and all(sum(a == x for a, _ in links) <= 3 for x in range(90))
    # In a long run the rows of the commonest class, here the first, come last.
    assert named == set(range(16)) | set(range(21, 87))
    every = [x for o in wide._apart(0.5, 100)([batch]) for x in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
    assert len(every) == len(set(every)) == 20 * 19 // 2 - 1 + 70 * 69 // 2


def test_short_texts(spark):
    """Pairs that share 4 of 5, 8 of 10 and 12 of 15 shingles."""
    rng = random.Random(6)
    rows, pairs = [], 0
    for i in range(240):
        n = (4, 8, 12)[i % 3]
        words = [f"s{rng.randrange(10**9)}" for _ in range(n + 4)]
        more = n // 4
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"s{rng.randrange(10**9)}" for _ in range(more)]))]
        pairs += 1
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] in (d, d - d % 2) for d in got)
    assert sum(got[2 * i + 1] == 2 * i for i in range(240)) >= 0.9 * pairs


def test_cells_of_cut_keys_bring_every_pair_together_once():
    rng = np.random.default_rng(1)
    k, node = rng.integers(0, 4, 300), np.arange(300)
    label = np.where(rng.random(300) < 0.6, 1000, node)
    cut = wide.Cut([2, 0], [5, 3], [3, 3], [1000, -1])
    met = {}
    cells = {}
    for rows, key, side, inner in cut.cells(k, node, label):
        for r, c, x, i in zip(rows.tolist(), key.tolist(), side.tolist(), inner.tolist()):
            for o, y, j in cells.get(c, []):
                if label[r] != label[o] and (i or x != y):
                    pair = (min(r, o), max(r, o))
                    met[pair] = met.get(pair, 0) + 1
            cells.setdefault(c, []).append((r, x, i))
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if k[a] == k[b] and label[a] != label[b]}
    assert met.keys() == want and set(met.values()) == {1}


def test_only_rows_that_ask_have_links():
    import pyarrow as pa

    size = wide.BITS // 8 + 4
    for rows in (30, 90):
        more = np.zeros(rows, wide._SIDE)
        more["node"] = more["class"] = np.arange(rows)
        more["inner"], more["asks"][[3, 25]] = 1, 1
        raw = np.concatenate([np.tile(np.frombuffer(bytes(size - 4) + (50).to_bytes(4, "little"), np.uint8), (rows, 1)), more.view(np.uint8).reshape(rows, -1)], axis=1)
        batch = pa.record_batch([pa.array(np.zeros(rows, np.int64)), wide._fixed(raw)], names=["k", "row"])
        got = [x for o in wide._apart(0.5, 1000)([batch]) for x in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
        assert sorted(got) == sorted({(min(x, y), max(x, y)) for x in (3, 25) for y in range(rows) if x != y})
        got = [x for o in wide._apart(0.5, 4)([batch]) for x in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
        assert {a for a, b in got if a == b} == {3, 25} and sum(a != b for a, b in got) == 8


def test_only_texts_with_links_become_sets(spark, monkeypatch):
    rng, made, plain = random.Random(7), [], wide.sets
    monkeypatch.setattr(wide, "sets", lambda docs, shingle: (made.append(docs.count()), plain(docs, shingle))[1])
    base = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(200)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(i, edited(rng, base[i - 200], 1)) for i in range(200, 205)] + [(3, " ".join(base[3]))] * 5
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)[0] and 10 <= sum(made) <= 20


def test_runs_of_copies_are_not_gathered():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    raw = rng.integers(0, 256, (1, wide.BITS // 8 + 4), dtype=np.uint8).repeat(700, 0)
    flips = rng.integers(0, 40, 700)
    for row, f in zip(raw, flips):
        row[rng.choice(wide.BITS // 8, f // 8, replace=False)] ^= 1
        row[-4:] = [100, 0, 0, 0]
    k = np.repeat([5, 6, 7, 8, 9], [3, 500, 1, 64, 132])
    node = rng.permutation(700)
    batch, taken = pa.record_batch([pa.array(k), pa.array(node), wide._fixed(raw)], names=["k", "node", "fp"]), []

    def parts(size):
        for lo in range(0, 700, size):
            taken.append(lo)
            yield batch.slice(lo, size)

    fp, n = wide._parted(raw)
    want = set()
    for b in range(700):
        first = np.flatnonzero(k == k[b])[: wide.LEADERS]
        e = [(-float(wide.estimate(fp[a], n[a], fp[b], n[b])), a) for a in first if a < b]
        if e and -min(e)[0] >= wide.MAYBE:
            want.add((*sorted((int(node[min(e)[1]]), int(node[b]))), -min(e)[0]))
    for size in (1, 50, 700):
        found = wide._copies(parts(size))
        taken.clear()
        out = [next(found)]
        assert len(taken) == 1
        out += list(found)
        assert {x for o in out for x in zip(*(c.to_pylist() for c in o.columns))} == want and len(want) > 600


def test_few_keys_are_taken_for_named_ones():
    rng = np.random.default_rng(9)
    named, others = (rng.integers(0, 2**62, 80_000) for _ in range(2))
    cells = np.zeros(wide.CELLS, bool)
    cells[wide._cell(named)] = True
    bits = np.packbits(cells, bitorder="little")
    assert wide._marked(bits, named).all() and wide._marked(bits, others).mean() < 0.02


def test_sketches_fail_no_link_that_the_sets_would_not():
    rng = np.random.default_rng(10)
    sizes = np.r_[0, 1, 2, 15, 16, 17, rng.integers(1, 900, 150)]
    pool, one, other = rng.integers(0, 2**63, 3000, dtype=np.uint64), [], []
    for n in sizes:
        a = rng.choice(pool, n, replace=False)
        keep = a[rng.random(n) < rng.choice([0.4, 0.85, 0.9, 0.95, 1])]
        one.append(a)
        other.append(np.unique(np.r_[keep, rng.choice(pool, rng.integers(0, n // 4 + 1), replace=False), rng.choice(pool, rng.choice([0, n]), replace=False)]))
    made = [wide.sketches_of(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x), len(x)) for x in (one, other)]
    common, total = wide.most_common(*made)
    true = np.array([len(np.intersect1d(a, b)) for a, b in zip(one, other)])
    assert (total == [len(a) + len(b) for a, b in zip(one, other)]).all() and (common >= true).all()
    alike = true >= 0.7 * (total - true)
    assert (common <= true + 0.02 * total + 3)[alike].all() and alike.sum() > 40 and len({len(x) for x in made[0].to_pylist()}) > 4
    # Batches come as slices too.
    assert (wide.most_common(made[0].slice(20, 50), made[1].slice(20, 50))[0] == common[20:70]).all()


def test_links_that_fall_short_by_sketches_move_no_text(spark, monkeypatch):
    """Pages of one template are all linked (0.77 alike); only near copies become sets."""
    made, plain = [], wide.sets
    monkeypatch.setattr(wide, "sets", lambda docs, shingle: (made.append(docs.count()), plain(docs, shingle))[1])
    monkeypatch.setattr(wide, "plan", lambda count, similarity, recall: (1, 1, 1))
    rows = family(30, 6, random.Random(11))
    want = classes(rows)[0]
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("sets", sum(made))
    assert all(got[d] in (d, want[d]) for d in got) and sum(got[30 + i] == i for i in range(6)) >= 4
    assert sum(made) <= 20


def test_no_link_between_a_short_text_and_a_long_one():
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 2**63, (200, wide.WORDS), dtype=np.uint64)
    n = np.r_[np.full(100, 1.0), np.full(50, 4.0), np.full(50, 5.0)]
    i, j = np.triu_indices(200, 1)
    fp[150:] = fp[100:150]
    enough = wide._near(fp, n, i, j, 0.68)[1]
    assert not enough[(n[i] == 1) & (n[j] > 1)].any() and enough[(n[j] == 1)].all() and enough[j - i == 50][100:].all()
