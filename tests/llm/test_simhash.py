import random
from collections import Counter

import xxhash

from landweave.llm import simhash

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def classes(prints):
    """prints: list of (id, fp); the component by comparing all pairs."""
    ids = sorted({f for _, f in prints})
    root = {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in prints)


def test_whole_table(spark):
    docs = spark.read.parquet(DATA)
    want = classes([(r.doc_id, plain(r.text)) for r in docs.collect()])
    assert sorted(map(tuple, simhash.digest(docs).collect())) == want


def test_cases(spark):
    long = "w " * 30000 + "end"
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, long), (7, long), (8, "é x y z")]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.digest(docs).collect())) == classes([(d, plain(t)) for d, t in texts])
    assert simhash.digest(docs.limit(0)).count() == 0


def test_links_of_dense_groups(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from landweave.operators.components import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")), "a", "b").collect()
    got = {}
    for r in found:
        got.setdefault(r.component, set()).add(r.node % (1 << 64))
    want = {}
    for d, _, c in classes(list(enumerate(fps))):
        want.setdefault(c, set()).add(fps[d])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_long_keys():
    import numpy as np

    rng = random.Random(2)
    prefix = rng.getrandbits(40) << 24
    fps = {prefix | sum(1 << b for b in rng.sample(range(24), rng.choice([1, 2, 3, 9, 12]))) for _ in range(3000)}
    fps = np.array(rng.sample(sorted(fps), len(fps)), np.uint64)
    assert len(fps) > simhash.LONG
    for most in (0, 1, 2):
        a, b = simhash._probed(fps, most)
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= most).all() and simhash._forest(a, b).all()
        root = np.arange(len(fps))
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most)
            root[np.isin(root, root[near])] = root[near].min()
        assert len(a) == len(fps) - len(np.unique(root))
    # One key's stream: short and long runs side by side.
    key = np.repeat([5, 7, 9], [3, len(fps), 2])
    every = np.concatenate([fps[:3], fps, fps[:2]])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(key), pa.array(every.view(np.int64))], names=["k", "fp"])
    rows = [r for out in simhash._linker(2)([batch.slice(0, 700), batch.slice(700)]) for r in zip(*(c.to_pylist() for c in out.columns))]
    direct = simhash._linker(2)([batch.slice(0, 3)]), simhash._linker(2)([batch.slice(3, len(fps))]), simhash._linker(2)([batch.slice(3 + len(fps))])
    assert len(rows) == sum(len(o) for d in direct for o in d)
