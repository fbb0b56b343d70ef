import random
import re

import numpy as np

from landweave.llm import decontam

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(item, doc):
    best, prev = 0, [0] * (len(doc) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(doc):
            row.append(max(0, prev[j] + (2 if a == b else -1), prev[j + 1] - 1, row[j] - 1))
            best = max(best, row[-1])
        prev = row
    return best


def test_align_is_smith_waterman():
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 20))]
        got, _ = decontam.align(np.array([a], np.uint64) + np.uint64(10), np.array([b], np.uint64) + np.uint64(10))
        assert got[0] == plain(a, b)


def test_whole_table_holds_every_passage(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    items = {r.item_id: words(r.text) for r in bench.collect()}
    got = {}
    for r in decontam.matches(docs, bench).collect():
        got[r.doc_id, r.item_id] = max(r.score, got.get((r.doc_id, r.item_id), 0))
    # Brute force: pairs that share a run of six words are aligned in full.
    runs = {i: {tuple(w[k : k + 6]) for k in range(len(w) - 5)} for i, w in items.items()}
    want = {}
    for d, w in texts.items():
        mine = {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
        for i, r in runs.items():
            if r & mine:
                s = plain(items[i], w)
                if s >= 2 * max(0.5 * len(items[i]), min(len(items[i]), 8)):
                    want[d, i] = s / (2 * len(items[i]))
    assert want and {k: round(v, 9) for k, v in got.items() if k in want} == {k: round(v, 9) for k, v in want.items()}
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_edited_copies_and_cases(spark):
    rng = random.Random(11)
    item = [f"word{i}" for i in range(40)]
    edited = item[:]
    for i in range(3, 40, 8):
        edited[i] = "changed"
    gone = item[:10] + item[12:30] + ["extra", "words"] + item[30:]
    other = " ".join(rng.choice(item) for _ in range(300))
    texts = {1: None, 2: "", 3: " ".join(edited), 4: "Lead in. " + ", ".join(gone).upper() + "!", 5: other, 6: " ".join(item[:12]), 7: "x y " * 40000 + " ".join(item), 8: "tiny item"}
    docs = spark.createDataFrame([(k, v, 9, 0.5) for k, v in texts.items()] + [(3, texts[3], 1, 1.0)], "doc_id long, text string, item_id int, score double")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "tiny item"), (4, "")], "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(3, 1), (4, 1), (7, 1), (8, 3)}
    assert {(r.start_word, r.end_word, r.score) for r in rows if r.doc_id == 7} == {(80000, 80040, 1.0)}
    assert {(r.start_word, r.end_word) for r in rows if r.doc_id == 4} == {(2, 42)}
    assert {r.doc_id for r in decontam.matches(docs, bench, block_words=10).collect()} == {3, 4, 7, 8}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert decontam.matches(docs.limit(0), bench).count() == decontam.matches(docs, bench.limit(0)).count() == 0


def test_full_alignment_without_shared_runs(spark):
    """Whatever a full alignment finds is found, copies edited every few words and spread copies included."""
    rng = random.Random(5)
    items = {k: [f"w{k}x{i}" for i in range(n)] for k, n in enumerate((40, 40, 21, 16, 9))}
    docs, texts = [], {}
    for k, item in items.items():
        n = len(item)
        edits = [[("new" if i % step == step - 1 else w) for i, w in enumerate(item)] for step in (3, 4, 5, 6, 7)]
        edits += [[x for w in item for x in (w, "in")], [x for i, w in enumerate(item) for x in ([w, "in", "in"] if i % 2 else [w])]]
        edits += [item[: n // 2] + ["far"] * (n // 2) + item[n // 2 :], item[: n // 4] + item[n // 2 :], [w for i, w in enumerate(item) if i % 4]]
        for _ in range(20):
            e = [w for w in item if rng.random() > 0.1]
            edits.append([x for w in e for x in (["new"] if rng.random() < 0.15 else [w, "in"] if rng.random() < 0.3 else [w])])
        docs += [["lead"] * 5 + e + ["tail"] * 5 for e in edits]
    docs += [items[0] + ["gap"] * 3 + items[0], [rng.choice(items[0]) for _ in range(200)]]
    texts = dict(enumerate(docs))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    rows, got = decontam.matches(frame, bench).collect(), {}
    for r in rows:
        got[r.doc_id, r.item_id] = max(round(2 * r.score * len(items[r.item_id])), got.get((r.doc_id, r.item_id), 0))
    want = {}
    for d, w in texts.items():
        for k, item in items.items():
            if set(w) & set(item) and (s := plain(item, w)) >= 2 * max(0.5 * len(item), min(len(item), 8)):
                want[d, k] = s
    assert got == want and len(want) > 60
    twice = len(docs) - 2
    assert {(r.start_word, r.end_word) for r in rows if r.doc_id == twice} == {(0, 40), (43, 83)}


def test_items_of_one_and_two_words(spark):
    """Short items are found where a full alignment finds them: all their words together, nowhere else."""
    items = {1: "Alpha", 2: "beta gamma", 3: "delta", 4: "eps zeta eta"}
    texts = {1: "alpha", 2: "x ALPHA, y", 3: "beta x gamma", 4: "a beta-gamma b", 5: "gamma beta", 6: "alphabet", 7: "", 8: "delta delta", 9: "eps zeta x eta"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if words(x) and plain(words(x), words(t)) >= 2 * len(words(x))}
    assert got == want == {(1, 1), (2, 1), (4, 2), (8, 3)}


def test_memory_of_a_phrase_that_many_items_share(monkeypatch):
    """One text of many repeats of a phrase that opens many items: places are made a bounded number at a time, and nothing is lost."""
    import tracemalloc

    import pyarrow as pa

    phrase = "what is the name of"
    texts = [f"{phrase} thing{i} and why" for i in range(4000)]
    held = decontam.Items(list(range(4000)), texts, 0.5, 8)
    doc = pa.array([" ".join([phrase] * 400) + " " + texts[17]])
    found = []
    for bound in (1 << 40, 1 << 16):
        monkeypatch.setattr(decontam, "EXPANDED", bound)
        tracemalloc.start()
        hits = [tuple(np.concatenate(c).tolist()) for c in zip(*[(r, i, s, e) for r, i, s, e, _ in decontam.find(held, doc)])]
        found.append((sorted(zip(*hits)), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert found[0][0] == found[1][0] and any(h[1] == 17 for h in found[0][0])
    assert found[1][1] < 40 << 20 and found[1][1] < found[0][1] / 4
