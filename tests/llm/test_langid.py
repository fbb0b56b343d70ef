import random
import zlib

import numpy as np

from landweave.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.digest(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def plain(text, top):
    from collections import Counter

    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del counts[" "]
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [key(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][:top]


def test_profile_is_rank_order():
    text = "The cat sat on the mat, and THE dog (é) ran 42 times_over. 漢字"
    for top in (5, 20, 400):
        assert langid.profile(text, top).tolist() == plain(text, top)


def test_cases(spark):
    train = [(i, "the and of that with this from have", "en") for i in range(20)] + [(100 + i, "der die und das nicht mit ein ist", "de") for i in range(20)]
    odd = [(200, None, "en"), (201, "", None), (202, "12 34 !!", "en"), (203, "das und nicht " * 20000, None), (204, "with this", "de"), (None, "with that", "en"), (204, "with this", "de"), (205, "½ ²  ①", "de")]
    docs = spark.createDataFrame([(*r, "x", 0.1) for r in train + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    rows = langid.digest(docs).collect()
    got = {(r.doc_id): (r.lang_pred, r.held_out) for r in rows}
    assert len(rows) == 48 and [got[i][0] for i in (200, 201, 202, 203, 204, None, 205)] == ["und", "und", "und", "de", "en", "en", "und"]
    assert got[None][1] is False
    assert langid.digest(docs.limit(0)).count() == 0


def test_distance_and_score_are_the_plain_ones():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde é½1") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["漢字 abc", "zzzz"]
    top = 30
    profiles = {k: np.array(plain(" ".join(texts[i::3]), top), np.int64) for i, k in enumerate(("x", "y", "z"))}
    predict = langid._predictor(profiles, top)
    for text in texts:
        mine = plain(text, top) if any(map(str.isalpha, text)) else []
        far = {k: sum(abs(list(p).index(g) - i) if g in p else top for i, g in enumerate(mine)) for k, p in profiles.items()}
        want = min(far, key=lambda k: (far[k], k)) if mine else "und"
        assert predict(text) == (want, 1 - far[want] / (top * len(mine)) if mine else 0.0)


def test_labels_are_bounded(spark):
    rows = [(i, "the and of", "en") for i in range(9)] + [(100 + i, "der die", f"odd{i}") for i in range(50)] + [(200, "12", "digits")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, languages=3)) == {"en", "odd0"}
