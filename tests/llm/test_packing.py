import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from landweave.llm import packing

DATA = "/root/testdata/sf0.01/documents.parquet"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, rows):
    """Every id of every row is in one piece; sequences have no gaps; returns padded and used positions."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(ids_of(t))
    assert set(by_doc) == set(want)
    for d, lists in want.items():
        if len(lists) > 1:
            assert sum(map(len, lists)) == sum(p.length for p in by_doc[d])
            continue
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            part = np.array(lists[0][p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(part), len(lists[0]))
            at += p.length
        assert at == len(lists[0])
    pad = used = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        used += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad, used


def test_whole_table(spark):
    docs = spark.read.parquet(DATA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.digest(docs).collect()
    pad, used = check(pieces, rows)
    assert pad == 0
    assert len(pieces) < 1.3 * sum(-(-p.doc_tokens // 2048) for p in {p.doc_id: p for p in pieces}.values())


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b\n\nc\td"), (5, "word " * 5000), (5, "word " * 5000), (6, "é漢字 it's x <|endoftext|>\0y\r\n"), (7, "x\n" * 2047), (8, " lead and trail ")]
    rows += [(100 + i, "same length text") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, length int")
    assert check(packing.digest(docs).collect(), rows)[0] == 0
    assert packing.digest(docs.limit(0)).count() == 0


def test_ids_are_the_vocabulary_files(spark):
    import random

    import pyarrow as pa

    from landweave.llm import textkit

    rng = random.Random(1)
    atoms = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "é", "漢字", "'s", "it's", "123", "!", "...", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "\0", "<|endoftext|>", "<|", "½", "🎈", "_", "\ufeff", "\u200b"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["".join(rng.choice("abeé_-.,'’漢🎈½1 ") for _ in range(30)) for _ in range(3000)] + ["x" * 20000, " " * 3000, "\n" * 3001 + "x", None]
    for reserved in (True, False):
        other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        other.encode_special_tokens = not reserved
        encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), reserved, public_tokenizers.PATTERN if reserved else None, most=500)
        got = []
        for _, buf, off in textkit.chunks(pa.array(texts), 4096):
            ids, ends = encode(buf, off)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [other.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_plan_keeps_to_the_histogram():
    rng = np.random.default_rng(2)
    h = np.zeros(257, np.int64)
    h[1:256] = rng.poisson(40, 255)
    used = np.zeros(257, np.int64)
    for n, *lengths in packing.plan(h, 256):
        assert sum(lengths) == 256 and n > 0
        np.add.at(used, lengths, n)
    assert (used <= h).all()
    share = (used * np.arange(257)).sum() / (h * np.arange(257)).sum()
    assert share > 0.9


def test_repeat_counts_are_least_squares():
    """Beside coordinate descent to convergence, which solves small problems exactly."""
    rng = np.random.default_rng(4)
    for window in (16, 40):
        h = np.zeros(window + 1, np.int64)
        h[1:window] = rng.poisson(30, window - 1) * (rng.random(window - 1) < 0.8)
        rows = packing.combinations(window, h, step=4)
        use = np.stack([np.bincount(r[r > 0], minlength=window + 1) for r in rows], 1).astype(float)
        x = np.zeros(len(rows))
        left = h.astype(float)
        for _ in range(3000):
            for j in range(len(rows)):
                step = max(-x[j], use[:, j] @ left / (use[:, j] @ use[:, j]))
                x[j] += step
                left -= step * use[:, j]
        best = left @ left
        mine = h - use @ packing.nnls(rows, h.astype(float), rounds=3000)
        assert (packing.nnls(rows, h.astype(float)) >= 0).all() and mine @ mine <= 1.02 * best + 1e-6


def test_pack_gives_the_sequences(spark):
    rows = [(1, "word " * 5000), (2, None), (3, "a few words"), (4, "other words here " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    for d, t in rows:
        mine = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u2") for p in mine]).tolist() == ids_of(t)
        assert all(len(p.ids) == 2 * p.length for p in mine)
