"""Packing by non-negative least squares over length combinations.

Texts become token ids by a public vocabulary file, with an end id. Whole windows are cut off a document's front; what is left is
its tail, shorter than a window. Combinations of two to four tail lengths that fill a window exactly
are enumerated, and non-negative least squares finds how often to repeat each so that together they
use up the histogram of tail lengths. The repeats are rounded down to what the histogram holds. The
few residual tails are packed greedily end to end and cut where a window is full, so only the last
window can have padding; its content is split at powers of two, which need none.

The histogram has one row per length, and the plan a few rows per combination: both are bounded by the
window, whatever the input, and only they reach the driver. Tails are numbered within their length by
salted counts, so that a length shared by a third of the documents is no single task's work.

Cases: a null or empty text is the end id alone; the vocabulary's reserved strings inside a text become
their own ids, as its file says, unless ``reserved`` is false; rows are packed one by one, so repeated ids give
repeated pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm import textkit
from landweave.storage import materialize, partitions

END = 1
#: Bytes of text that are encoded at a time: equal words of a run are looked up once.
RUN = 4 << 20
#: White space outside ASCII; texts that hold it are encoded whole.
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Token ids of many texts at once, by a byte-level vocabulary file whose words begin at white space.

    Such a vocabulary never joins what is on both sides of these places: before a space that a word
    follows, on both sides of any other white space before a word, and before the rest of a run of white
    space. Texts are cut there into units; equal units of a chunk are encoded once and kept for the next.
    Texts with white space outside ASCII or with reserved strings are one unit. With ``pattern``, that of
    the vocabulary's words, new words are encoded by a faster library from the same file's ranks.
    """

    def __init__(self, vocabulary: str, reserved: bool = True, pattern: str | None = None, most: int = 200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not reserved
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids have 16 bits")
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if reserved else []
        self.whole = re.compile(b"|".join(re.escape(x.encode()) for x in [*_WIDE_SPACE, *strings]))
        # Without the first bytes of white space outside ASCII.
        self.encode_words = self._fast(pattern) if pattern else lambda text: self._ids(text.encode())
        self.word = re.compile(rb" ?[^\s<\xc2\xe1-\xe3]+")
        self.line = self._ids(b"\n")
        # Two generations of words: what is used again moves to the younger one.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most, self.longest = most, longest

    def _fast(self, pattern: str):
        import tiktoken

        # Byte-level vocabularies write printable bytes as themselves and the others, in order, as what follows 255.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _units(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the units of a run of texts."""
        n = len(buf)
        space = _SPACE[buf]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[off[:-1][off[:-1] < n]] = True
        last[off[1:][off[1:] > 0] - 1] = True
        before = np.r_[True, space[:-1]] | first
        after = np.r_[space[1:], True] | last
        # A run of white space begins a unit; its last character does too if a word follows; a word does
        # unless that character is a space.
        cut = first | (space & (~np.r_[False, space[:-1]] | ~after)) | (~space & before & (np.r_[0, buf[:-1]] != 32))
        data, at = buf.tobytes(), 0
        while found := self.whole.search(data, at):
            text = int(np.searchsorted(off, found.start(), "right")) - 1
            cut[off[text] + 1 : off[text + 1]] = False
            at = int(off[text + 1])
        return np.flatnonzero(cut)

    def _encoded(self, units: list[bytes]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        if self.older:
            self.cache.update((u, self.older[u]) for u in units if u in self.older)
        new = [u for u in units if u not in self.cache]
        made = {}
        # Words are encoded many at a time, with line ends between them, which no word's ids hold.
        words = [u for u in new if len(u) <= self.longest and self.word.fullmatch(u)]
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            ids = np.array(self.encode_words(b"\n".join(part).decode("utf-8", "replace")), "<u2")
            line = self.line[0]
            ends = np.append(np.flatnonzero(ids == line), len(ids))
            raw, at = ids.tobytes(), 0
            for u, end in zip(part, ends.tolist()):
                made[u] = raw[2 * at : 2 * end]
                at = end + 1
        self.cache.update(made)
        for u in new:
            if u not in made:
                made[u] = np.array(self._ids(u), "<u2").tobytes()
        return [made[u] if u in made else self.cache[u] for u in units]

    def _ids(self, text: bytes) -> list[int]:
        # The fast form keeps no offsets.
        return self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, an end id after each, and where each text's ids end."""
        at = self._units(buf, off)
        bounds = np.r_[at, len(buf)].astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = pc.dictionary_encode(units)
        known = [*self._encoded(coded.dictionary.to_pylist()), np.array([END], "<u2").tobytes()]
        # A run of texts has fewer ids than bytes: 32 bits hold every place.
        size = np.array([len(x) // 2 for x in known], np.int32)
        start, flat = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(known), "<u2")
        # The end id is one more unit behind those of each text.
        ends = np.searchsorted(at, off[1:])
        which = np.insert(coded.indices.to_numpy(), ends, len(known) - 1)
        lengths = size[which]
        total = np.cumsum(lengths, dtype=np.int32)
        places = np.repeat(start[which] - (total - lengths), lengths)
        places += np.arange(len(places), dtype=np.int32)
        ids, total = flat[places], total.astype(np.int64)
        return ids, total[ends + np.arange(len(ends))]


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", reserved: bool = True, pattern: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n`` ids with the end id, and ``ids`` as little-endian 16-bit numbers."""

    def run(batches):
        encode = Encoder(vocabulary, reserved, pattern)
        for b in batches:
            for lo, buf, off in textkit.chunks(b.column(1), RUN):
                ids, ends = encode(buf, off)
                where = np.r_[0, 2 * ends].astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.record_batch([b.column(0).slice(lo, len(ends)), pa.array(np.diff(np.r_[0, ends])), blob], names=["doc_id", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n long, ids binary")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def combinations(window: int, histogram: np.ndarray, step: int = 32) -> np.ndarray:
    """Rows of up to four lengths (0 for none) that fill the window: all pairs, and triples and quadruples of
    which one, or two, lengths are multiples of ``step``; only lengths that occur."""
    have = histogram > 0
    a = np.arange(1, window)
    grid = np.arange(step, window, step)
    pairs = np.stack([a, window - a], 1)
    g, b = (x.ravel() for x in np.meshgrid(grid, a))
    triples = np.stack([g, b, window - g - b], 1)
    g, k, b = (x.ravel() for x in np.meshgrid(grid[::4], grid[::4], a[:: max(1, step // 8)]))
    fours = np.stack([g, k, b, window - g - k - b], 1)
    equal = np.stack([a, a, window - 2 * a], 1)
    rows = np.concatenate([np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in (pairs, equal, triples, fours)])
    rows = np.sort(rows[(rows >= 0).all(1) & ((rows > 0).sum(1) >= 2)], axis=1)[:, ::-1]
    rows = np.unique(rows, axis=0)
    return rows[np.where(rows > 0, have[rows], True).all(1)]


def nnls(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference of used and present lengths (projected coordinate steps by damped sweeps)."""
    size, used = len(histogram), rows > 0
    x = np.zeros(len(rows))
    # The Lipschitz bound by the largest column and row sums of the incidence matrix.
    degree = np.bincount(rows[used], minlength=size).astype(float)
    damp = (used * degree[rows]).sum(1)
    damp[damp == 0] = 1
    for _ in range(rounds):
        load = np.bincount(rows[used], weights=np.broadcast_to(x[:, None], rows.shape)[used], minlength=size)
        x = np.maximum(0, x + (used * (histogram - load)[rows]).sum(1) / damp)
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations with whole repeat counts: (count, lengths ...), never using more than the histogram holds."""
    rows = combinations(window, histogram)
    if not len(rows):
        return []
    x = nnls(rows, histogram.astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for final in (False, True):
        for i in np.argsort(-x, kind="stable").tolist():
            lengths = [int(v) for v in rows[i] if v]
            times = {v: lengths.count(v) for v in lengths}
            most = min(left[v] // k for v, k in times.items())
            n = int(most if final else min(most, np.floor(x[i] + 1e-9)))
            if n > 0:
                for v, k in times.items():
                    left[v] -= k * n
                out.append((n, *lengths))
    return out


def _ranges(combos: list[tuple[int, ...]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each slot of each combination."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, *lengths in combos:
        offset = 0
        for v in lengths:
            lo = used.get(v, 0)
            out.append((v, lo, lo + n, sequence, offset))
            used[v] = lo + n
            offset += v
        sequence += n
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", reserved: bool = True, pattern: str | None = None) -> DataFrame:
    """Pieces: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian 16-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, vocabulary, id_col, text_col, reserved, pattern).withColumn("row", F.monotonically_increasing_id()))
    length = (F.col("n") % window).cast("int")
    salts = 4 * partitions(spark)
    tails = tokens.where(length > 0).select("row", "doc_id", "n", length.alias("length"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    counts = materialize(tails.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("k")))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect():
        histogram[r.length] = r.k
    # Whole windows are sequences of their own and come first, numbered by salt and row.
    whole = tokens.where(F.col("n") >= window).select("row", F.floor(F.col("n") / window).cast("long").alias("k"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    windows = [0] * salts
    for r in whole.groupBy("salt").agg(F.sum("k").alias("k")).collect():
        windows[r.salt] = r.k
    starts = spark.createDataFrame([(i, sum(windows[:i])) for i in range(salts)], "salt int, begin long")
    whole = whole.withColumn("own", F.sum("k").over(Window.partitionBy("salt").orderBy("row")) - F.col("k")).join(F.broadcast(starts), "salt")
    whole = whole.select("row", (F.col("own") + F.col("begin")).alias("first"))
    slots = _ranges(plan(histogram, window))
    base = sum(windows) + max([0, *(s + hi - lo for _, lo, hi, s, _ in slots)])
    # Residual tails lie end to end by (length, rank); lay[v] is where the first residual of length v begins.
    taken = np.zeros(window + 1, np.int64)
    for v, _, hi, _, _ in slots:
        taken[v] = max(taken[v], hi)
    rest = (histogram - taken) * np.arange(window + 1)
    lay = np.cumsum(rest) - rest
    total = int(rest.sum())
    shape = "length int, lo long, hi long, sequence long, at long"
    slots += [(v, int(taken[v]), int(histogram[v]), -1, int(lay[v])) for v in range(1, window + 1) if histogram[v] > taken[v]]
    offsets = counts.select("length", "salt", (F.sum("k").over(Window.partitionBy("length").orderBy("salt")) - F.col("k")).alias("before"))
    ranked = tails.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")).cast("long") - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # A few rows for each of at most ``window`` lengths.
    placed = ranked.join(F.broadcast(spark.createDataFrame(slots, shape)), "length").where("rank >= lo and rank < hi")
    placed = placed.select("row", "sequence", (F.col("at") + F.when(F.col("sequence") < 0, (F.col("rank") - F.col("lo")) * F.col("length")).otherwise(0)).alias("at"), (F.col("rank") - F.col("lo")).alias("step"))
    # The ids move once: where a row's parts go is put together first.
    places = placed.join(whole, "row", "full_outer")
    joined = tokens.join(places, "row", "left").select("doc_id", "n", "ids", "sequence", "at", "step", "first")
    before, last = sum(windows), total // window * window

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, n, every, sequence, at, step, first in zip(*(c.to_pylist() for c in b.columns)):
                begin = n // window * window
                pieces = [(i, window, every[2 * i : 2 * (i + window)], first + i // window, 0) for i in range(0, begin, window)]
                ids = np.frombuffer(every, "<u2")[begin:]
                if len(ids) and sequence >= 0:
                    pieces.append((begin, len(ids), ids.tobytes(), before + sequence + step, at))
                elif len(ids):
                    cuts = [at, *range((at // window + 1) * window, at + len(ids), window), at + len(ids)]
                    cuts = sorted({*cuts, *(c for c in _powers(last, total) if at < c < at + len(ids))})
                    for lo, hi in zip(cuts, cuts[1:]):
                        seq, off = (base + lo // window, lo % window) if lo < last else _last(lo, last, total, base + last // window)
                        pieces.append((begin + lo - at, hi - lo, ids[lo - at : hi - at].tobytes(), seq, off))
                for start, size, part, seq, off in pieces:
                    for c, v in zip(out, (doc, start, size, part, n, seq, off)):
                        c.append(v)
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.record_batch([pa.array(out[0], b.column(0).type), *(pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names[1:], out[1:]))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def checksums(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32``, the checksum of the ids as 32-bit numbers, in place of ``ids``."""
    at = pieces.columns.index("ids")

    def run(batches):
        for b in batches:
            crc = pa.array([_crc(np.frombuffer(x.as_py(), "<u2")) for x in b.column(at)], pa.int64())
            yield pa.record_batch([crc if i == at else c for i, c in enumerate(b.columns)], names=["ids_crc32" if i == at else k for i, k in enumerate(b.schema.names)])

    shape = ", ".join("ids_crc32 long" if f.name == "ids" else f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, shape)


def _powers(last: int, total: int) -> list[int]:
    """Where the last, short window is split so that every part is a power of two long."""
    out, at = [], last
    for bit in reversed(range((total - last).bit_length())):
        if (total - last) >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def _last(lo: int, last: int, total: int, first_sequence: int) -> tuple[int, int]:
    starts = _powers(last, total)
    i = max(k for k, s in enumerate(starts) if s <= lo)
    return first_sequence + i, lo - starts[i]


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return checksums(pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN))
