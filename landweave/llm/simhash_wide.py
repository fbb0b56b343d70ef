"""SimHash near-duplicates at a stated Jaccard similarity of word shingles.

Two bits of 64 only hold texts that are all but equal, so this form of the operator takes 512-bit
fingerprints of the distinct shingles. A band is a random choice of bits with twelve references
(pivots); a fingerprint's coordinates there are its Hamming distances to them inside the band. Pairs
whose coordinates differ on every band are discarded. The number of bits in a band follows log2 of the
number of fingerprints, and the number of bands is what finds a pair of just that similarity with
probability ``recall`` (more alike pairs are found more surely). Survivors whose fingerprints estimate
at least ``similarity - SLACK`` are candidates, and those are verified by their exact shingle sets. Bits
of few shingles say less, so texts of under ``SHORT`` shingles get more bands and more slack.

Equal fingerprints are one row before any of that. The search then has two parts:

1. *Groups of copies.* In a few bands each row is held against the first ``LEADERS`` rows of its key and
   takes one link to the best of them, if that may be a copy. These links are verified and make classes,
   so a group of any size costs a few links a row from here on.
2. *All pairs of two classes.* In every band each row is compared with the rows of its key that are in
   other classes, and gives at most ``FIRST`` links to the best of them; rows whose links were held back
   are named. Keys that are large in a sixteenth of the rows are cut into blocks, and pairs of blocks are
   compared by tasks of their own; where most of such a key is one class, only the others go to all blocks.

All links are verified, first the best of every class, then what still runs between two classes. Most fall
short already by the sketches of their ends (parities of the numbers of shingles in cells), which bound the
similarity from above and so fail no link that the sets would not. Shingle sets are made of texts that have
links left to verify, and of no others, so no text but theirs is sorted or kept. Named
rows ask again with a larger allowance, the classes and failed links known, until nothing is held back;
only rows of keys that a named row has move then. So within the bands no pair is lost to a group's size,
and no class rests on a link below ``similarity``.

Cases: texts without words are one class; with fewer words than a shingle, all words are one shingle;
rows that repeat an id or text are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm import textkit
from landweave.operators.components import connected_components
from landweave.operators.skew import join_counted
from landweave.storage import discard, materialize, partitions

BITS, PIVOTS, SLACK, SHORT, PASS = 512, 12, 0.12, 32, 16
MAYBE, LEADERS, COPY_BANDS = 0.76, 64, 4
#: Links a row and key at first; rows of a run that are compared offset by offset; rows of a block; the most keys that are cut (their table goes to all tasks); one row in so many tells which.
FIRST, SMALL, BLOCK, LARGE, SAMPLE = 2, 64, 1024, 100_000, 16
_SIDE = np.dtype([("node", "<i8"), ("class", "<i8"), ("side", "<u4"), ("inner", "u1"), ("asks", "u1")])
FEW = 200_000
#: Keys fall into so many cells where named rows tell which keys they have: a bit each in all tasks.
CELLS = 1 << 23
#: Bytes of text that a task hashes at once.
TEXT = 1 << 19
WORDS = BITS // 64
_ADD = np.random.default_rng(512).integers(1, 2**63, WORDS, dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)
#: ASCII letters in lower case; white space separates.
LOWER_WORDS = textkit.SPACE_WORDS.copy()
LOWER_WORDS[65:91] += 32


def shingles(words: textkit.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and distinct shingle hashes, ascending by both."""
    h, first, doc = words.hashes(), words.first, words.doc()
    at = textkit.within(first, n)
    docs, found = [doc[at]], [textkit.grams(h, n)[at]]
    count = np.diff(first)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        docs.append(short)
        found.append(textkit.grams(h, size)[first[short]])
    d, g = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def fingerprints_of(d: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, WORDS) majority fingerprints and numbers of shingles; counts run in byte lanes, 255 at a time."""
    count = np.bincount(d, minlength=n)
    at = np.cumsum(count) - count
    groups = -(-count // 255)
    head = np.cumsum(groups) - groups
    fp = np.zeros((n, WORDS), np.uint64)
    if not len(g):
        return fp, count
    starts = np.repeat(at - head * 255, groups) + np.arange(int(groups.sum())) * 255
    some = np.flatnonzero(count)
    for j in range(WORDS):
        x = textkit._mix(g ^ _ADD[j])
        bits = np.empty((len(some), 8, 8), bool)
        for s in range(8):
            lanes = np.add.reduceat((x >> np.uint64(s)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes, head[some], axis=0, dtype=np.int64)
            bits[:, :, s] = votes * 2 > count[some, None]
        fp[some, j] = np.packbits(bits.reshape(len(some), 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return fp, count


def sketches_of(d: np.ndarray, g: np.ndarray, n: int) -> pa.Array:
    """Of each text its number of shingles (4 bytes) and, a bit each, whether a cell has an odd number of them; the cells are a power of two, at least four a shingle.

    The exclusive or of two sketches is the sketch of the shingles that only one of them has, of which there are at least as many as bits in it.
    """
    count = np.bincount(d, minlength=n)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * count, 1))).astype(np.int64))
    at = (np.cumsum(cells) - cells)[d] + (g & (cells[d] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(cells.sum())) & 1).astype(np.uint8), bitorder="little")
    off = np.concatenate([[0], np.cumsum(4 + cells // 8)])
    out, bits = np.zeros(off[-1], np.uint8), np.ones(off[-1], bool)
    head = off[:-1, None] + np.arange(4)
    out[head], bits[head] = count.astype("<u4")[:, None].view(np.uint8), False
    out[bits] = odd
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(out)])


def most_common(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches the most shingles that both texts can have, and the sum of their numbers. The longer sketch is folded to the cells of the shorter."""
    (bufs, offs), size = zip(*((np.frombuffer(x.buffers()[2], np.uint8), np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]) for x in (a.cast(pa.large_binary()), b.cast(pa.large_binary())))), len(a)
    lens = np.stack([np.diff(o) for o in offs], axis=1)
    common, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for pair in np.unique(lens, axis=0):
        rows = np.flatnonzero((lens == pair).all(axis=1))
        for some in np.array_split(rows, -(-len(rows) * int(pair.max()) // TEXT)):
            folded, counts = [], []
            for buf, off, length in zip(bufs, offs, pair):
                whole = buf[off[some][:, None] + np.arange(length)]
                counts.append(np.ascontiguousarray(whole[:, :4]).view("<u4")[:, 0].astype(np.int64))
                folded.append(np.bitwise_xor.reduce(whole[:, 4:].reshape(len(some), -1, int(pair.min()) - 4), axis=1))
            total[some] = counts[0] + counts[1]
            common[some] = np.minimum((total[some] - np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)) // 2, np.minimum(*counts))
    return common, total


def _fixed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def prints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``fp`` (fingerprint and number of shingles) and ``sketch``."""

    def run(batches):
        for b in batches:
            for lo, buf, off in textkit.chunks(b.column(2), TEXT):
                n = len(off) - 1
                d, g = shingles(textkit.Words(buf, off, LOWER_WORDS), shingle)
                fp, count = fingerprints_of(d, g, n)
                both = np.concatenate([fp.view(np.uint8).reshape(n, -1), count.astype("<u4")[:, None].view(np.uint8)], axis=1)
                yield pa.record_batch([b.column(0).slice(lo, n), b.column(1).slice(lo, n), _fixed(both), sketches_of(d, g, n)], names=["doc_id", "h", "fp", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, h long, fp binary, sketch binary")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node`` and the array ``s`` of its distinct shingles, from ``node`` and ``text``."""

    def run(batches):
        for b in batches:
            for lo, buf, off in textkit.chunks(b.column(1), TEXT):
                n = len(off) - 1
                d, g = shingles(textkit.Words(buf, off, LOWER_WORDS), shingle)
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int32)
                yield pa.record_batch([b.column(0).slice(lo, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], names=["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _raw(col: pa.Array) -> np.ndarray:
    """Rows of a column of equally long bytes."""
    if not len(col):
        return np.zeros((0, BITS // 8 + 4), np.uint8)
    size = len(col[0].as_py())
    col = col.cast(pa.binary(size))
    return np.frombuffer(col.buffers()[1], np.uint8).reshape(-1, size)[col.offset : col.offset + len(col)]


def _parted(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and numbers of shingles."""
    size = BITS // 8
    return np.ascontiguousarray(raw[:, :size]).view(np.uint64), np.ascontiguousarray(raw[:, size : size + 4]).view("<u4")[:, 0].astype(np.float64)


def estimate(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from Hamming distances and set sizes."""
    far = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    common = np.minimum(np.cos(np.pi * far / BITS) * np.sqrt(na * nb), np.minimum(na, nb))
    return common / np.maximum(na + nb - common, 1)


def plan(count: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """Bits in a band, number of bands, and number of bands for short texts, whose bits differ a quarter more often."""
    width = max(12, math.ceil(math.log2(max(count, 2))) - 2)
    far = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bands = [math.ceil(math.log(1 - recall) / math.log(1 - (1 - x) ** width)) for x in (far, 1.25 * far)]
    return width, *bands


def _banded(fp: np.ndarray, n: np.ndarray, bands: list[int], width: int, number: int):
    """(rows, key of each) for each band; only short texts from band ``number`` on."""
    for band in bands:
        rng = np.random.default_rng((band, width))
        chosen = np.zeros(BITS, np.uint8)
        chosen[rng.choice(BITS, min(width, BITS), replace=False)] = 1
        mask = np.packbits(chosen, bitorder="little").view(np.uint64)
        pivots, mult = rng.integers(0, 2**64, (PIVOTS, WORDS), dtype=np.uint64) & mask, rng.integers(1, 2**63, PIVOTS + 1, dtype=np.uint64)
        rows = np.arange(len(fp)) if band < number else np.flatnonzero(n < SHORT)
        inside, k = fp[rows] & mask, np.full(len(rows), mult[-1])
        for p, m in zip(pivots, mult):
            k = textkit._mix(k * m + np.bitwise_count(inside ^ p).sum(axis=1, dtype=np.uint64))
        yield rows, k.view(np.int64)


def _keys(bands: list[int], width: int, number: int):
    """Each row once a band, under the key of its coordinates."""

    def run(batches):
        for b in batches:
            for rows, k in _banded(*_parted(_raw(b.column(1))), bands, width, number):
                yield pa.record_batch([pa.array(k), *b.take(pa.array(rows)).columns], names=["k", *b.schema.names])

    return run


class Cut:
    """Keys that are cut, in order, with their blocks, the blocks of rows outside their main class, and that class (-1 for none)."""

    def __init__(self, k, blocks, own, main):
        order = np.argsort(np.array(k, np.int64))
        self.k, self.blocks, self.own, self.main = (np.array(x, np.int64)[order] for x in (k, blocks, own, main))

    def cells(self, k: np.ndarray, node: np.ndarray, label: np.ndarray):
        """(row, key, side, inner): rows of other keys as they are; rows of a cut key in the cells where they meet others.

        Rows outside the main class meet each other in pairs of blocks; those of the main class stay in
        blocks of their own, which all the others visit.
        """
        at = np.minimum(np.searchsorted(self.k, k), max(len(self.k) - 1, 0))
        cut = self.k[at] == k if len(self.k) else np.zeros(len(k), bool)
        plain = np.flatnonzero(~cut)
        yield plain, k[plain], np.zeros(len(plain), np.int64), np.ones(len(plain), bool)
        rows = np.flatnonzero(cut)
        at = at[rows]
        key, spread, main = k[rows].view(np.uint64), textkit._mix(node[rows].astype(np.uint64) + np.uint64(1)) >> np.uint64(1), label[rows] == self.main[at]

        def cell(kind, i, x, y):
            h = textkit._mix(key[i] + np.uint64(kind + 1))
            return textkit._mix(textkit._mix(h + x.astype(np.uint64)) + y.astype(np.uint64)).view(np.int64)

        stay = np.flatnonzero(main)
        x = spread[stay].astype(np.int64) % self.blocks[at[stay]]
        yield rows[stay], cell(1, stay, x, x), np.zeros(len(stay), np.int64), np.zeros(len(stay), bool)
        for kind, times in ((0, self.own), (1, np.where(self.main >= 0, self.blocks, 0))):
            other = np.flatnonzero(~main)
            count = times[at[other]]
            i = np.repeat(other, count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            if kind:
                yield rows[i], cell(1, i, j, j), np.ones(len(i), np.int64), np.zeros(len(i), bool)
            else:
                mine = spread[i].astype(np.int64) % self.own[at[i]]
                yield rows[i], cell(0, i, np.minimum(mine, j), np.maximum(mine, j)), mine, mine == j


def _cell(k: np.ndarray) -> np.ndarray:
    return (textkit._mix(k.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def _marked(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the cell of each key is one of those whose bits are set."""
    cell = _cell(k)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _wanted(bands: list[int], width: int, number: int):
    """Cells of the keys of some rows."""

    def run(batches):
        for b in batches:
            for _, k in _banded(*_parted(_raw(b.column(1))), bands, width, number):
                yield pa.record_batch([pa.array(np.unique(_cell(k)).astype(np.int32))], names=["cell"])

    return run


def _dealt(bands: list[int], width: int, number: int, cut: Cut, wanted: np.ndarray | None):
    """``k`` and the bytes of a row (fingerprint, number of shingles, node, class, side, inner, asks) for each cell of each band; and its failed links, if given. With ``wanted``, rows in those cells of keys only."""

    def run(batches):
        for b in batches:
            raw, node, label, asks = _raw(b.column(1)), *(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for rows, k in _banded(*_parted(raw), bands, width, number):
                if wanted is not None:
                    some = _marked(wanted, k)
                    rows, k = rows[some], k[some]
                for i, key, side, inner in cut.cells(k, node[rows], label[rows]):
                    if not len(i):
                        continue
                    i = rows[i]
                    more = np.zeros(len(i), _SIDE)
                    more["node"], more["class"], more["side"], more["inner"], more["asks"] = node[i], label[i], side, inner, asks[i]
                    whole = np.concatenate([raw[i], more.view(np.uint8).reshape(-1, _SIDE.itemsize)], axis=1)
                    yield pa.record_batch([pa.array(key), _fixed(whole), *(c.take(pa.array(i)) for c in b.columns[4:])], names=["k", "row", *b.schema.names[4:]])

    return run


def _sampled(bands: list[int], width: int, number: int, wanted: np.ndarray | None):
    def run(batches):
        for b in batches:
            label = b.column(2).to_numpy()
            for rows, k in _banded(*_parted(_raw(b.column(1))), bands, width, number):
                some = slice(None) if wanted is None else _marked(wanted, k)
                yield pa.record_batch([pa.array(k[some]), pa.array(label[rows][some])], names=["k", "class"])

    return run


def _near(fp: np.ndarray, n: np.ndarray, i, j, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of pairs, and which are enough: short texts are given more slack, but none are so alike whose numbers of shingles differ more."""
    e = estimate(fp[i], n[i], fp[j], n[j])
    few, many = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return e, (e >= least - np.where(few < SHORT, 1 / np.maximum(few, 1), 0)) & (few >= least * many)


def _runs(batches):
    """Columns of complete runs of equal keys, as arrays, and the bounds of the runs of at least two rows."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        new = tuple(_raw(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns)
        now = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
        edge = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
        if len(edge) > 1:
            yield tuple(x[: edge[-1]] for x in now), edge
        rest = tuple(x[edge[-1] :] for x in now)
    if rest is not None and len(rest[0]):
        yield rest, np.array([0, len(rest[0])])


def _small_pairs(k: np.ndarray):
    """(i, j) of all pairs of rows in runs of equal keys, offset by offset and some ten thousand at a time."""
    alive, step = np.arange(max(len(k) - 1, 0)), 1
    while len(alive):
        alive = alive[alive + step < len(k)]
        alive = alive[k[alive] == k[alive + step]]
        for part in np.array_split(alive, max(1, len(alive) // 65536)):
            yield part, part + step
        step += 1


def _links(node: np.ndarray, a, b, e) -> pa.RecordBatch:
    x, y = node[a], node[b]
    return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.asarray(e, np.float64))], names=["a", "b", "est"])


def _copies(batches):
    """One link from each row to the best of the first rows of its run, if that may be a copy; of a run no others are held."""
    held = None
    for b in batches:
        if not len(b):
            continue
        k, node, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), _raw(b.column(2))
        old = 0
        if held is not None and held[0][0] == k[0]:
            # The first rows of the run that goes on stand before its others.
            old = len(held[0])
            k, node, raw = (np.concatenate(x) for x in zip(held, (k, node, raw)))
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        start = np.repeat(starts, np.diff(np.r_[starts, len(k)]))
        fp, n = _parted(raw)
        at = np.arange(len(k)) - start
        best, to = np.zeros(len(k)), np.zeros(len(k), int)
        rows = np.arange(old, len(k))
        for first in range(LEADERS):
            rows = rows[at[rows] > first]
            if not len(rows):
                break
            i = start[rows] + first
            e = estimate(fp[i], n[i], fp[rows], n[rows])
            more = e > best[rows]
            best[rows[more]], to[rows[more]] = e[more], i[more]
        found = np.flatnonzero(best >= MAYBE)
        yield _links(node, to[found], found, best[found])
        last = slice(starts[-1], starts[-1] + LEADERS)
        held = tuple(x[last].copy() for x in (k, node, raw))


def copies(distinct: DataFrame, width: int) -> DataFrame:
    """Links ``a``, ``b``, ``est`` of part 1, at most one for each ``b``."""
    keyed = distinct.select("node", "fp").mapInArrow(_keys(list(range(COPY_BANDS)), width, COPY_BANDS), "k long, node long, fp binary")
    dealt = keyed.repartition(partitions(distinct.sparkSession), "k").sortWithinPartitions("k", "node")
    best = dealt.mapInArrow(_copies, "a long, b long, est double").groupBy("b").agg(F.max(F.struct("est", "a")).alias("one"))
    return materialize(best.select(F.col("one.a").alias("a"), "b", F.col("one.est").alias("est")))


def _apart(least: float, most: int):
    """Up to ``most`` links of each row to later ones of its run in other classes, not inside a side and not failed; rows of which some were held back are linked to themselves."""

    def run(batches):
        for (k, raw, *failed), edge in _runs(batches):
            fp, n = _parted(raw)
            more = np.ascontiguousarray(raw[:, BITS // 8 + 4 :]).view(_SIDE)[:, 0]
            node, label, side = more["node"].copy(), more["class"].copy(), more["side"].astype(np.int64)
            inner, asks = more["inner"].astype(bool), more["asks"].astype(bool)
            size = np.diff(edge)
            a, b, est, named = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)], []

            def meet(i, j, one=None):
                some = (label[i] != label[j]) & (inner[i] | (side[i] != side[j])) & (asks[i] | asks[j])
                i, j = (np.broadcast_to(x, some.shape)[some] for x in (i, j))
                # The row that asks, or the earlier of two, has the link.
                i, j = np.where(asks[i], i, j), np.where(asks[i], j, i)
                e, enough = _near(fp, n, i, j, least)
                i, j, e = i[enough], j[enough], e[enough]
                if failed:
                    known = np.fromiter((failed[0][x] is not None and node[y] in failed[0][x] for x, y in zip(i, j)), bool, len(i))
                    i, j, e = i[~known], j[~known], e[~known]
                if one and len(i) > most and asks[one[0]]:
                    order = np.argsort(-e, kind="stable")
                    named.append(i[:1])
                    i, j, e = i[order[:most]], j[order[:most]], e[order[:most]]
                a.append(i)
                b.append(j)
                est.append(e)

            rows = np.flatnonzero(np.repeat(size <= SMALL, size))
            for i, j in _small_pairs(k[rows]):
                meet(rows[i], rows[j])
            for lo, hi in zip(edge[:-1][size > SMALL], edge[1:][size > SMALL]):
                if asks[lo:hi].any() and (label[lo:hi] != label[lo]).any():
                    # Rows of the commonest class come last, so that they are not met by their own.
                    values, back, times = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
                    order = lo + np.argsort(back == times.argmax(), kind="stable")
                    for x in range(hi - lo - int(times.max())):
                        meet(order[x : x + 1], order[x + 1 :], order[x : x + 1])
            i, j, e = np.concatenate(a), np.concatenate(b), np.concatenate(est)
            o = np.lexsort((j, -e, i))
            i, j, e = i[o], j[o], e[o]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            kept, back = rank < most, rank >= most
            named = np.unique(np.concatenate([*named, i[back]]))
            yield _links(node, np.r_[i[kept], named], np.r_[j[kept], named], np.r_[e[kept], np.zeros(len(named))])

    return run


def candidates(active: DataFrame, width: int, numbers: tuple[int, int], least: float, most: int) -> DataFrame:
    """Links ``a``, ``b``, ``est`` of part 2 of the rows of ``active`` (``node``, ``fp``, ``class``, ``asks``, and ``failed`` unless all ask),
    and of rows with links held back to themselves; a few bands at a time, to bound the disk."""
    spark = active.sparkSession
    total = active.count()
    sample = active.select("node", "fp", "class").where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    extra = ", failed array<long>" if "failed" in active.columns else ""
    found = []
    for lo in range(0, numbers[1], PASS):
        bands = list(range(lo, min(lo + PASS, numbers[1])))
        wanted = None
        if extra:
            cells = np.zeros(CELLS, bool)
            cells[active.where("asks").select("node", "fp").mapInArrow(_wanted(bands, width, numbers[0]), "cell int").distinct().toArrow().column(0).to_numpy()] = True
            wanted = np.packbits(cells, bitorder="little")
        # Not more than LARGE keys can have so many rows.
        block = max(BLOCK, -(-total * len(bands) // LARGE))
        by_class = sample.mapInArrow(_sampled(bands, width, numbers[0], wanted), "k long, class long").groupBy("k", "class").agg(F.count(F.lit(1)).alias("n"))
        sizes = by_class.groupBy("k").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "class")).alias("main")).where(F.col("rows") * SAMPLE > block)
        large, blocks = sizes.collect(), lambda rows: max(1, -(-rows * SAMPLE // block))
        main = [r.main if 2 * r.main.n > r.rows else None for r in large]
        cut = Cut([r.k for r in large], [blocks(r.rows) for r in large], [blocks(r.rows - (m.n if m else 0)) for r, m in zip(large, main)], [m["class"] if m else -1 for m in main])
        keyed = active.mapInArrow(_dealt(bands, width, numbers[0], cut, wanted), f"k long, row binary{extra}")
        dealt = keyed.repartition(partitions(spark), "k").sortWithinPartitions("k")
        # Equal links of several bands meet before they are kept.
        best = dealt.mapInArrow(_apart(least, most), "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est"))
        found.append(materialize(best))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = materialize(every.groupBy("a", "b").agg(F.max("est").alias("est")))
    discard(*found)
    return out


def _classed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``class``: their component or themselves."""
    return nodes.join(labels, "node", "left").select(*nodes.columns, F.coalesce("component", "node").alias("class"))


class Shingles:
    """Sketches of the nodes, and shingle sets of those that have links; each set is made once, from the text of the node's sketch, when it is first asked for."""

    def __init__(self, docs: DataFrame, distinct: DataFrame, shingle: int):
        self.docs, self.shingle, self.made = docs, shingle, []
        self.named = distinct.select("node", F.col("one.doc_id").alias("id"), F.col("one.h").alias("h"))
        self.sketches = distinct.select("node", F.col("one.sketch").alias("s"))

    def of(self, links: DataFrame) -> DataFrame:
        """``node``, ``s`` of the ends of ``links`` and of all asked for before."""
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for known in self.made:
            ends = ends.join(known.select("node"), "node", "left_anti")
        wanted = materialize(self.named.join(ends, "node", "left_semi"))
        count = wanted.count()
        if count or not self.made:
            # At most FEW rows of three numbers go to all tasks, so that no text moves that has no links.
            sent = F.broadcast(wanted) if count <= FEW else wanted
            texts = self.docs.join(sent, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")))
            self.made.append(materialize(sets(texts.select("node", "text").dropDuplicates(["node"]), self.shingle)))
        discard(wanted)
        every = self.made[0]
        for more in self.made[1:]:
            every = every.unionByName(more)
        return every


def _ends(links: DataFrame, of: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b``; materialised) with ``s`` of both ends, from ``node`` and ``s``, as ``sa`` and ``sb``."""
    total, joined = links.count(), links
    for end in ("a", "b"):
        # What few links need is picked where it lies: at most FEW rows of two numbers go to all tasks.
        counts = links.groupBy(end).agg(F.count(F.lit(1)).alias("times"))
        counts = F.broadcast(counts) if total <= FEW else counts
        table = of.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")).join(counts, end)
        joined = join_counted(joined, table, end, "times", total, 100).drop("times")
    return joined


def _possible(links: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``links`` with ``may``: whether the sketches of their ends leave room for enough similarity. Materialised."""
    links = materialize(links)

    def run(batches):
        for b in batches:
            common, total = most_common(b.column(len(names)), b.column(len(names) + 1))
            # The comparison of the sets, in the same doubles: a bound that fails it leaves no set that passes.
            yield pa.record_batch([*b.columns[: len(names)], pa.array(common >= similarity * (total - common))], names=[*names, "may"])

    names, kinds = links.columns, ", ".join(f"{n} {t}" for n, t in links.dtypes)
    out = materialize(_ends(links, sketches).select(*names, "sa", "sb").mapInArrow(run, f"{kinds}, may boolean"))
    discard(links)
    return out


def _similar(links: DataFrame, shingle_sets: DataFrame, similarity: float) -> DataFrame:
    """``links`` (``a``, ``b``) with ``ok``: whether the exact similarity is enough. Materialised."""
    links = materialize(links)
    joined = _ends(links, shingle_sets)
    common = F.size(F.array_intersect("sa", "sb"))
    ok = common >= similarity * (F.size("sa") + F.size("sb") - common)
    out = materialize(joined.select("a", "b", ok.alias("ok")))
    discard(links)
    return out


def verified(links: DataFrame, shingle_sets: Shingles, similarity: float, tried: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node``, ``component`` of the classes that the links of at least ``similarity`` make, and ``a``, ``b``, ``ok`` of all links tried, those of ``tried`` included."""
    for best in (True, False):
        live = links
        if tried is not None:
            live = live.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            if labels is None:
                live = live.withColumn(f"c{end}", F.col(end))
            else:
                of = labels.select(F.col("node").alias(end), F.col("component").alias(f"l{end}"))
                live = live.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"l{end}", end)).drop(f"l{end}")
        live = live.where("ca <> cb")
        if best:
            live = _possible(live.select("a", "b", "est", "ca", "cb"), shingle_sets.sketches, similarity)
            far, live = live.where("not may").select("a", "b", F.lit(False).alias("ok")), live.where("may")
            tried = far if tried is None else tried.unionByName(far)
            known = shingle_sets.of(live)
            ends = live.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("est", "a", "b").alias("link"))
            live = ends.groupBy("c").agg(F.max("link").alias("link")).select("link.a", "link.b").distinct()
        tried = tried.unionByName(_similar(live.select("a", "b"), known, similarity))
        labels = connected_components(tried.where("ok"), "a", "b")
    return labels, tried


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest id of its class) for every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    all_prints = materialize(prints(docs, shingle))
    distinct = all_prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h", "sketch")).alias("one"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    nodes = distinct.select("node", "fp")
    width, *numbers = plan(distinct.count(), similarity, recall)
    shingle_sets = Shingles(docs, distinct, shingle)
    links = copies(distinct, width)
    labels, tried = verified(links, shingle_sets, similarity)
    discard(links)
    active, most = materialize(_classed(nodes, labels).withColumn("asks", F.lit(True))), FIRST
    while True:
        links = candidates(active, width, numbers, similarity - SLACK, most)
        labels, tried = verified(links.where("a <> b"), shingle_sets, similarity, tried, labels)
        again = materialize(links.where("a = b").select(F.col("a").alias("node")))
        discard(active, links)
        if again.isEmpty():
            break
        most *= 16
        pairs = tried.where("not ok").select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("o")), F.struct(F.col("b").alias("node"), F.col("a").alias("o")))))
        failed = pairs.join(again, "node", "left_semi").groupBy("node").agg(F.collect_list("o").alias("failed"))
        named = again.join(failed, "node", "left").select("node", "failed", F.lit(True).alias("asks"))
        active = _classed(nodes, labels).join(named, "node", "left")
        active = materialize(active.select("node", "fp", "class", F.coalesce("asks", F.lit(False)).alias("asks"), "failed"))
        discard(again)
    least = distinct.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = least.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = materialize(least.select("fp", "class").join(smallest, "class").select("fp", "component_id"))
    out = materialize(all_prints.join(classes, "fp").select("doc_id", "component_id"))
    discard(all_prints, distinct, classes, *shingle_sets.made)
    return out
