"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased. Matches score 2, mismatches and
gaps -1; a hit scores at least ``min_score`` of the item's full score and at least that of ``min_words``
matched words (or of the whole item).

Seeds come from a bound, not from luck. An item of n words may fall short of its full score by at most
B = 2n - need. A replaced or dropped word costs 3 of B and breaks two of the item's n - 1 pairs of
neighbours, a word left out at an end costs 2 and breaks one, an inserted word costs 1; a pair with one
word inserted is looked up too, so only two inserted words break it. A hit so keeps at least
T = n - 1 - 2B/3 pairs, on diagonals at most B apart. All but T - t of an item's pairs, the commonest in
the benchmark being left out, are seeds, and t of them (``HITS``, or T) on such diagonals make a
candidate: T is positive for every item of three words or more at the default thresholds, so nothing that
a full alignment finds is lost. (A ``min_score`` under a half can make T less than 1; one seed is then asked.)
An item of one word has that word as its seed.

The corpus is scanned once for each block of at most ``block_words`` words of items (16 bytes a word), so
what is broadcast has a fixed bound however large the benchmark is.

The seeds of a run of texts are looked up for as many items at a time as make about ``EXPANDED`` places, so
that what many items share with one long text takes no more memory than anything else.

Cases: null and empty texts have no words, and items without any are never found; items of one or two words
are found where all of them stand together, like any item of ``min_words`` words at most; repeated items are one; rows that repeat an id give their own hits, and equal hits are one row; empty
tables give empty results; columns besides the named ones are ignored, or passed through, repeated rows
too, by :func:`decontaminate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.textkit import LOWER_ALNUM, Words, chunks, grams, within

HITS, EXPANDED = 4, 1 << 22
#: Hashes that pad items and windows; they never equal each other.
_PAD_ITEM, _PAD_DOC = np.uint64(1), np.uint64(2)


def _pairs(words: np.ndarray, step: int = 1) -> np.ndarray:
    """Hashes of each word and the one ``step`` further."""
    out = np.zeros(max(len(words) - step, 0), np.uint64)
    for i in range(step):
        out[i::step] = grams(words[i::step], 2)
    return out


def _singles(words: np.ndarray) -> np.ndarray:
    return grams(words, 1) ^ np.uint64(0x5555555555555555)


class Items:
    """A block of benchmark items: ids, word hashes with offsets, thresholds, and seeds in order of hash."""

    def __init__(self, ids: list[int], texts: list[str], min_score: float, min_words: int):
        self.ids, hashes, first = np.array(ids, np.int64), [], [0]
        for _, buf, off in chunks(pa.array([t or "" for t in texts], pa.string())):
            w = Words(buf, off, LOWER_ALNUM)
            hashes.append(w.hashes())
            first += (w.first[1:] + first[-1]).tolist()
        self.words = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.first = np.array(first)
        self.size = np.diff(self.first)
        self.need = 2 * np.maximum(min_score * self.size, np.minimum(self.size, min_words))
        self.short = np.floor(2 * self.size - self.need + 1e-9).astype(np.int64)
        kept = np.maximum(self.size - 1 - 2 * self.short // 3, 1)
        self.hits = np.minimum(kept, HITS)
        at, alone = within(self.first, 2), self.first[:-1][self.size == 1]
        gram = np.r_[_pairs(self.words)[at], _singles(self.words[alone])]
        at, self.alone = np.r_[at, alone], bool(len(alone))
        item = np.searchsorted(self.first, at, "right") - 1
        _, back, times = np.unique(gram, return_inverse=True, return_counts=True)
        # Commonest first within each item; the first T - t are no seeds.
        o = np.lexsort((at, -times[back], item))
        rank = np.arange(len(o)) - np.searchsorted(item, item)[o]
        o = o[rank >= (kept - self.hits)[item[o]]]
        o = o[np.argsort(gram[o], kind="stable")]
        self.seed_item, self.seed_at = item[o], (at - self.first[item])[o]
        self.seed, back, self.times = np.unique(gram[o], return_inverse=True, return_counts=True)
        # Seeds in order, the items of each in order.
        self.place = back * len(self.ids) + self.seed_item
        bits = min(25, max(16, int(16 * len(self.seed)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.seed & self.mask).astype(np.int64)] = True

    def look_up(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``g`` that are seeds, and which."""
        some = np.flatnonzero(self.maybe[(g & self.mask).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.seed, g[some]), len(self.seed) - 1)
        hit = self.seed[i] == g[some]
        return some[hit], i[hit]


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of padded rows, and the window column where it ends."""
    n, width = windows.shape
    ramp = np.arange(width + 1, dtype=np.int32)
    h, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(items.shape[1]):
        new = np.maximum(h - 1, 0)
        step = h[:, :-1] + np.where(windows == items[:, i : i + 1], 2, -1).astype(np.int32)
        np.maximum(new[:, 1:], step, out=new[:, 1:])
        # A gap along the window: the best earlier cell less its distance.
        h = np.maximum(np.maximum.accumulate(new + ramp, axis=1) - ramp, 0)
        at = h.argmax(axis=1)
        top = h[rows, at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _padded(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: np.uint64, back: bool = False) -> np.ndarray:
    width = int((hi - lo).max())
    at = (hi[:, None] - 1 - np.arange(width)) if back else (lo[:, None] + np.arange(width))
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, values[np.where(inside, at, 0)], pad)


def _blocks(cells: np.ndarray, most: int = 1 << 20):
    """Index ranges over pairs sorted by size so that padded blocks stay small."""
    lo = 0
    while lo < len(cells):
        hi = lo + 1
        while hi < len(cells) and (hi + 1 - lo) * cells[hi] <= most:
            hi += 1
        yield lo, hi
        lo = hi


def _shares(items: Items, seed: np.ndarray):
    """Ranges of the seed table for each of the looked-up ``seed``, for as many items at a time as make ``EXPANDED`` places, or one item."""
    todo = [(0, len(items.ids))]
    while todo:
        a, z = todo.pop()
        begin, end = (np.searchsorted(items.place, seed * len(items.ids) + x) for x in (a, z))
        if (end - begin).sum() <= EXPANDED or z - a == 1:
            yield begin, end - begin
        else:
            todo += [((a + z) // 2, z), (a, (a + z) // 2)]


def _windows(items: Items, pos: np.ndarray, begin: np.ndarray, times: np.ndarray, first: np.ndarray):
    """(item, document, start, end) of the merged windows that can hold a hit, from the ranges of the seed table at ``pos``."""
    which = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    pos = np.repeat(pos, times)
    item, diag = items.seed_item[which], pos - items.seed_at[which]
    doc = np.searchsorted(first, pos, "right") - 1
    o = np.lexsort((diag, item, doc))
    item, diag, doc = item[o], diag[o], doc[o]
    short = items.short[item]
    last = np.minimum(np.arange(len(o)) + items.hits[item] - 1, len(o) - 1)
    full = np.arange(len(o)) + items.hits[item] <= len(o)
    k = np.flatnonzero(full & (doc[last] == doc) & (item[last] == item) & (diag[last] - diag <= short))
    item, doc, lo, hi, short = item[k], doc[k], diag[k], diag[last[k]], short[k]
    ws = np.maximum(lo - short, first[doc])
    we = np.minimum(hi + items.size[item] + short, first[doc + 1])
    if not len(k):
        return item, doc, ws, we
    # Ends ascend with starts, so neighbours decide.
    a = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (ws[1:] > we[:-1])])
    return item[a], doc[a], ws[a], we[np.r_[a[1:], len(we)] - 1]


def find(items: Items, texts: pa.Array):
    """Yield arrays (row, item index, start word, end word, score out of 1) of the hits in ``texts``."""
    if not len(items.seed):
        return
    for row, buf, off in chunks(texts):
        w = Words(buf, off, LOWER_ALNUM)
        at = within(w.first, 2)
        h = w.hashes()
        pos, seed = items.look_up(_pairs(h)[at])
        wide = within(w.first, 3)
        pos2, seed2 = items.look_up(_pairs(h, 2)[wide])
        pos, seed = np.r_[at[pos], wide[pos2]], np.r_[seed, seed2]
        if items.alone:
            one, seed1 = items.look_up(_singles(h))
            pos, seed = np.r_[pos, one], np.r_[seed, seed1]
        o = np.argsort(pos, kind="stable")
        pos, seed = pos[o], seed[o]
        # Whole documents at a time, of about ``EXPANDED`` seeds.
        ends = np.searchsorted(pos, w.first)
        load = np.r_[0, np.cumsum(items.times[seed])][ends]
        i = 0
        while i < len(ends) - 1:
            j = max(i + 1, int(np.searchsorted(load, load[i] + EXPANDED, "right")) - 1)
            part = slice(ends[i], ends[j])
            for begin, times in _shares(items, seed[part]) if ends[j] > ends[i] else ():
                yield from _aligned(items, h, w.first, row, *_windows(items, pos[part], begin, times, w.first))
            i = j


def _aligned(items: Items, h: np.ndarray, first: np.ndarray, row: int, item, doc, ws, we):
    """Hits in windows, best first: what lies before and after a hit is looked through again."""
    while len(item):
        o = np.argsort(we - ws, kind="stable")
        item, doc, ws, we = item[o], doc[o], ws[o], we[o]
        left = []
        for i, j in _blocks(we - ws):
            it, s, e = item[i:j], ws[i:j], we[i:j]
            score, end = align(_padded(items.words, items.first[it], items.first[it + 1], _PAD_ITEM), _padded(h, s, e, _PAD_DOC))
            good = np.flatnonzero(score >= items.need[it])
            if not len(good):
                continue
            it, s, e, end, score, d = it[good], s[good], e[good], end[good], score[good], doc[i:j][good]
            stop = s + end
            _, back = align(_padded(items.words, items.first[it], items.first[it + 1], _PAD_ITEM, True), _padded(h, s, stop, _PAD_DOC, True))
            start = stop - back
            yield row + d, it, start - first[d], stop - first[d], score / (2 * items.size[it])
            left += [(it, d, s, start), (it, d, stop, e)]
        item, doc, ws, we = (np.concatenate(x) for x in zip(*left)) if left else (np.zeros(0, int),) * 4
        # A hit has need / 2 matched words at least.
        keep = 2 * (we - ws) >= items.need[item]
        item, doc, ws, we = item[keep], doc[keep], ws[keep], we[keep]


def _prepared(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, min_score: float, min_words: int, block_words: int):
    """Broadcast blocks of items with their seeds."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.char_length("t"))).first()[0] or 0
    # A word and its separator are two characters at least.
    blocks = max(1, -(-total // (2 * block_words)))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        items = Items([r.i for r in part], [r.t for r in part], min_score, min_words)
        if len(items.seed):
            yield docs.sparkSession.sparkContext.broadcast(items)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = 0.5, min_words: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``start_word``, ``end_word``, ``score`` of every aligned passage."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, end_word long, score double")
    for shared in _prepared(docs, benchmark, item_col, item_text, min_score, min_words, block_words):

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                for row, it, start, end, score in find(items, b.column(1)):
                    yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(items.ids[it]), pa.array(start), pa.array(end), pa.array(score)], names=["doc_id", "item_id", "start_word", "end_word", "score"])

        out = out.unionByName(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, out.schema))
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = 0.5, min_words: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found, with all their columns. Nothing is shuffled."""
    clean = docs
    for shared in _prepared(docs, benchmark, item_col, item_text, min_score, min_words, block_words):

        def run(batches, shared=shared, at=docs.columns.index(text_col)):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in find(shared.value, b.column(at)):
                    keep[row] = False
                yield b.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs.select("doc_id", "text"), benchmark).withColumn("score", F.round("score", 6))
