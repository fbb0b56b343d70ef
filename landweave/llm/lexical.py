"""Ranked lexical search without a document index: an Aho-Corasick scan counts the items' terms in the texts.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z are lower-cased. All
terms of a block of items make one automaton over UTF-8 bytes, each between two guards. Separators of a
text become guards too, so that one pass over the bytes finds whole terms only, and every find is one
occurrence. Outputs of the automaton map to the items that hold the term, with their counts.

The documents are scanned twice for each block of items: once for N, L and the terms' document
frequencies, once for scores. Nothing but those sums and at most ``k`` documents for each item and task
leaves a task. Scores are whole numbers; they are added in doubles only where no sum can pass 2^53.

A block's distinct terms have ``block_chars`` characters, twice that at most, so what is broadcast has a
fixed bound however large the items are. An item with more has its terms dealt over several blocks; those
send the partial score of every document they meet, which Spark adds up.

Cases: null and empty texts have no terms, neither do items without any, which get no rows; repeated item
rows are one, texts that share an item id are ranked each for itself; rows that repeat a document id are
documents of their own and take ranks of their own; a null id comes last among equal scores; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.textkit import LOWER_ALNUM, chunks
from landweave.operators import ranking
from landweave.storage import discard, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The byte of every separator, and of the guards.
GUARD = 32
_SPACED = np.where(LOWER_ALNUM == 0, GUARD, LOWER_ALNUM).astype(np.uint8)
_LAST = np.iinfo(np.int64).max


class Block:
    """Terms of some items: an automaton made once a Python worker, and for each term its items with counts."""

    def __init__(self, rows: list):
        self.items = sorted({(r.item_id is None, r.item_id, r.text_key) for r in rows}, key=lambda x: (x[0], x[1] or 0, x[2]))
        self.terms = sorted({r.term for r in rows})
        item, term = {x: i for i, x in enumerate(self.items)}, {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((term[r.term], item[r.item_id is None, r.item_id, r.text_key], r.times) for r in rows)
        self.post_item, self.post_times = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
        self.begin = np.searchsorted([p[0] for p in pairs], np.arange(len(self.terms) + 1))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            guard = chr(GUARD)
            for i, t in enumerate(self.terms):
                self._automaton.add_word(guard + t.encode().decode("latin-1") + guard, i)
            self._automaton.make_automaton()
        return self._automaton


def scan(block: Block, texts: pa.Array):
    """Yield (first row, terms of each row, and row, term, occurrences of what the automaton finds) for runs of rows."""
    automaton, guard, which = block.automaton(), chr(GUARD), itemgetter(1)
    for row, buf, off in chunks(texts):
        spaced = _SPACED[buf]
        word = spaced != GUARD
        start = word.copy()
        start[1:] &= ~word[:-1]
        inner = off[1:-1][off[1:-1] < len(buf)]
        start[inner] = word[inner]
        n = np.diff(np.r_[0, np.cumsum(start)][off])
        data = spaced.tobytes().decode("latin-1")
        docs, terms, times = [], [], []
        for d in np.flatnonzero(n).tolist():
            found = Counter(map(which, automaton.iter(f"{guard}{data[off[d] : off[d + 1]]}{guard}")))
            docs.append(np.full(len(found), d))
            terms.extend(found.keys())
            times.extend(found.values())
        yield row, n, np.concatenate(docs or [np.zeros(0, int)]), np.array(terms, np.int64), np.array(times, np.int64)


def _statistics(docs: DataFrame, text_col: str, shared) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of a block."""

    def run(batches):
        block, sums = shared.value, np.zeros(2, np.int64)
        df = np.zeros(len(block.terms), np.int64)
        for b in batches:
            for _, n, _, term, _ in scan(block, b.column(0)):
                sums += (np.count_nonzero(n), n.sum())
                df += np.bincount(term, minlength=len(df))
        cell = np.r_[-2, -1, np.flatnonzero(df)]
        yield pa.record_batch([pa.array(cell), pa.array(np.r_[sums, df[df > 0]])], names=["cell", "s"])

    found = {r.cell: r.s for r in docs.select(text_col).mapInArrow(run, "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s")).collect()}
    df = np.zeros(len(shared.value.terms), np.int64)
    for t, s in found.items():
        if t >= 0:
            df[t] = s
    return found.get(-2, 0), found.get(-1, 0), df


def _measure(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of each document length."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // length
    return np.array([75 + 25 * x * documents // length for x in n.tolist()], np.int64)


class Scorer:
    """Scores of runs of rows for all items of a block."""

    CELLS = 1 << 20

    def __init__(self, block: Block, documents: int, length: int, df: np.ndarray):
        self.block, self.documents, self.length = block, documents, length
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        term = np.repeat(np.arange(len(df)), np.diff(block.begin))
        most = np.bincount(block.post_item, weights=block.post_times * self.weight[term].astype(float), minlength=len(block.items))
        self.doubles = 1e6 * most.max(initial=0) < 2**52

    def scores(self, texts: pa.Array, least: np.ndarray):
        """Yield (row, item, score) arrays of the scores that reach their item's ``least``, for bounded runs of rows."""
        block, wide = self.block, len(self.block.items)
        for row, n, doc, term, times in scan(block, texts):
            value = self.weight[term] * (1_000_000_000 * times // (1000 * times + 12 * _measure(n, self.documents, self.length)[doc]))
            size = np.diff(block.begin)[term]
            # Runs of whole documents of about ``CELLS`` contributions.
            load = np.r_[0, np.cumsum(size)][np.searchsorted(doc, np.arange(len(n) + 1))]
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(load, load[lo] + self.CELLS, "right")) - 1)
                a, z = np.searchsorted(doc, (lo, hi))
                own = size[a:z]
                at = np.repeat(block.begin[term[a:z]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
                cell = np.repeat(doc[a:z] - lo, own) * wide + block.post_item[at]
                part = np.repeat(value[a:z], own) * block.post_times[at]
                cell, score = self._added(cell, part, (hi - lo) * wide)
                keep = score >= least[cell % wide]
                yield row + lo + cell[keep] // wide, cell[keep] % wide, score[keep]
                lo = hi

    def _added(self, cell: np.ndarray, part: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums by cell: in an array of all cells where enough of them are met, else by sorting."""
        met = None
        if cells > 4 * len(cell):
            met, cell = np.unique(cell, return_inverse=True)
            cells = len(met)
        if self.doubles:
            out = np.bincount(cell, weights=part, minlength=cells).astype(np.int64)
        else:
            out = np.zeros(cells, np.int64)
            np.add.at(out, cell, part)
        return (np.flatnonzero(out), out[out > 0]) if met is None else (met[out > 0], out[out > 0])


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.kept, self.waiting, self.size = k, np.ones(items, np.int64), [np.zeros(0, np.int64)] * 4, [], 0

    def add(self, item: np.ndarray, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        if len(item):
            self.waiting.append((item, ids, missing, scores))
            self.size += len(item)
            if self.size > 4 * self.k * len(self.least) + (1 << 18):
                self.cut()

    def cut(self) -> list[np.ndarray]:
        item, ids, missing, score = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        o = np.lexsort((ids, missing, -score, item))
        item, ids, missing, score = item[o], ids[o], missing[o], score[o]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = np.flatnonzero(rank == self.k - 1)
        self.least[item[last]] = score[last]
        self.kept, self.waiting, self.size = [c[rank < self.k] for c in (item, ids, missing, score)], [], 0
        return self.kept


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)


_SCORED = "item int, doc_id long, score long"


def _top(docs: DataFrame, shared, scorer, k: int) -> DataFrame:
    """At most ``k`` documents for each item of a block and task: ``docs`` has columns id and text."""

    def run(batches):
        score = Scorer(shared.value, *scorer)
        best = Best(len(shared.value.items), k)
        for b in batches:
            ids, missing = _ids(b.column(0))
            for row, item, value in score.scores(b.column(1), best.least):
                best.add(item, ids[row], missing[row], value)
        item, ids, missing, value = best.cut()
        yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(ids, mask=missing > 0), pa.array(value)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, _SCORED)


def _partial(docs: DataFrame, shared, scorer) -> DataFrame:
    """The partial score of every document that holds a term: ``docs`` has columns id, text and a hash of the text."""

    def run(batches):
        score, least = Scorer(shared.value, *scorer), np.ones(len(shared.value.items), np.int64)
        for b in batches:
            for row, item, value in score.scores(b.column(1), least):
                at = pa.array(row)
                yield pa.record_batch([pa.array(item.astype(np.int32)), b.column(0).take(at), pa.array(value), b.column(2).take(at)], names=["item", "doc_id", "score", "same"])

    return docs.mapInArrow(run, _SCORED + ", same string")


def _dealt(entries: DataFrame, block_chars: int) -> DataFrame:
    """Entries with ``block``, and ``shared``, whether their item's terms are dealt over several blocks."""
    chars = F.octet_length("term") + 2
    sizes = entries.groupBy("item_id", "text_key").agg(F.sum(chars).alias("chars"))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    if total <= block_chars:
        return entries.withColumn("block", F.lit(0).cast("long")).withColumn("shared", F.lit(False))
    sizes = materialize(sizes)
    same = entries["item_id"].eqNullSafe(F.col("i")) & (entries["text_key"] == F.col("key"))

    def number(rows: DataFrame, order: list[str], weight) -> DataFrame:
        summed, _ = ranking.running_sum(rows, order, weight, "upto")
        return summed.withColumn("block", F.floor((F.col("upto") - 1) / block_chars)).drop("upto")

    small = number(sizes.where(F.col("chars") <= block_chars), ["item_id", "text_key"], F.col("chars")).select(F.col("item_id").alias("i"), F.col("text_key").alias("key"), "block")
    large = sizes.where(F.col("chars") > block_chars).select(F.col("item_id").alias("i"), F.col("text_key").alias("key"))
    whole = entries.join(small, same).select(*entries.columns, "block", F.lit(False).alias("shared"))
    cut = number(entries.join(large, same, "left_semi"), ["item_id", "text_key", "term"], chars)
    # Negative numbers keep the two kinds of block apart.
    return whole.unionByName(cut.select(*entries.columns, (-1 - F.col("block")).alias("block"), F.lit(True).alias("shared")))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``k`` documents that score highest for every item."""
    spark = docs.sparkSession
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    term = F.explode(F.regexp_extract_all(F.translate("t", upper, lower), F.lit(TERM), 0)).alias("term")
    entries = materialize(rows.select("item_id", F.sha2("t", 256).alias("text_key"), term).groupBy("item_id", "text_key", "term").agg(F.count(F.lit(1)).alias("times")))
    dealt = materialize(_dealt(entries, block_chars))
    discard(entries)
    doc_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    names = "item int, item_id long, text_key string"
    scored, parts = None, None
    for number in sorted(r.block for r in dealt.select("block").distinct().collect()):
        shared = spark.sparkContext.broadcast(Block(dealt.where(F.col("block") == number).collect()))
        scorer = _statistics(doc_rows, "text", shared)
        if not scorer[1]:
            continue
        found = [(i, x[1], x[2]) for i, x in enumerate(shared.value.items)]
        # As many rows as a block has items.
        own = F.broadcast(spark.createDataFrame(found, names))
        if number >= 0:
            top = _top(doc_rows, shared, scorer, k).join(own, "item").drop("item")
            scored = top if scored is None else scored.unionByName(top)
        else:
            part = _partial(doc_rows.withColumn("same", F.sha2("text", 256)), shared, scorer).join(own, "item").select(F.lit(number).alias("part"), "item_id", "text_key", "doc_id", "same", "score")
            parts = part if parts is None else parts.unionByName(part)
    if parts is not None:
        # Equal rows have equal partial scores: one is added, and all come back.
        once = parts.groupBy("part", "item_id", "text_key", "doc_id", "same").agg(F.first("score").alias("score"), F.count(F.lit(1)).alias("n"))
        whole = once.groupBy("item_id", "text_key", "doc_id", "same").agg(F.sum("score").alias("score"), F.max("n").alias("n"))
        each = whole.where("score > 0").select("item_id", "text_key", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.col("n"))))
        each = each.select("item_id", "text_key", "doc_id", "score")
        scored = each if scored is None else scored.unionByName(each)
    if scored is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id", "text_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
o AS (SELECT u, unnest(ts) AS term FROM d),
f AS (SELECT u, term, count(*)::BIGINT AS tf FROM o GROUP BY u, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
i AS (SELECT item_id, text AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
c AS (SELECT item_id, item, term, count(*)::BIGINT AS times FROM i GROUP BY item_id, item, term),
m AS (SELECT u, doc_id, 75 + (25 * len(ts) * N) // L AS m FROM d, s WHERE len(ts) > 0),
r AS (SELECT item_id, item, u, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM c JOIN w USING (term) JOIN f USING (term) JOIN m USING (u) GROUP BY item_id, item, u),
q AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM r JOIN m USING (u) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM q WHERE rank <= 20
"""
