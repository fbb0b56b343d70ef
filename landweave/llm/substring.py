"""Substring dedup over a de Bruijn graph of words.

The edges of the graph are the 13-word windows of the texts, its nodes their 12-word overlaps.

1. *Anchors.* A window's anchor is the smallest hash among its 5-word grams, so equal windows have
   equal anchors, and a text has about one anchor to five windows. One shuffle finds the anchors of
   several texts; windows under any other anchor are unique and drop out of the graph.
2. *Edges.* The windows under repeated anchors meet by their 96-bit hash. Each occurrence learns the
   edge's first coordinate: the smallest document that has it, and the position there.
3. *Walks.* A window over each text's repeated edges in order joins them: a walk is a run of edges whose
   source coordinates advance in step, so the coordinates verify the whole span. Walks are far fewer
   than edges.
4. *Paths.* Where walks part or meet the graph branches. The distinct walks of a source, cut at every
   branch among them, are its nonbranching paths (:func:`paths`), with the number of texts that walk each.
5. *Removal.* Every walk becomes the paths it is made of (:func:`walked`), by joins on the branches where
   it begins and ends; what is removed from a text are the words of its paths.

Windows are the same if 96 bits of hash are: among n different windows any two are mistaken for each other
with a probability of n squared over 2^97 at most, one in a thousand for 10^13 windows. Several windows
in step, as in a longer span, would all have to be.

Exact copies never enter the graph: a text's smallest document stands for all, and the others are
covered whole. Both shuffles move arrays packed by hash bucket, combined per batch beforehand: of an
edge or anchor, a batch sends its smallest document only and answers its other documents itself. A
passage in a third of all documents is thus one entry a batch.

Cases: a null text has no words; texts under 13 words lose nothing; a null id sorts before all
others; rows that share an id are judged each by its own text against smaller ids only; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.llm.textkit import Words, chunks, grams, sliding_min, within
from landweave.operators.skew import join_counted
from landweave.storage import discard, materialize, partitions

GRAM = 5
#: ``t`` names a text, ``d`` is the document that stands for it.
_ANCHOR = np.dtype([("a", "<u8"), ("t", "<i8")])
_EDGE = np.dtype([("h", "<u8"), ("c", "<u4"), ("p", "<i4"), ("d", "<i8"), ("t", "<i8")])
_LINK = np.dtype([("t", "<i8"), ("s", "<i8"), ("p", "<i4"), ("q", "<i4")])
#: Kinds of packed rows: to be matched; known to be repeated; answered within the batch.
ASK, KNOWN, DONE = 0, 1, 2


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash, rising with it."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: np.ndarray, kind: int, data: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; ``bucket`` is sorted."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(bucket)][: len(at)]
    off = np.r_[0, ends * data.dtype.itemsize].astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.record_batch([pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int8)), blob], names=["bucket", "kind", "blob"])


def _by_bucket(batches):
    """(kind -> bytes) for each bucket of a partition sorted by bucket."""
    now, held = None, {}
    for b in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now and held:
                yield held
                held = {}
            now = bucket
            held.setdefault(kind, []).append(blob)
    if held:
        yield held


def _read(held: dict, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(held.get(kind, [])), dtype)


def _same_as_before(*cols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    return out


def _anchors(k: int, buckets: int):
    def run(batches):
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            for lo, buf, off in chunks(b.column(1)):
                w = Words(buf, off)
                at = within(w.first, k)
                if not len(at):
                    continue
                m, t = sliding_min(grams(w.hashes(), GRAM), k - GRAM + 1)[at], ids[w.doc()[at] + lo]
                new = ~_same_as_before(m, t)
                one = np.empty(int(new.sum()), _ANCHOR)
                one["a"], one["t"] = m[new], t[new]
                found.append(one)
            if not found:
                continue
            e = np.concatenate(found)
            e = e[np.lexsort((e["t"], e["a"]))]
            e = e[~_same_as_before(e["a"], e["t"])]
            again = _same_as_before(e["a"])
            several = again.copy()
            several[:-1] |= again[1:]
            alone, local = e[~several], e[several]
            known = local[~_same_as_before(local["a"])]
            yield _packed(_bucket(alone["a"], buckets), ASK, alone)
            yield _packed(_bucket(known["a"], buckets), KNOWN, known["a"].copy())
            local = local[np.argsort(local["t"] % buckets, kind="stable")]
            yield _packed(local["t"] % buckets, DONE, local)

    return run


def _repeated_anchors(batches):
    for held in _by_bucket(batches):
        ask, known, done = np.unique(_read(held, ASK, _ANCHOR)), _read(held, KNOWN, np.dtype("<u8")), _read(held, DONE, _ANCHOR)
        values, counts = np.unique(np.concatenate([ask["a"], known, known]), return_counts=True)
        e = np.concatenate([ask[np.isin(ask["a"], values[counts > 1])], done])
        yield pa.record_batch([pa.array(e["t"]), pa.array(e["a"].view(np.int64))], names=["t", "a"])


def _edges(k: int, buckets: int):
    def run(batches):
        for b in batches:
            ids, keys, lists, found = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), []
            for lo, buf, off in chunks(b.column(2)):
                w = Words(buf, off)
                at = within(w.first, k)
                if not len(at):
                    continue
                rows = lists.slice(lo, len(off) - 1)
                wanted = np.unique(rows.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                h = w.hashes()
                anchor = sliding_min(grams(h, GRAM), k - GRAM + 1)[at]
                i = np.searchsorted(wanted, anchor)
                hit = np.flatnonzero(wanted[np.minimum(i, len(wanted) - 1)] == anchor) if len(wanted) else np.zeros(0, np.int64)
                at = at[hit]
                e = np.empty(len(at), _EDGE)
                e["h"], e["c"] = grams(h, k)[at], grams(w.hashes(1), k, 1)[at] & np.uint64(0xFFFFFFFF)
                doc = w.doc()[at]
                e["p"], e["d"], e["t"] = at - w.first[doc], ids[doc + lo], keys[doc + lo]
                found.append(e)
            if not found:
                continue
            e = np.concatenate(found)
            e = e[np.lexsort((e["p"], e["d"], e["c"], e["h"]))]
            first = np.maximum.accumulate(np.where(_same_as_before(e["h"], e["c"]), 0, np.arange(len(e))))
            later = e["d"] > e["d"][first]
            ask = e[~later]
            yield _packed(_bucket(ask["h"], buckets), ASK, ask)
            yield _answers(e[later], e[first[later]], buckets)

    return run


def _links(e: np.ndarray, source: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), _LINK)
    out["t"], out["p"], out["s"], out["q"] = e["t"], e["p"], source["d"], source["p"]
    return out


def _answers(e: np.ndarray, source: np.ndarray, buckets: int) -> pa.RecordBatch:
    out = _links(e, source)
    out = out[np.argsort(out["t"] % buckets, kind="stable")]
    return _packed(out["t"] % buckets, DONE, out)


def _repeated_edges(batches):
    for held in _by_bucket(batches):
        e, done = _read(held, ASK, _EDGE), _read(held, DONE, _LINK)
        e = e[np.lexsort((e["p"], e["d"], e["c"], e["h"]))]
        first = np.maximum.accumulate(np.where(_same_as_before(e["h"], e["c"]), 0, np.arange(len(e)))) if len(e) else np.zeros(0, np.int64)
        later = e["d"] > e["d"][first]
        out = np.concatenate([_links(e[later], e[first[later]]), done])
        yield pa.record_batch([pa.array(out[c]) for c in ("t", "p", "s", "q")], names=["t", "p", "s", "q"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    least = F.lit(-(2**63)).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), least).alias("d"), F.unhex(F.md5(text)).alias("tag"), text.alias("text"))
    return rows.withColumn("t", F.xxhash64("tag"))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket")


def repeated_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> tuple[DataFrame, DataFrame]:
    """(texts, occurrences): ``tag``, ``t``, ``d`` of each text and the document that stands for it; and ``t``, ``p``, ``s``, ``q``
    for each window at word ``p`` of a text that also starts in a document ``s`` smaller than its own, at word ``q``."""
    if k <= GRAM:
        raise ValueError(f"windows need more than {GRAM} words")
    parts = partitions(docs.sparkSession)
    buckets = 4 * parts
    keyed = _keyed(docs, id_col, text_col)
    texts = materialize(keyed.groupBy("tag", "t").agg(F.min("d").alias("d")))
    packed = "bucket int, kind byte, blob binary"
    asked = keyed.select("t", "text").mapInArrow(_anchors(k, buckets), packed)
    anchors = materialize(_dealt(asked, parts).mapInArrow(_repeated_anchors, "t long, a long"))
    by_text = anchors.groupBy("t").agg(F.collect_list("a").alias("anchors")).join(texts, "t")
    here = keyed.drop("t").join(by_text, ["d", "tag"]).select("d", "t", "text", "anchors").mapInArrow(_edges(k, buckets), packed)
    found = materialize(_dealt(here, parts).mapInArrow(_repeated_edges, "t long, p int, s long, q int"))
    discard(anchors)
    return texts, found


def walks(found: DataFrame) -> DataFrame:
    """``t``, ``p``, ``s``, ``q``, ``edges``: runs of consecutive occurrences of :func:`repeated_edges` whose source coordinates advance in step."""
    order = Window.partitionBy("t").orderBy("p", "s", "q")
    # A text that was read twice has each window twice.
    once = found.withColumn("__p", F.lag("p").over(order)).where("__p is null or __p <> p").drop("__p")
    before = F.lag(F.struct("p", "s", "q")).over(order)
    step = once.withColumn("__b", before).withColumn("__new", F.coalesce((F.col("__b.p") + 1 == F.col("p")) & (F.col("__b.s") == F.col("s")) & (F.col("__b.q") + 1 == F.col("q")), F.lit(False)))
    run = step.withColumn("__run", F.sum(F.when(F.col("__new"), 0).otherwise(1)).over(order))
    # Still partitioned by text: nothing moves again.
    return run.groupBy("t", "__run").agg(F.min("p").alias("p"), F.first("s").alias("s"), F.min("q").alias("q"), F.count(F.lit(1)).cast("int").alias("edges")).drop("__run")


def paths(spans: DataFrame) -> DataFrame:
    """Nonbranching paths of the graph, ``s``, ``q``, ``edges``, ``texts``: no walk of :func:`walks` begins or ends inside one, and so many texts walk it.

    Equal walks are counted first, so a passage in a third of all texts is one row from there on.
    """
    distinct = spans.groupBy("s", "q", "edges").agg(F.count(F.lit(1)).alias("texts")).withColumn("end", F.col("q") + F.col("edges"))
    cuts = distinct.select("s", F.explode(F.array("q", "end")).alias("cut")).distinct()
    # Depth changes at cuts only: a running sum of walks begun less walks ended is how many cover what follows.
    change = distinct.select("s", F.inline(F.array(F.struct(F.col("q").alias("cut"), F.col("texts").alias("n")), F.struct(F.col("end").alias("cut"), (-F.col("texts")).alias("n"))))).groupBy("s", "cut").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("s").orderBy("cut")
    depth = cuts.join(change, ["s", "cut"]).withColumns({"texts": F.sum("n").over(order), "end": F.lead("cut").over(order)})
    return depth.where("texts > 0").select("s", F.col("cut").alias("q"), (F.col("end") - F.col("cut")).cast("int").alias("edges"), "texts")


def walked(spans: DataFrame, compact: DataFrame) -> DataFrame:
    """``t``, ``p``, ``s``, ``q``, ``edges``, ``texts``: each walk as the paths of :func:`paths` that it is made of."""
    order = Window.partitionBy("s").orderBy("q")
    # A walk begins and ends at ends of paths, so its paths are those between two numbers.
    numbered = compact.withColumn("i", F.row_number().over(order))
    begins = numbered.select("s", "q", F.col("i").alias("first"))
    ends = numbered.select("s", (F.col("q") + F.col("edges")).alias("end"), F.col("i").alias("last"))
    walk = F.struct("s", "q", "edges").alias("walk")
    distinct = spans.groupBy(walk).agg(F.count(F.lit(1)).alias("times")).select("walk", "times", "walk.s", "walk.q", (F.col("walk.q") + F.col("walk.edges")).alias("end"))
    each = distinct.join(begins, ["s", "q"]).join(ends, ["s", "end"]).select("walk", "times", "s", F.explode(F.sequence("first", "last")).alias("i"))
    inside = numbered.select("s", "i", F.struct(F.col("q").alias("at"), F.col("edges").alias("length"), "texts").alias("part"))
    lists = each.join(inside, ["s", "i"]).groupBy("walk", "times").agg(F.collect_list("part").alias("parts"))
    # A passage that many texts hold is one walk of all of them.
    joined = join_counted(spans.select(walk, "t", "p"), lists, "walk", "times", spans.count()).select("t", "p", "walk.s", "walk.q", F.inline("parts"))
    return joined.select("t", (F.col("p") + F.col("at") - F.col("q")).alias("p"), "s", F.col("at").alias("q"), F.col("length").alias("edges"), "texts")


_SPANS = "array<struct<start:int,words:int,source:bigint,source_start:int>>"


def _cut(k: int):
    def run(batches):
        for b in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for doc, text, own, spans in zip(*(c for c in b.columns)):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                if not own.as_py():
                    gone[0] = len(words) >= k
                elif spans.is_valid and len(spans):
                    start, size = (spans.values.field(i).to_numpy() for i in range(2))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + size, -1)
                keep = (np.cumsum(gone)[: len(words)] == 0).tolist()
                out["doc_id"].append(doc.as_py())
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - sum(keep))
                out["kept"].append(b" ".join(w for w, x in zip(words, keep) if x).decode())
            rows = [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), b.column(3)]
            yield pa.record_batch(rows, names=[*out, "spans"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` text and the ``spans`` that the text shares with smaller documents: paths, with their source coordinates.

    A copy of a whole text has no spans: all of it goes.
    """
    texts, found = repeated_edges(docs, id_col, text_col, k)
    runs = materialize(walks(found))
    discard(found)
    spans = walked(runs, materialize(paths(runs)))
    span = F.struct(F.col("p").alias("start"), (F.col("edges") + (k - 1)).alias("words"), F.col("s").alias("source"), F.col("q").alias("source_start"))
    by_text = spans.groupBy("t").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    state = texts.join(by_text, "t", "left").select("d", "tag", "spans", F.lit(True).alias("own"))
    joined = _keyed(docs, id_col, text_col).join(state, ["d", "tag"], "left")
    none = F.array().cast(_SPANS)
    return joined.select("doc_id", "text", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("spans", none).alias("spans")).mapInArrow(_cut(k), f"doc_id long, n_words long, n_removed long, kept string, spans {_SPANS}")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT key, min(doc_id) AS first FROM g GROUP BY key),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (key), range(13) r(j) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d)
SELECT d.doc_id, count(w.w) AS n_words, count(gone.p) AS n_removed, sha256(coalesce(string_agg(w.w, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY d.doc_id
"""
