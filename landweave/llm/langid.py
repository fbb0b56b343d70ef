"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters) of a text, most frequent first.
A document is compared to each language's profile by the out-of-place distance: over the document's
profile, the sum of the rank differences, with the greatest rank for an n-gram that the language's
profile lacks. The nearest language wins, ties by name; the score is one minus its distance as a part
of the largest possible one.

Profiles are fitted on a bounded sample: of each of the ``languages`` most frequent labels, the training
rows whose id hash falls under a threshold that ``per_language`` of them are expected to meet.
Prediction reads whole texts and nothing but the text.

Cases: a text that is null or holds no letter (numerals such as ½ are none) is ``und`` with score 0;
other letters than the profiles' score low but name the nearest language; training texts without letters
teach nothing, so a label with no others is not learned; rows are never merged; with no training rows every document is
``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, LONGEST = 400, 3
UNKNOWN = "und"
#: Code points have 21 bits, so three of them make one 63-bit key; the top bits of a key hold no length, as no code point is 0 here.
_BITS = 21


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between spaces; each run of what is no letter becomes one space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[c]
    c = np.where(letter, c, 32)
    return c[letter | np.r_[True, letter[:-1]]]


def profile(text: str, top: int = TOP) -> np.ndarray:
    """Keys of the most frequent n-grams, most frequent first, ties by key; the lone space is left out."""
    c = _codes(text)
    key, found = c, [c[c != 32]]
    for n in range(2, LONGEST + 1):
        if len(c) >= n:
            key = (key[:-1] << _BITS) | c[n - 1 :]
            found.append(key)
    every = np.sort(np.concatenate(found))
    at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[at, len(every)])
    if len(at) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = np.flatnonzero(counts >= least)
        at, counts = at[some], counts[some]
    return every[at][np.argsort(-counts, kind="stable")][:top]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, languages: int = 1000, top: int = TOP) -> dict[str, np.ndarray]:
    """Profile of each language from about ``per_language`` rows, chosen by id hash; of more than ``languages`` labels, the most frequent ones."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.where(where) if where is not None else rows
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).collect()}
    if not sizes:
        return {}
    span = 1 << 31
    cuts = docs.sparkSession.createDataFrame([(k, min(span, per_language * span // n)) for k, n in sizes.items()], "lang string, cut long")
    some = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(span)).alias("at"))
    # At most ``languages`` rows.
    sample = some.join(F.broadcast(cuts), "lang").where("at < cut").select("lang", "text")

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                joined = " ".join(t for t, x in zip(texts, langs) if x == lang)
                c = _codes(joined)
                key, found = c, [c[c != 32]]
                for n in range(2, LONGEST + 1):
                    key = (key[:-1] << _BITS) | c[n - 1 :]
                    found.append(key)
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "g", "n"])

    counted = sample.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("rank") <= top)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.g)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _predictor(profiles: dict[str, np.ndarray], top: int):
    names = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int64)
    for i, n in enumerate(names):
        ranks[i, np.searchsorted(grams, profiles[n])] = np.arange(len(profiles[n]))

    def predict(text: str | None) -> tuple[str, float]:
        p = profile(text or "", top)
        if not len(p) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, p)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != p)] = len(grams)
        r = ranks[:, at]
        far = np.where(r < 0, top, np.abs(r - np.arange(len(p)))).sum(axis=1)
        best = int(far.argmin())
        return names[best], float(1 - far[best] / (top * len(p)))

    return predict


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of any columns of those names."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        predict = _predictor(shared.value, top)
        for b in batches:
            found = [predict(t.as_py()) for t in b.column(at)]
            cols = [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.record_batch(cols, names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema.fields)).add("lang_pred", "string").add("score", "double"))


def digest(docs: DataFrame) -> DataFrame:
    profiles = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
