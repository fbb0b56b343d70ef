"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm import decontam, langid, linededup, packing, simhash_wide
from landweave.operators.overlay import small
from landweave.storage import discard, materialize

#: Documents that score lower are of no known language. Ordinary text scores several times as much.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised go on; profiles come from those labelled and not held out."""
    found = langid.identify(docs, langid.fit(docs, ~langid.held_out()))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that recur in many documents; ``n_chars`` follows, and emptied documents go."""
    cut = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    cut = cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.where(~changed | (F.trim("text") != "")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, similarity 0.8); rows that repeat an id stay together."""
    classes = simhash_wide.near_duplicates(docs, shingle=5, similarity=0.8)
    gone = classes.groupBy(F.col("doc_id").alias("gone")).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first")).where("not first")
    return docs.join(small(materialize(gone.select("gone"))), docs["doc_id"].eqNullSafe(F.col("gone")), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.digest(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]
#: SQL has neither the profiles' fit nor the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
