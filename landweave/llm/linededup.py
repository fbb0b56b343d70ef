"""Line dedup: drop lines that recur in many documents, keeping those of the last document.

Native DataFrame operations only. Line keys are range-partitioned by (hash, document) and sorted by
(hash, document, position), so that one frequent line spreads over many tasks; a window streams each
task's sorted rows and marks a line's first occurrence in its document. Only those are counted, with
partial counts before anything moves. What comes back for a document is a compressed keep bitmap, the
start and length of each run of dropped lines, not text.

Cases: a null or empty text is one empty line; keys are compared after ASCII trimming and lowering;
a line repeated in one document counts once for that document but all of its lines share the fate;
rows that share a ``doc_id``, null included, are one document in the counts, and each keeps its own
text; an empty table gives an empty result. Columns besides
the named ones are ignored. Work grows in proportion to a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators.skew import join_counted
from landweave.storage import discard, materialize

#: The white space that the key rule strips.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(SPACES))
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per text that loses lines: ``doc_id``, ``row`` (hash of the text), ``n_dropped``, ``dropped``.

    ``dropped`` holds the first position and length of each run of dropped lines, in order.
    """
    # The hash of a text is made before its lines part, so that no line carries the text.
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), _lines(F.col(text_col)).alias("lines"))
    rows = (
        split.select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.unhex(F.md5("key")).alias("h"), "doc_id", "row", "pos")
    )
    rows = materialize(rows)
    # The window's groups and order are those of the range partitions: it streams them without another exchange or sort.
    ranged = rows.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "pos")
    place = F.row_number().over(Window.partitionBy("h", "doc_id").orderBy("pos"))
    marked = materialize(ranged.select("h", "doc_id", "row", "pos", (place == 1).alias("first")))
    discard(rows)
    spread = materialize(marked.where("first").groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs))
    # The number of lines under each of these keys says which of them are heavy.
    times = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    spread = spread.join(times, "h").select("h", "keeper", "n")
    lost = join_counted(marked, spread, "h", "n", marked.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Positions less their ranks are equal within a run; repeated rows share a rank.
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "row").orderBy("pos"))
    runs = lost.select("doc_id", "row", "pos", (F.col("pos") - rank).alias("run")).groupBy("doc_id", "row", "run").agg(F.min("pos").alias("at"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    found = runs.groupBy("doc_id", "row").agg(F.sum("length").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("at", "length"))).alias("dropped"))
    return found.select("doc_id", "row", "n_dropped", "dropped")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs, joined: one slice for each stretch between runs."""

    def cut(both: Column) -> Column:
        gone, every = both["gone"], both["every"]
        begin = lambda i: F.coalesce(F.get(gone, i - 1)["at"] + F.get(gone, i - 1)["length"], F.lit(0))
        end = lambda i: F.coalesce(F.get(gone, i)["at"], F.size(every))
        parts = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.when(end(i) > begin(i), F.array_join(F.slice(every, begin(i) + 1, end(i) - begin(i)), "\n")))
        # A stretch without lines is null, which the join leaves out.
        return F.array_join(parts, "\n")

    # One name for both arrays, so that each is made once for a text.
    return F.element_at(F.transform(F.array(F.struct(dropped.alias("gone"), lines.alias("every"))), cut), 1)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; its text without the dropped lines; and ``n_lines``, ``n_dropped`` in place of any columns of those names."""
    runs = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("n_dropped").alias("__n"), F.col("dropped").alias("__gone"))
    joined = docs.join(runs, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__row")), "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(_without(lines, F.col("__gone")))
    kept_cols = [F.col(c) if c != text_col else kept.alias(text_col) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*kept_cols, F.size(lines).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame, **limits) -> DataFrame:
    cut = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, **limits))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
