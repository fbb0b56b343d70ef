"""Merkle fixity audit of WARC replicas.

A record's leaf is the hash of its bytes, header and payload. A level-one node hashes the leaves of one
range of offsets in one file, in offset order; every further node hashes up to ``fan`` nodes below it,
first within a file, then over the files, up to one root. Both replicas' nodes of a level are one table,
written once. The roots are compared first, and only children of mismatching nodes on the next level,
so sound branches cost nothing below their top.

Records are hashed and measured where they are read; only ids, urls, lengths and hashes move. Files
take ``per_file`` consecutive records by a dense number, so an id that repeats fills many files.

Cases: null payloads and urls are empty; pages without an id are left out; rows with a null file or
offset cannot be placed and are left out; records at the same place hash together, and a place differs
if its bag of hashes does; empty replicas have no root, and then every record of the other is missing
or extra; pages equal in id, url and bytes follow each other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators.ranking import number_rows
from landweave.storage import discard, materialize


def _node(rows: DataFrame, file: Column, node: Column, order: str) -> DataFrame:
    inner = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("hash").alias("h"))))
    text = F.array_join(F.transform(inner, lambda x: F.concat_ws("=", x["o"].cast("string"), x["h"])), ",")
    return rows.groupBy("side", file.alias("file"), node.alias("node")).agg(F.sha2(text, 256).alias("hash"))


def build(leaves: DataFrame, range_bytes: int = 1 << 16, fan: int = 16) -> tuple[list[DataFrame], int]:
    """Levels ``side``, ``file``, ``node``, ``hash`` from the bottom up to the root, each written once, over
    ``leaves`` (``side``, ``file``, ``offset``, ``hash``); and how many of them lie within files."""
    top = leaves.agg(F.max("offset").alias("offset"), F.max("file").alias("file")).first()
    file, node = F.col("file"), F.col("node")
    levels = [materialize(_node(leaves, file, F.floor(F.col("offset") / range_bytes), "offset"))]
    most = (top.offset or 0) // range_bytes
    while most > 0:
        most //= fan
        levels.append(materialize(_node(levels[-1], file, F.floor(node / fan), "node")))
    within, files = len(levels), top.file or 0
    while files > 0:
        files //= fan
        levels.append(materialize(_node(levels[-1], F.floor(file / fan), F.lit(0).cast("long"), "file")))
    return levels, within


def _differ(rows: DataFrame, place: str) -> DataFrame:
    """``file``, ``place``, and the hashes ``ha`` and ``hb`` of the two sides where they differ."""
    of = [F.max(F.when(F.col("side") == s, F.col("hash"))).alias(name) for s, name in enumerate(("ha", "hb"))]
    return rows.groupBy("file", place).agg(*of).where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(master: DataFrame, replica: DataFrame, range_bytes: int = 1 << 16, fan: int = 16) -> DataFrame:
    """``file``, ``offset``, ``kind`` (changed, missing, extra) of the replica's places that differ.

    Both tables have ``file`` (long), ``offset`` (long) and ``hash`` of each record.
    """
    sides = [x.where("file is not null and offset is not null").select(F.lit(s).alias("side"), "file", "offset", "hash") for s, x in enumerate((master, replica))]
    leaves = sides[0].unionByName(sides[1])
    levels, within = build(leaves, range_bytes, fan)
    bad = _differ(levels[-1], "node").select("file", "node")
    for level in range(len(levels) - 2, -1, -1):
        up = bad.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        if level >= within - 1:
            parent = F.floor(F.col("file") / fan) == F.col("pf")
        else:
            parent = (F.col("file") == F.col("pf")) & (F.floor(F.col("node") / fan) == F.col("pn"))
        bad = _differ(levels[level].join(up, parent, "left_semi"), "node").select("file", "node")
    up = materialize(bad.select(F.col("file").alias("pf"), F.col("node").alias("pn")))
    discard(*levels)
    near = leaves.join(up, (F.col("file") == F.col("pf")) & (F.floor(F.col("offset") / range_bytes) == F.col("pn")), "left_semi")
    places = near.groupBy("side", "file", "offset").agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("hash"))
    kind = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return _differ(places, "offset").select("file", "offset", kind.alias("kind"))


HEADER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: %s\r\nContent-Length: %s\r\n\r\n"


def record(url: Column, html: Column, stored: Column | None = None) -> Column:
    """Text of a record: the header of ``html``, then ``stored`` (or ``html``) and the closing lines."""
    return F.concat(F.format_string(HEADER, url, F.octet_length(html).cast("string")), html if stored is None else stored, F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_file: int = 500, **more: Column) -> DataFrame:
    """WARC layout of pages: ``file``, ``offset``, ``length``, ``page_id``, ``url``, ``hash``, and the hashes of the records ``more``.

    Records follow each other by id, url, length and hash; a file holds ``per_file`` of them.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    whole = record(url, html)
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("hash"), *[F.sha2(x, 256).alias(k) for k, x in more.items()], F.monotonically_increasing_id().alias("__tie")
    )
    # Rows that differ in nothing but the tie are alike, so it decides nothing but where they are sorted.
    placed = number_rows(rows, ["page_id", "url", "length", "hash", "__tie"], "__n", 0)
    placed = placed.withColumn("file", F.floor(F.col("__n") / per_file))
    order = Window.partitionBy("file").orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).select("file", "offset", "length", "page_id", "url", "hash", *more)


def digest(pages: DataFrame) -> DataFrame:
    """Audit of a replica derived from the pages, in which some records changed a byte and some are gone."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    stored = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.substring(html, 2, 2**31 - 1))).otherwise(html)
    both = materialize(records(pages, other=record(url, html, stored)).select("file", "offset", "page_id", "hash", "other"))
    replica = both.where("page_id % 389 <> 7").select("file", "offset", F.col("other").alias("hash"))
    return audit(both.select("file", "offset", "hash"), replica)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
      'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p),
s AS (SELECT page_id, html, strlen(record) AS n, row_number() OVER (ORDER BY page_id, url, strlen(record), sha256(record)) - 1 AS k FROM r),
o AS (SELECT page_id, html, k // 500 AS file, (sum(n) OVER (PARTITION BY k // 500 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS "offset" FROM s)
SELECT file, "offset", CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'changed' END AS kind
FROM o WHERE page_id % 389 = 7 OR (page_id % 97 = 13 AND substr(html, 1, 1) <> '~')
"""
