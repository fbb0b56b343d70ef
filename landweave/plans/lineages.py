"""Queries of patches, identity, lineage and sampling (K, M, G, SK)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landweave.functions import geo
from landweave.operators import lineage, patches, sampling
from landweave.plans.book import Book
from landweave.sources import fixtures as fx
from landweave.sources.fixtures import sql
from landweave.storage import scratch_dir

book = Book()


def labels_sql(connectivity: int = 4, source: str = "forest", name: str = "lab") -> str:
    """CTEs that label ``source`` by runs of pixels: runs along rows, links between runs of adjacent rows, smallest run reached."""
    d = 1 if connectivity == 8 else 0
    return f"""+{name}_r AS MATERIALIZED (SELECT year, row, min(col) AS c0, max(col) AS c1, (year * 10000000000 + row * 100000 + min(col))::BIGINT AS id
      FROM (SELECT *, col - row_number() OVER (PARTITION BY year, row ORDER BY col) AS run FROM {source}) GROUP BY year, row, run),
    {name}_e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {name}_r a JOIN {name}_r b ON a.year = b.year AND b.row = a.row + 1 AND a.c0 <= b.c1 + {d} AND b.c0 <= a.c1 + {d}
      UNION ALL SELECT b.id, a.id FROM {name}_r a JOIN {name}_r b ON a.year = b.year AND b.row = a.row + 1 AND a.c0 <= b.c1 + {d} AND b.c0 <= a.c1 + {d}),
    {name}_c(id, low) USING KEY (id) AS (SELECT id, id FROM {name}_r UNION
      SELECT e.b, min(c.low) FROM {name}_c c JOIN {name}_e e ON e.a = c.id JOIN recurring.{name}_c x ON x.id = e.b WHERE c.low < x.low GROUP BY e.b),
    {name} AS MATERIALIZED (SELECT r.year, r.row, u.c::INT AS col, (c.low % 10000000000 + 1)::BIGINT AS patch FROM {name}_r r JOIN {name}_c c USING (id), unnest(range(r.c0, r.c1 + 1)) u(c))"""


LAB = labels_sql(4)
EDGES = LAB + """, edges AS MATERIALIZED (SELECT a.year, a.patch AS parent, b.patch AS child, count(*) AS overlap_px FROM lab a JOIN lab b ON b.year = a.year + 1 AND a.row = b.row AND a.col = b.col GROUP BY ALL),
  px AS MATERIALIZED (SELECT year, patch, count(*) AS area_px FROM lab GROUP BY ALL)"""


def _rec(body: str, *names: str) -> str:
    return sql(body, *names, recursive=True)


def _labels(spark, d, connectivity: int = 4):
    return patches.label_patches(fx.forest(spark, d), connectivity, tile=60)


@book.add(sql("SELECT year, (row // 60)::INT AS ti, (col // 60)::INT AS tj, count(*) AS pixels FROM forest GROUP BY ALL", "forest"))
def k1_tiles(spark, d):
    return patches.tiled(fx.forest(spark, d), 60).groupBy("year", "ti", "tj").agg(F.count(F.lit(1)).alias("pixels"))


@book.add(_rec(LAB + " SELECT year, row, col, patch FROM lab", "forest"))
def k2_k4_k5_patches_4(spark, d):
    return _labels(spark, d)


@book.add(_rec(labels_sql(8) + " SELECT year, row, col, patch FROM lab", "forest"))
def k3_patches_8(spark, d):
    return _labels(spark, d, 8)


@book.add(sql("+p AS (SELECT year, class, row, col FROM landcover), s(r, c) AS (VALUES (0, 1), (1, 0)) SELECT a.year, a.row, a.col, (a.row + r)::INT AS row2, (a.col + c)::INT AS col2 FROM p a, s JOIN p b ON a.year = b.year AND a.class = b.class AND b.row = a.row + r AND b.col = a.col + c", "landcover"))
def j7_neighbours(spark, d):
    return patches.neighbours(fx.landcover(spark, d), 4, "class")


@book.add(_rec(LAB + """, t AS (SELECT year, patch, row // 60 AS ti, col // 60 AS tj, row, col FROM lab) SELECT DISTINCT a.year, a.patch FROM t a JOIN t b ON a.year = b.year AND ((b.row = a.row + 1 AND b.col = a.col) OR (b.col = a.col + 1 AND b.row = a.row)) AND (a.ti <> b.ti OR a.tj <> b.tj)""".replace("t a JOIN t b ON a.year = b.year AND ((b.row = a.row + 1 AND b.col = a.col) OR (b.col = a.col + 1 AND b.row = a.row))", "t a, (VALUES (0, 1), (1, 0)) s(r, c) JOIN t b ON a.year = b.year AND b.row = a.row + s.r AND b.col = a.col + s.c"), "forest"))
def j11_seam_patches(spark, d):
    lab = _labels(spark, d)
    near = patches.neighbours(lab, 4, "patch")
    over = (F.floor(F.col("row") / 60) != F.floor(F.col("row2") / 60)) | (F.floor(F.col("col") / 60) != F.floor(F.col("col2") / 60))
    return near.where(over).join(lab, ["year", "row", "col"]).select("year", "patch").distinct()


@book.add(_rec(LAB + " SELECT year, row, col, patch, dense_rank() OVER (PARTITION BY year ORDER BY patch) AS number FROM lab", "forest"))
def w1_consecutive_labels(spark, d):
    return patches.relabel(_labels(spark, d))


@book.add(_rec(LAB + " SELECT year, patch, count(*) AS area_px, sum(pow(6371008.8 * radians(0.00027), 2) * cos(radians(-5.0 - row * 0.00027)) / 10000) AS area_ha, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1 FROM lab GROUP BY year, patch", "forest"), ["area_ha"])
def g24_g25_patch_area_box(spark, d):
    lab = _labels(spark, d)
    area = geo.pixel_area_ha(-5.0 - F.col("row") * 0.00027, 0.00027)
    return patches.areas(lab, hectares=area).join(patches.boxes(lab), ["year", "patch"])


@book.add(_rec(LAB + ", big AS (SELECT year, patch FROM lab GROUP BY ALL HAVING sum(pow(6371008.8 * radians(0.00027), 2) * cos(radians(-5.0 - row * 0.00027)) / 10000) > 1) SELECT year, row, col, patch FROM lab SEMI JOIN big USING (year, patch)", "forest"))
def k9_f12_small_patches(spark, d):
    return patches.drop_small(_labels(spark, d), geo.pixel_area_ha(-5.0 - F.col("row") * 0.00027, 0.00027))


def identity_sql(policy: str = "inherit", overlap: str = "pixels") -> str:
    steps = ["i1995 AS MATERIALIZED (SELECT 1995 AS year, patch, row_number() OVER (ORDER BY patch) AS id FROM (SELECT DISTINCT patch FROM lab WHERE year = 1995))"]
    so_far = "SELECT max(id) FROM i1995"
    for y in range(1996, 2002):
        before = f"(SELECT l.row, l.col, i.id FROM lab l JOIN i{y - 1} i ON l.year = {y - 1} AND l.patch = i.patch)"
        if overlap == "pixels":
            meets = f"SELECT l.patch, b.id FROM lab l JOIN {before} b ON l.row = b.row AND l.col = b.col WHERE l.year = {y}"
        else:
            meets = f"SELECT x.patch, b.id FROM (SELECT patch, min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM lab WHERE year = {y} GROUP BY patch) x JOIN {before} b ON b.row BETWEEN r0 AND r1 AND b.col BETWEEN c0 AND c1"
        taken = f"SELECT patch, min(id) AS id FROM ({meets}) GROUP BY patch HAVING min(id) = max(id)"
        if policy == "split_new":
            taken = f"SELECT patch, id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM ({taken})) WHERE k = 1"
        steps.append(f"t{y} AS MATERIALIZED ({taken})")
        steps.append(f"i{y} AS MATERIALIZED (SELECT {y} AS year, patch, id FROM t{y} UNION ALL SELECT {y}, patch, (SELECT max(m) FROM ({so_far}) q(m)) + row_number() OVER (ORDER BY patch) FROM (SELECT DISTINCT patch FROM lab WHERE year = {y}) WHERE patch NOT IN (SELECT patch FROM t{y}))")
        so_far += f" UNION ALL SELECT max(id) FROM i{y}"
    return ", ".join(steps)


IDS = ", ids AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM i{y}" for y in range(1995, 2002)) + ")"


@book.add(_rec(LAB + ", " + identity_sql() + IDS + " SELECT year, patch, id FROM ids", "forest"))
def k7_l4_identity(spark, d):
    return patches.identity(_labels(spark, d))


@book.add(_rec(LAB + ", " + identity_sql("split_new") + IDS + " SELECT year, patch, id FROM ids", "forest"))
def k7_identity_split_new(spark, d):
    return patches.identity(_labels(spark, d), "split_new")


@book.add(_rec(LAB + ", " + identity_sql("inherit", "box") + IDS + " SELECT year, patch, id FROM ids", "forest"))
def k6_identity_by_box(spark, d):
    return patches.identity(_labels(spark, d), overlap="box")


@book.add(_rec(LAB + ", " + identity_sql() + IDS + " SELECT year, patch, id FROM ids", "forest"))
def st3_carried_identity(spark, d):
    """Years up to 1998, their state kept by year, and a later run over all years that goes on from it."""
    lab, store = _labels(spark, d), f"{scratch_dir(spark)}/landweave-{uuid.uuid4().hex}"
    patches.identity(lab.where("year <= 1998"), store=store)
    return patches.identity(lab, store=store)


@book.add(_rec(EDGES + " SELECT (year - 1995)::INT AS step, ((parent - 1) // 100000 // 60 * 1000 + (parent - 1) % 100000 // 60)::INT AS parent_tile, parent, ((child - 1) // 100000 // 60 * 1000 + (child - 1) % 100000 // 60)::INT AS child_tile, child FROM edges", "forest"))
def ud4_lineage_tuples(spark, d):
    t = lineage.tuples(lineage.edges(_labels(spark, d)), 60)
    return t.select("step", F.col("parent.tile").alias("parent_tile"), F.col("parent.patch").alias("parent"), F.col("child.tile").alias("child_tile"), F.col("child.patch").alias("child"))


NEAR = """+o(r) AS (VALUES (-1), (0), (1)), reach AS MATERIALIZED (SELECT DISTINCT year + 1 AS year, row + a.r AS row, col + b.r AS col FROM forest, o a, o b),
 split AS MATERIALIZED (SELECT f.year * 10 + CASE WHEN reach.row IS NULL AND f.year > 1995 THEN 1 ELSE 0 END AS year, f.row, f.col FROM forest f LEFT JOIN reach ON f.year = reach.year AND f.row = reach.row AND f.col = reach.col), """


@book.add(_rec(NEAR + labels_sql(8, "split").removeprefix("+") + " SELECT (year // 10)::INT AS year, (year % 10)::INT AS apart, row, col, patch FROM lab", "forest"))
def k8_cut_growth(spark, d):
    return patches.cut_growth(fx.forest(spark, d))


@book.add(_rec(EDGES + " SELECT * FROM edges", "forest"))
def k10_g6_lineage_edges(spark, d):
    return lineage.edges(_labels(spark, d))


@book.add(_rec(LAB + """, t AS (SELECT year, row // 60 AS ti, col // 60 AS tj, row, col, patch FROM lab), h AS (SELECT year, ti, tj, patch, count(*) AS px FROM t GROUP BY ALL),
  p AS (SELECT a.year, a.ti, a.tj, a.patch AS parent, b.patch AS child, count(*) AS n FROM t a JOIN t b ON b.year = a.year + 1 AND a.row = b.row AND a.col = b.col GROUP BY ALL)
  SELECT p.year, parent, child, sum(n)::BIGINT AS overlap_px, sum(px)::BIGINT AS parent_px_in_shared_tiles FROM p JOIN h ON p.year = h.year AND p.ti = h.ti AND p.tj = h.tj AND p.parent = h.patch GROUP BY ALL""", "forest"))
def k10_g5_tile_edges(spark, d):
    return lineage.tile_edges(_labels(spark, d), 60)


@book.add(_rec(LAB + ", a AS (SELECT year, row, col, patch AS parent FROM lab), b AS (SELECT year - 1 AS year, row, col, patch AS child FROM lab) SELECT year, coalesce(parent, 0) AS parent, coalesce(child, 0) AS child, count(*) AS overlap_px FROM a FULL JOIN b USING (year, row, col) WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL", "forest"))
def k10_edges_with_background(spark, d):
    return lineage.with_background(_labels(spark, d))


LOST = "SELECT year, patch, 'lost' AS what FROM px WHERE year < 2001 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.year = px.year AND e.parent = px.patch) UNION ALL SELECT year, patch, 'gained' FROM px WHERE year > 1995 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.year + 1 = px.year AND e.child = px.patch)"


@book.add(_rec(EDGES + " " + LOST, "forest"))
def k11_lost_and_gained(spark, d):
    lab = _labels(spark, d)
    return lineage.lost_and_gained(lab, lineage.edges(lab))


@book.add(_rec(EDGES + " SELECT e.year, parent, child, overlap_px, a.area_px AS parent_px, b.area_px AS child_px FROM edges e JOIN px a ON a.year = e.year AND a.patch = parent JOIN px b ON b.year = e.year + 1 AND b.patch = child", "forest"))
def k12_f8_edge_query(spark, d):
    lab = _labels(spark, d)
    return lineage.query_edges(lineage.edges(lab), lineage.nodes(lab))


@book.add(_rec(EDGES + ", " + identity_sql() + IDS + """, k AS (SELECT ids.year, id, sum(area_px)::BIGINT AS a FROM ids JOIN px USING (year, patch) GROUP BY ALL), ch AS (SELECT k.*, n.a - k.a AS d FROM k LEFT JOIN k n ON n.year = k.year + 1 AND n.id = k.id),
  dg AS (SELECT id, sum(((SELECT count(*) FROM edges e WHERE e.year + 1 = ids.year AND e.child = ids.patch) > 1)::INT)::BIGINT AS merges, sum(((SELECT count(*) FROM edges e WHERE e.year = ids.year AND e.parent = ids.patch) > 1)::INT)::BIGINT AS splits FROM ids GROUP BY id)
  SELECT id, min(year) AS first_year, max(year) AS last_year, max(year) - min(year) + 1 AS lifetime, max(a) AS largest_px, arg_min(a, year) AS first_px, arg_max(a, year) AS last_px, coalesce(-sum(CASE WHEN d < 0 THEN d END), 0)::BIGINT AS lost_px, coalesce(sum(CASE WHEN d > 0 THEN d END), 0)::BIGINT AS gained_px, any_value(merges) AS merges, any_value(splits) AS splits FROM ch JOIN dg USING (id) GROUP BY id""", "forest"))
def k13_lifecycle(spark, d):
    lab = _labels(spark, d)
    return lineage.lifecycle(lab, patches.identity(lab))


@book.add(_rec(EDGES + """, ou AS (SELECT year, parent AS patch, count(*) AS children FROM edges GROUP BY ALL), co AS (SELECT year + 1 AS year, child AS patch, count(*) AS parents FROM edges GROUP BY ALL),
  dg AS (SELECT px.*, coalesce(children, 0) AS children, coalesce(parents, 0) AS parents FROM px LEFT JOIN ou USING (year, patch) LEFT JOIN co USING (year, patch)),
  up AS (SELECT e.year + 1 AS year, e.child AS patch, max(g.children) AS siblings FROM edges e JOIN dg g ON g.year = e.year AND g.patch = e.parent GROUP BY ALL),
  dn AS (SELECT e.year, e.parent AS patch, max(g.parents) AS mates FROM edges e JOIN dg g ON g.year = e.year + 1 AND g.patch = e.child GROUP BY ALL)
  SELECT year, patch, area_px, parents, children, CASE WHEN year = 1995 THEN NULL WHEN parents = 0 THEN 'birth' WHEN parents > 1 THEN 'merge' WHEN siblings > 1 THEN 'split' ELSE 'continue' END AS origin,
  CASE WHEN year = 2001 THEN NULL WHEN children = 0 THEN 'loss' WHEN children > 1 THEN 'split' WHEN mates > 1 THEN 'merge' ELSE 'continue' END AS fate FROM dg LEFT JOIN up USING (year, patch) LEFT JOIN dn USING (year, patch)""", "forest"))
def k14_lineage_events(spark, d):
    lab = _labels(spark, d)
    return lineage.events(lab, lineage.edges(lab))


@book.add(_rec(EDGES + " SELECT year, patch, CASE WHEN year <= 1998 THEN area_px + 1 ELSE area_px END AS area_px FROM px", "forest"))
def sk4_upsert_nodes(spark, d):
    new = lineage.nodes(_labels(spark, d))
    old = new.where("year <= 1998").withColumn("area_px", F.col("area_px") + 1)
    return lineage.upsert(old, new)




def _h(k: str, s: int = 0) -> str:
    return f"((({k})::HUGEINT + {s}) % 2147483648 * 2654435761 % 4294967296)::BIGINT"


@book.add(sql(f"+r AS (SELECT id, row_number() OVER (ORDER BY {_h('id')}, id) - 1 AS n, (SELECT count(*) FROM points) AS k FROM points) SELECT id, CASE WHEN n < floor(k * 0.6 + 1e-9) THEN 'train' WHEN n < floor(k * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r", "points"))
def w3_m1_split(spark, d):
    return sampling.split(fx.points(spark, d), "id").select("id", "split")


@book.add(sql(f"+q(class, quota) AS (VALUES (3, 1800), (9, 300), (12, 150), (15, 780), (18, 300), (24, 150), (30, 150), (33, 150)), k AS (SELECT *, ((year::BIGINT * 100000 + row) * 100000 + col) AS id FROM landcover), r AS (SELECT k.*, quota, row_number() OVER (PARTITION BY class ORDER BY {_h('id')}, id) AS n FROM k JOIN q USING (class)) SELECT year, row, col, class FROM r WHERE n <= quota", "landcover"))
def w4_m2_f11_quota_sample(spark, d):
    rows = fx.landcover(spark, d).withColumn("id", (F.col("year").cast("long") * 100000 + F.col("row")) * 100000 + F.col("col"))
    return sampling.quota_sample(rows, sampling.quotas(spark, fx.SHARES), "id", "class").select("year", "row", "col", "class")


CHIP = "+chip AS (SELECT year * 1000000 + row // 10 * 1000 + col // 10 AS chip_id, class FROM landcover)"


def _chip_classes(spark, d):
    cid = (F.col("year") * 1000000 + F.floor(F.col("row") / 10) * 1000 + F.floor(F.col("col") / 10)).cast("long").alias("chip_id")
    return fx.landcover(spark, d).select(cid, "class")


@book.add(sql(CHIP + " SELECT chip_id, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM chip GROUP BY chip_id", "landcover"))
def g23_class_combinations(spark, d):
    c = sampling.class_combination(_chip_classes(spark, d))
    return c.select("chip_id", F.array_join(F.transform("classes", lambda x: x.cast("string")), ",").alias("classes"))


@book.add(sql(CHIP + f", c AS (SELECT chip_id, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM chip GROUP BY chip_id), r AS (SELECT *, row_number() OVER (PARTITION BY classes ORDER BY {_h('chip_id')}, chip_id) AS n, count(*) OVER (PARTITION BY classes) AS k FROM c) SELECT chip_id, classes FROM r WHERE n <= floor(k * 0.2)", "landcover"))
def m3_share_sample(spark, d):
    return sampling.share_sample(g23_class_combinations(spark, d), ["classes"], "chip_id").select("chip_id", "classes")


@book.add(sql(CHIP + " SELECT chip_id, class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY chip_id) AS share FROM chip GROUP BY chip_id, class", "landcover"), ["share"])
def g8_class_shares(spark, d):
    return sampling.class_shares(_chip_classes(spark, d))


def _wide(spark, d):
    return sampling.wide_shares(sampling.class_shares(_chip_classes(spark, d)), fx.CLASSES)


@book.add(sql(CHIP + " SELECT chip_id, " + ", ".join(f"avg((class = {c})::INT) AS c{c}" for c in fx.CLASSES) + " FROM chip GROUP BY chip_id", "landcover"), [f"c{c}" for c in fx.CLASSES])
def g8_chip_profiles(spark, d):
    return _wide(spark, d)


TARGET = "+t(class, target) AS (VALUES (3, 0.44), (9, 0.07), (12, 0.04), (15, 0.19), (18, 0.07), (24, 0.04), (30, 0.04), (33, 0.04)), s AS (SELECT year, class, count(*) AS n FROM landcover GROUP BY ALL), y AS (SELECT year, sum(n) AS total FROM s GROUP BY year), j AS (SELECT y.year, t.class, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / total AS share, target::DOUBLE AS target FROM t CROSS JOIN y LEFT JOIN s ON s.year = y.year AND s.class = t.class)"


def _found(spark, d):
    t = spark.createDataFrame([(3, 0.44), (9, 0.07), (12, 0.04), (15, 0.19), (18, 0.07), (24, 0.04), (30, 0.04), (33, 0.04)], "class int, target double")
    return sampling.distribution(fx.landcover(spark, d), t, keys=["year"])


@book.add(sql(TARGET + " SELECT year, class, n, share, target, share - target AS difference FROM j", "landcover"), ["share", "target", "difference"])
def g9_m6_distribution(spark, d):
    return _found(spark, d)


@book.add(sql(TARGET + " SELECT year, class, round(target / share * target * 3000)::INT AS quota FROM j", "landcover"))
def m6_adjusted_quotas(spark, d):
    return sampling.adjusted_quotas(_found(spark, d), 3000, keys=["year"])


@book.add(sql("+s AS (SELECT c_nationkey % 7 AS cluster, count(*) AS size FROM customer GROUP BY 1) SELECT cluster::BIGINT AS cluster, size, round_even(1000.0 * size / (SELECT sum(size) FROM s), 0)::INT AS quota, (1000 // (SELECT count(*) FROM s))::INT AS equal FROM s", "g"))
def m5_cluster_quotas(spark, d):
    c = fx.table(spark, d, "customer").select((F.col("c_nationkey") % 7).cast("long").alias("cluster"))
    equal = sampling.cluster_quotas(c, 1000, equal=True).select("cluster", F.col("quota").alias("equal"))
    return sampling.cluster_quotas(c, 1000).join(equal, "cluster")


@book.add(sql(f"+r AS (SELECT id, row_number() OVER (ORDER BY {_h('id', 7)}, id) - 1 AS idx FROM points) SELECT id, idx, CASE WHEN idx < 50 THEN 0 WHEN idx < 100 THEN 1 ELSE 2 END AS analyst FROM r WHERE idx < 151", "points"))
def m8_shares_of_work(spark, d):
    p = fx.points(spark, d).withColumn("h", sampling.hash_order("id", 7))
    return sampling.shares_of_work(p, ["h", "id"], [(0, 50), (50, 100), (100, 151)]).select("id", "idx", "analyst")


@book.add()
def m4_cluster_profiles(spark, d):
    found, _ = sampling.cluster_profiles(_wide(spark, d), [f"c{c}" for c in fx.CLASSES], ks=(2, 3))
    return found.select("chip_id", "cluster")


@book.add()
def m7_principal_components(spark, d):
    return sampling.principal_components(_wide(spark, d), [f"c{c}" for c in fx.CLASSES])


VARIANCES = """+w AS (SELECT row // 10 AS ti, col // 10 AS tj, 30 * avg((class = 3)::INT) AS a, 30 * avg((class = 9)::INT) AS b, 30 * avg((class = 15)::INT) AS c FROM landcover GROUP BY ALL),
 v AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM w)
 SELECT aa + bb + cc AS total, aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc) AS squares, aa * bb * cc + 2 * ab * ac * bc - aa * bc * bc - bb * ac * ac - cc * ab * ab AS product FROM v"""


@book.add(sql(VARIANCES, "landcover"), ["total", "squares", "product"])
def m7_component_variances(spark, d):
    """Variances of all three components, by their sum, sum of squares and product: trace, norm and determinant of the covariance."""
    chip = F.concat_ws("_", F.floor(F.col("row") / 10), F.floor(F.col("col") / 10)).alias("chip_id")
    wide = sampling.wide_shares(sampling.class_shares(fx.landcover(spark, d).select(chip, "class")), [3, 9, 15])
    scaled = wide.select("chip_id", *[(F.col(c) * 30).alias(c) for c in ("c3", "c9", "c15")])
    pcs = sampling.principal_components(scaled, ["c3", "c9", "c15"], 3)
    v = pcs.agg(*[F.var_samp(f"pc{i}").alias(f"v{i}") for i in (1, 2, 3)])
    return v.select(F.expr("v1 + v2 + v3").alias("total"), F.expr("v1 * v1 + v2 * v2 + v3 * v3").alias("squares"), F.expr("v1 * v2 * v3").alias("product"))
