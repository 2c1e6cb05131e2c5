"""Registered box, matching, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runmosaic.operators import boxes as B
from runmosaic.operators import masks as M
from runmosaic.operators import prompts as R
from runmosaic.operators import sampling as P
from runmosaic.plans import views as V
from runmosaic.plans.registry import registry
from runmosaic.plans.views import H, W, sql

QUERIES, ORACLE, query = registry()

OVER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
IOU = f"({OVER}::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {OVER}))"


@query("box_pairs", sql("boxes", f"SELECT a.image_id, a.box_id AS id_a, b.box_id AS id_b, {OVER} AS overlap, {IOU} AS iou "
                        f"FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id WHERE {OVER} > 0"))
def box_pairs(spark, sf_dir):
    b = V.boxes(spark, sf_dir)
    return B.overlapping(b, b, "box_id", "box_id").filter("id_a < id_b").select("image_id", "id_a", "id_b", "overlap", "iou")


# boxes from 1 to 50,000 pixels long; most lie apart
WIDE = ("wide AS (SELECT image_id // 64 AS image_id, box_id, (box_id * 7919) % 200000 AS x1, (box_id * 104729 + image_id) % 200000 AS y1, "
        "(box_id * 7919) % 200000 + n AS x2, (box_id * 104729 + image_id) % 200000 + 1 + n // (1 + box_id % 3) AS y2 FROM "
        "(SELECT *, CASE WHEN box_id % 40 = 0 THEN 50000 WHEN box_id % 8 = 0 THEN 1 + (box_id * 31) % 4000 ELSE 1 + (box_id * 31) % 90 END AS n FROM boxes))")


@query("box_pairs_sizes", sql("boxes", f"WITH {WIDE} SELECT a.image_id, a.box_id AS id_a, b.box_id AS id_b, {OVER} AS overlap, {IOU} AS iou "
                              f"FROM wide a JOIN wide b ON a.image_id = b.image_id AND a.box_id < b.box_id WHERE {OVER} > 0"))
def box_pairs_sizes(spark, sf_dir):
    """Boxes of very different sizes, many to an image."""
    b = V.boxes(spark, sf_dir).selectExpr("image_id", "box_id", "case when box_id % 40 = 0 then 50000L when box_id % 8 = 0 then 1 + ((box_id % 4000) * 31) % 4000 else 1 + ((box_id % 90) * 31) % 90 end as n")
    # the same remainders by way of small numbers: the products of large ids pass 64 bits
    b = b.selectExpr("image_id div 64 as image_id", "box_id", "((box_id % 200000) * 7919) % 200000 as x1", "((box_id % 200000) * 104729 + image_id % 200000) % 200000 as y1", "n")
    # dealt out by the new image while narrow; what they unfold into, by level and cell, stays there
    b = V.spread(b.selectExpr("image_id", "box_id", "x1", "y1", "x1 + n as x2", "y1 + 1 + n div (1 + box_id % 3) as y2"), "image_id")
    return B.overlapping(b, b, "box_id", "box_id").filter("id_a < id_b").select("image_id", "id_a", "id_b", "overlap", "iou")


@query("box_nms", sql("boxes", f""", r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS k FROM boxes),
  g AS (SELECT image_id, k, [] AS gone, CAST([] AS BIGINT[]) AS kept FROM r WHERE false),
  conflict AS (SELECT b.image_id, b.k, list(a.k) AS better FROM r a JOIN r b ON a.image_id = b.image_id AND a.k < b.k WHERE {IOU} > 0.45 GROUP BY ALL),
  step AS (SELECT image_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM boxes)
   UNION ALL SELECT s.image_id, s.k + 1, CASE WHEN c.better IS NOT NULL AND list_has_any(s.kept, c.better) THEN s.kept ELSE list_append(s.kept, s.k + 1) END
   FROM step s JOIN r ON r.image_id = s.image_id AND r.k = s.k + 1 LEFT JOIN conflict c ON c.image_id = s.image_id AND c.k = s.k + 1),
  fin AS (SELECT image_id, unnest(kept) AS k FROM step QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY step.k DESC) = 1)
  SELECT r.image_id, r.box_id, r.score FROM fin JOIN r USING (image_id, k)""".replace(
      "g AS (SELECT image_id, k, [] AS gone, CAST([] AS BIGINT[]) AS kept FROM r WHERE false),\n", "").replace(", r AS", "WITH r AS", 1)
      .replace("SELECT image_id, unnest(kept) AS k FROM step QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY step.k DESC) = 1",
               "SELECT image_id, unnest(kept) AS k FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1)"), True))
def box_nms(spark, sf_dir):
    return B.nms(V.boxes(spark, sf_dir), 0.45).select("image_id", "box_id", "score")


@query("max_detections", sql("boxes", "SELECT image_id, box_id, score FROM boxes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) <= 3"))
def max_detections(spark, sf_dir):
    return B.top_per_image(V.boxes(spark, sf_dir), 3).select("image_id", "box_id", "score")


MATCH = """, cand AS (SELECT a.image_id, a.box_id AS pred, a.score, b.gt_id AS gt, {iou} AS iou FROM boxes a JOIN gt b ON a.image_id = b.image_id WHERE {iou} >= 0.5),
  steps AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS step),
  wish AS (SELECT image_id, step, pred, score, list(gt ORDER BY iou DESC, gt) AS want FROM cand JOIN steps ON iou >= step GROUP BY ALL),
  ord AS (SELECT *, row_number() OVER (PARTITION BY image_id, step ORDER BY score DESC, pred) AS k FROM wish),
  go AS (SELECT image_id, step, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS pred, NULL::BIGINT AS gt FROM (SELECT DISTINCT image_id, step FROM ord)
   UNION ALL SELECT g.image_id, g.step, g.k + 1, CASE WHEN pick IS NULL THEN g.used ELSE list_append(g.used, pick) END, o.pred, pick
   FROM go g JOIN (SELECT * FROM ord) o ON o.image_id = g.image_id AND o.step = g.step AND o.k = g.k + 1,
    LATERAL (SELECT list_filter(o.want, lambda x: NOT list_contains(g.used, x))[1] AS pick)),
  hits AS (SELECT image_id, step, pred, gt FROM go WHERE gt IS NOT NULL)""".replace("{iou}", IOU).replace(", cand", "WITH cand", 1)


@query("detection_matches", sql("boxes gt", MATCH + " SELECT image_id, step, pred, gt FROM hits", True))
def detection_matches(spark, sf_dir):
    return B.matches_by_threshold(B.box_candidates(V.boxes(spark, sf_dir), V.truth_boxes(spark, sf_dir))).select("image_id", "step", "pred", "gt")


@query("f_beta", sql("images boxes gt", MATCH + """, n AS (SELECT i.image_id, step, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp
   FROM images i CROSS JOIN steps LEFT JOIN (SELECT image_id, count(*) AS np FROM boxes GROUP BY 1) p ON p.image_id = i.image_id
   LEFT JOIN (SELECT image_id, count(*) AS ng FROM gt GROUP BY 1) q ON q.image_id = i.image_id
   LEFT JOIN (SELECT image_id, step, count(*) AS tp FROM hits GROUP BY ALL) h USING (image_id, step))
  SELECT image_id, round(avg(CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE ELSE 5.0::DOUBLE * tp / (5 * tp + 4 * (ng - tp) + (np - tp)) END), 9) AS f_beta
  FROM n GROUP BY image_id""".replace("h USING (image_id, step))", "h ON h.image_id = i.image_id AND h.step = steps.step)").replace("SELECT i.image_id, step,", "SELECT i.image_id, steps.step,"), True))
def f_beta(spark, sf_dir):
    p, g = V.boxes(spark, sf_dir), V.truth_boxes(spark, sf_dir)
    out = B.f_beta(V.images(spark, sf_dir), p, g, B.box_candidates(p, g))
    return out.withColumn("f_beta", F.round("f_beta", 9))


AP_SQL = MATCH + """, lev AS (SELECT score, step, count(*) AS n FROM boxes, steps GROUP BY ALL),
  t AS (SELECT h.step, b.score, count(*) AS tp FROM hits h JOIN boxes b ON b.image_id = h.image_id AND b.box_id = h.pred GROUP BY ALL),
  cur AS (SELECT lev.step, lev.score, sum(coalesce(tp, 0)) OVER w AS tp, sum(n) OVER w AS n FROM lev LEFT JOIN t ON t.step = lev.step AND t.score = lev.score
    WINDOW w AS (PARTITION BY lev.step ORDER BY lev.score DESC)),
  pr AS (SELECT step, tp::DOUBLE / n AS precision, tp::DOUBLE / (SELECT count(*) FROM gt) AS recall FROM cur),
  pts AS (SELECT i / 100.0::DOUBLE AS r FROM range(101) x(i))
  SELECT step, round(sum(p) / 101, 6) AS ap FROM (SELECT s.step, r, coalesce(max(precision), 0) AS p FROM steps s CROSS JOIN pts
    LEFT JOIN pr ON pr.step = s.step AND recall >= r - 1e-11::DOUBLE GROUP BY ALL) GROUP BY step"""


@query("average_precision", sql("boxes gt", AP_SQL, True))
def average_precision(spark, sf_dir):
    p, g = V.boxes(spark, sf_dir), V.truth_boxes(spark, sf_dir)
    return B.average_precision(p, g, B.box_candidates(p, g)).withColumn("ap", F.round("ap", 6))


# scores with many decimals, nearly all distinct
FINE = "l_extendedprice / cast(200000.0 as double)"


@query("average_precision_fine", sql("boxes gt", AP_SQL, True).replace(V.SHIP_COLUMNS["score"] + " AS score", FINE.replace("cast(200000.0 as double)", "200000.0::DOUBLE") + " AS score"))
def average_precision_fine(spark, sf_dir):
    p, g = V.boxes(spark, sf_dir, FINE), V.truth_boxes(spark, sf_dir)
    return B.average_precision(p, g, B.box_candidates(p, g)).withColumn("ap", F.round("ap", 6))


@query("mask_iou_pairs", sql("truth pred", """, a AS (SELECT image_id, ship_id, sum(r1 - r0) AS n FROM truth GROUP BY ALL),
  o AS (SELECT p.image_id, p.ship_id AS pred, t.ship_id AS gt, sum(least(p.r1, t.r1) - greatest(p.r0, t.r0))::BIGINT AS overlap
   FROM pred p JOIN truth t ON p.image_id = t.image_id AND p.col = t.col AND p.r0 < t.r1 AND t.r0 < p.r1 GROUP BY ALL)
  SELECT o.image_id, pred, gt, overlap, overlap::DOUBLE / (x.n + y.n - overlap) AS iou FROM o
   JOIN a x ON x.image_id = o.image_id AND x.ship_id = pred JOIN a y ON y.image_id = o.image_id AND y.ship_id = gt""".replace(", a AS", "WITH a AS", 1)))
def mask_iou_pairs(spark, sf_dir):
    p = V.pred_segments(spark, sf_dir, "ship_id").withColumnRenamed("ship_id", "box_id")
    g = V.truth_segments(spark, sf_dir, "ship_id").withColumnRenamed("ship_id", "gt_id")
    return B.mask_iou_pairs(p, g).select("image_id", "pred", "gt", "overlap", "iou")


MASK_IOU = """WITH ta AS (SELECT image_id, ship_id, sum(r1 - r0) AS n FROM truth GROUP BY ALL),
  o AS (SELECT p.image_id, p.ship_id AS pred, t.ship_id AS gt, sum(least(p.r1, t.r1) - greatest(p.r0, t.r0)) AS overlap
   FROM pred p JOIN {other} t ON p.image_id = t.image_id AND p.col = t.col AND p.r0 < t.r1 AND t.r0 < p.r1 GROUP BY ALL),
  mi AS (SELECT o.image_id, pred, gt, overlap::DOUBLE / (x.n + y.n - overlap) AS iou FROM o
   JOIN ta x ON x.image_id = o.image_id AND x.ship_id = pred JOIN ta y ON y.image_id = o.image_id AND y.ship_id = gt)"""
MASK_MATCH = MASK_IOU.format(other="truth") + ", cand AS (SELECT mi.image_id, pred, score, gt, iou FROM mi JOIN boxes ON boxes.image_id = mi.image_id AND box_id = pred WHERE iou >= 0.5)" + MATCH[MATCH.index(",\n  steps AS"):]


def mask_inputs(spark, sf_dir):
    p = V.pred_segments(spark, sf_dir, "ship_id").withColumnRenamed("ship_id", "box_id")
    return p, V.truth_segments(spark, sf_dir, "ship_id").withColumnRenamed("ship_id", "gt_id"), V.boxes(spark, sf_dir)


@query("mask_nms", sql("boxes truth pred", MASK_IOU.format(other="pred") + """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS k FROM boxes),
  conflict AS (SELECT b.image_id, b.k, list(a.k) AS better FROM mi JOIN r a ON a.image_id = mi.image_id AND a.box_id = pred JOIN r b ON b.image_id = mi.image_id AND b.box_id = gt
   WHERE iou > 0.3 AND a.k < b.k GROUP BY ALL),
  step AS (SELECT image_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM boxes)
   UNION ALL SELECT s.image_id, s.k + 1, CASE WHEN c.better IS NOT NULL AND list_has_any(s.kept, c.better) THEN s.kept ELSE list_append(s.kept, s.k + 1) END
   FROM step s JOIN r ON r.image_id = s.image_id AND r.k = s.k + 1 LEFT JOIN conflict c ON c.image_id = s.image_id AND c.k = s.k + 1),
  fin AS (SELECT image_id, unnest(kept) AS k FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1))
  SELECT r.image_id, r.box_id, r.score FROM fin JOIN r USING (image_id, k)""", True))
def mask_nms(spark, sf_dir):
    p, _, boxes = mask_inputs(spark, sf_dir)
    return B.mask_nms(p, boxes, 0.3).select("image_id", "box_id", "score")


@query("mask_average_precision", sql("boxes gt truth pred", MASK_MATCH + AP_SQL[AP_SQL.index(", lev AS"):], True))
def mask_average_precision(spark, sf_dir):
    p, g, boxes = mask_inputs(spark, sf_dir)
    cand = B.mask_candidates(p, g, boxes)
    return B.average_precision(boxes, V.truth_boxes(spark, sf_dir), cand).withColumn("ap", F.round("ap", 6))


@query("best_proposal", sql("boxes", "SELECT image_id, arg_max(box_id, struct_pack(s := score, b := -box_id)) AS box_id, max(score) AS score FROM boxes GROUP BY image_id"))
def best_proposal(spark, sf_dir):
    return R.best_proposal(V.boxes(spark, sf_dir), "box_id", "score")


# the three models of an ensemble: truth, shifted prediction, and truth one column to the right
ENSEMBLE = ("e AS (SELECT DISTINCT image_id, 0 AS m, col, unnest(range(r0, r1)) AS row FROM truth UNION ALL SELECT DISTINCT image_id, 1, col, unnest(range(r0, r1)) FROM pred "
            "UNION ALL SELECT DISTINCT image_id, 2, col + 1, unnest(range(r0, r1)) FROM truth)")


def ensemble_sql(rule: str) -> str:
    return sql("truth pred", f"WITH {ENSEMBLE}, k AS (SELECT image_id, col, row FROM e GROUP BY ALL HAVING {rule}), "
               "isl AS (SELECT image_id, col, min(row) AS r0, max(row) + 1 AS r1 FROM (SELECT *, row - row_number() OVER "
               "(PARTITION BY image_id, col ORDER BY row) AS g FROM k) GROUP BY image_id, col, g) SELECT image_id, col, r0, r1 FROM isl")


def models(spark, sf_dir):
    t, p = V.truth_segments(spark, sf_dir), V.pred_segments(spark, sf_dir)
    return (t.withColumn("m", F.lit(0)).unionByName(p.withColumn("m", F.lit(1)))
            .unionByName(t.withColumn("col", F.col("col") + 1).withColumn("m", F.lit(2))))


@query("ensemble_union", ensemble_sql("true"))
def ensemble_union(spark, sf_dir):
    return M.union(models(spark, sf_dir))


@query("ensemble_intersection", ensemble_sql("count(*) = 3"))
def ensemble_intersection(spark, sf_dir):
    return M.intersect_all(models(spark, sf_dir), "m", 3)


@query("ensemble_voting", ensemble_sql("count(*) * 2 > 3"))
def ensemble_voting(spark, sf_dir):
    return M.vote(models(spark, sf_dir), "m", 3)


HEXNUM = "(('0x' || substr({h}, 1, 13))::BIGINT)"


def point_sql(k: int, axis: str) -> str:
    return HEXNUM.replace("{h}", f"md5('7:' || image_id || ':' || box_id || ':{k}:{axis}')") + " % 768"


@query("prompts", sql("boxes tpx", f"""WITH c AS (SELECT image_id, box_id, 1 AS label, x1 + (x2 - x1) // 2 AS x, y1 + (y2 - y1) // 2 AS y FROM boxes UNION ALL
   SELECT image_id, box_id, 0, {point_sql(0, 'x')}, {point_sql(0, 'y')} FROM boxes UNION ALL
   SELECT image_id, box_id, 0, {point_sql(1, 'x')}, {point_sql(1, 'y')} FROM boxes)
  SELECT image_id, box_id, label, x, y FROM c WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM tpx t WHERE t.image_id = c.image_id AND t.col = c.x AND t.row = c.y)"""))
def prompts(spark, sf_dir):
    return R.point_prompts(V.boxes(spark, sf_dir), M.union(V.truth_segments(spark, sf_dir)), 7, (H, W), 2)


@query("prompt_padding", sql("boxes", """, g AS (SELECT image_id % 100 AS batch, image_id, list(x1 ORDER BY box_id) AS xs, count(*) AS n FROM boxes GROUP BY ALL),
   p AS (SELECT *, max(n) OVER (PARTITION BY batch) AS m FROM g)
  SELECT image_id, m::BIGINT AS padded, array_to_string(list_concat(xs, list_transform(range(m - n), lambda i: 0::BIGINT)), ' ') AS xs FROM p""".replace(", g AS", "WITH g AS", 1)))
def prompt_padding(spark, sf_dir):
    b = V.boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "x1"))).alias("b"))
    lists = b.select((F.col("image_id") % 100).alias("batch"), "image_id", F.col("b.x1").alias("xs"))
    out = R.pad_lists(lists, "batch", "xs", F.lit(0).cast("bigint"))
    return out.select("image_id", F.size("xs").cast("bigint").alias("padded"), F.array_join("xs", " ").alias("xs"))


# --- splits --------------------------------------------------------------------------------

RANK = "row_number() OVER ({p}ORDER BY md5('{s}:' || {k}), {k}) - 1"


@query("split_exact", "SELECT o_orderkey AS image_id, CASE WHEN " + RANK.format(p="", s=42, k="o_orderkey")
       + " < ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM orders")
def split_exact(spark, sf_dir):
    return P.split_exact(V.images(spark, sf_dir).select("image_id"), 0.2, 42, ["image_id"])


@query("split_stratified", sql("classifier", "SELECT doc_id, label, CASE WHEN " + RANK.format(p="PARTITION BY label ", s=42, k="doc_id")
       + " < ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM classifier"))
def split_stratified(spark, sf_dir):
    return P.split_exact(V.classifier(spark, sf_dir), 0.2, 42, ["doc_id"], ["label"]).select("doc_id", "label", "split")


@query("split_stratified_nulls", "WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_linenumber, 3) AS stratum FROM lineitem) "
       "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, stratum, CASE WHEN " + RANK.format(p="PARTITION BY stratum ", s=42, k="l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber").replace(
           ", l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber)", ", l_orderkey, l_partkey, l_suppkey, l_linenumber)")
       + " < ceil(count(*) OVER (PARTITION BY stratum) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM l")
def split_stratified_nulls(spark, sf_dir):
    """Rows without a stratum are a stratum of their own."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = V.table(spark, sf_dir, "lineitem").selectExpr(*keys, "nullif(l_linenumber, 3) as stratum")
    return P.split_exact(rows, 0.2, 42, keys, ["stratum"])


@query("split_images", sql("manifest", """, i AS (SELECT DISTINCT image_id FROM manifest), r AS (SELECT image_id, """ + RANK.format(p="", s=42, k="image_id")
       + """ AS k, count(*) OVER () AS n FROM i)
  SELECT image_id, ship_id, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM manifest JOIN r USING (image_id)""").replace(") , i AS", "), i AS"))
def split_images(spark, sf_dir):
    return P.split_images(V.manifest(spark, sf_dir), 42).select("image_id", "ship_id", "split")


@query("split_leak_check", sql("manifest", """, s AS (SELECT image_id, CASE WHEN """ + HEXNUM.replace("{h}", "md5('42:' || image_id || ':' || ship_id)")
       + """ / 4503599627370496.0::DOUBLE < 0.2 THEN 'val' ELSE 'train' END AS split FROM manifest WHERE ship_id IS NOT NULL)
  SELECT image_id FROM s WHERE split = 'val' INTERSECT SELECT image_id FROM s WHERE split = 'train'""").replace(") , s AS", "), s AS"))
def split_leak_check(spark, sf_dir):
    """Images that a row-level split puts on both sides."""
    s = P.split_threshold(V.manifest(spark, sf_dir).filter("ship_id is not null"), 0.2, 42, ["image_id", "ship_id"])
    return s.filter("split = 'val'").select("image_id").intersect(s.filter("split = 'train'").select("image_id"))


@query("sample_complement", "SELECT o_orderkey AS image_id FROM orders WHERE " + HEXNUM.replace("{h}", "md5('42:' || o_orderkey)")
       + " / 4503599627370496.0::DOUBLE >= 0.8")
def sample_complement(spark, sf_dir):
    img = V.images(spark, sf_dir).select("image_id")
    return P.complement(img, P.sample_fraction(img, 0.8, 42, ["image_id"]), ["image_id"])


@query("sample_rows", "SELECT o_orderkey AS image_id FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark, sf_dir):
    return P.sample_rows(V.images(spark, sf_dir).select("image_id"), 100, 42, ["image_id"])


def u_sql(tag: str) -> str:
    return HEXNUM.replace("{h}", f"md5('9:{tag}:' || d)") + " / 4503599627370496.0::DOUBLE"


@query("weighted_draws", sql("classifier", f"""WITH r AS (SELECT *, {RANK.format(p='PARTITION BY label ', s=9, k='doc_id')} AS k FROM classifier),
  n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM classifier),
  d AS (SELECT d, CASE WHEN {u_sql('class')} * 3.0 < 1.0 THEN 0 ELSE 1 END AS label, {u_sql('row')} AS v FROM range(5000) t(d))
  SELECT d.d AS draw, r.doc_id, r.label FROM d, n, r WHERE r.label = d.label AND r.k = floor(v * CASE WHEN d.label = 0 THEN n0 ELSE n1 END)"""))
def weighted_draws(spark, sf_dir):
    return P.weighted_draws(V.classifier(spark, sf_dir).select("doc_id", "label"), 5000, 9, ["doc_id"], pos_boost=2.0)


@query("chunk_shuffle", "SELECT o_orderkey AS image_id, o_orderkey // 1000 AS chunk, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY "
       "md5('5:' || o_orderkey), o_orderkey) - 1 AS slot FROM orders")
def chunk_shuffle(spark, sf_dir):
    return P.chunk_shuffle(V.images(spark, sf_dir).select("image_id"), 1000, 5, "image_id")


def digit(i: int) -> str:
    return f"('0x' || substr(md5('3:1:' || image_id), {i}, 1))::INT"


@query("augmented_masks", sql("images tpx", f"""WITH p AS (SELECT image_id, {digit(1)} < 8 AS hf, {digit(2)} < 8 AS vf, {digit(3)} % 4 AS t FROM images),
  f AS (SELECT image_id, t, CASE WHEN hf THEN 767 - col ELSE col END AS c, CASE WHEN vf THEN 767 - row ELSE row END AS r FROM tpx JOIN p USING (image_id)),
  k AS (SELECT image_id, CASE t WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 767 - c ELSE 767 - r END AS col,
    CASE t WHEN 0 THEN r WHEN 1 THEN 767 - c WHEN 2 THEN 767 - r ELSE c END AS row FROM f),
  isl AS (SELECT image_id, col, min(row) AS r0, max(row) + 1 AS r1 FROM (SELECT *, row - row_number() OVER
   (PARTITION BY image_id, col ORDER BY row) AS g FROM k) GROUP BY image_id, col, g) SELECT image_id, col, r0, r1 FROM isl"""))
def augmented_masks(spark, sf_dir):
    plan = P.augment_plan(V.images(spark, sf_dir), 3, 1)
    return P.augment_segments(V.truth_segments(spark, sf_dir), plan, 768)


@query("union_scans", sql("images manifest", "SELECT image_id, 'image' AS kind FROM images UNION ALL SELECT image_id, 'mask' FROM manifest"))
def union_scans(spark, sf_dir):
    a = V.images(spark, sf_dir).select("image_id", F.lit("image").alias("kind"))
    return a.unionByName(V.manifest(spark, sf_dir).select("image_id", F.lit("mask").alias("kind")))


@query("first_samples", "SELECT o_orderkey AS image_id FROM orders ORDER BY o_orderkey LIMIT 5")
def first_samples(spark, sf_dir):
    return V.images(spark, sf_dir).select("image_id").orderBy("image_id").limit(5)
