"""Registered component and morphology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runmosaic.operators import components as K
from runmosaic.operators import geo as E
from runmosaic.operators import masks as M
from runmosaic.operators import metrics as S
from runmosaic.operators import morphology as O
from runmosaic.operators import rings as R
from runmosaic.plans import views as V
from runmosaic.plans.mask_queries import islands
from runmosaic.plans.registry import registry
from runmosaic.plans.views import H, PIXELS, W, sql

QUERIES, ORACLE, query = registry()


def labels_sql(px: str, strict: bool, pre: str = "WITH ") -> str:
    op = "<" if strict else "<="
    return f"""{pre}{islands(px)}, nd AS (SELECT *, row_number() OVER (ORDER BY image_id, col, r0) AS v FROM isl),
  ed AS (SELECT a.v AS u, b.v AS v FROM nd a JOIN nd b ON a.image_id = b.image_id AND b.col = a.col + 1 AND a.r0 {op} b.r1 AND b.r0 {op} a.r1),
  sym AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed),
  reach AS (SELECT v AS u, v FROM nd UNION SELECT r.u, sym.v FROM reach r JOIN sym ON sym.u = r.v),
  lab AS (SELECT a.image_id, a.col, a.r0, a.r1, x.root FROM nd a JOIN (SELECT reach.u, min(b.r0 * 768 + b.col) AS root FROM reach JOIN nd b ON b.v = reach.v
    GROUP BY reach.u) x ON x.u = a.v)"""


def truth(spark, sf_dir):
    return V.truth_segments(spark, sf_dir)


# images of different size, their ships cut off at the border
SIZED = "img AS (SELECT o_orderkey AS image_id, 200 + (o_orderkey * 37) % 700 AS height, 200 + (o_orderkey * 53) % 700 AS width FROM orders), spx AS (SELECT tpx.*, height, width FROM tpx JOIN img USING (image_id) WHERE row < height AND col < width)"
SIZED_KEYS = ("image_id", "height", "width")


def sized_truth(spark, sf_dir):
    size = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as image_id", "200 + (o_orderkey * 37) % 700 as height", "200 + (o_orderkey * 53) % 700 as width")
    cut = truth(spark, sf_dir).join(size, "image_id").filter("col < width and r0 < height")
    return cut.select(*SIZED_KEYS, "col", "r0", F.least("r1", "height").alias("r1"))


SIZED_ISL = ("isl AS (SELECT image_id, height, width, col, min(row) AS r0, max(row) + 1 AS r1 FROM (SELECT *, row - row_number() OVER (PARTITION BY image_id, col ORDER BY row) AS g FROM {src}) "
             "GROUP BY image_id, height, width, col, g)")


@query("components", sql("tpx", labels_sql("tpx", False) + " SELECT * FROM lab", True))
def components(spark, sf_dir):
    return K.components(truth(spark, sf_dir), W)


@query("components_blocks", sql("tpx", labels_sql("tpx", False) + " SELECT * FROM lab", True))
def components_blocks(spark, sf_dir):
    """Blocks narrower than most ships, so labels meet at block borders."""
    return K.components(truth(spark, sf_dir), W, block=5)


@query("components_sized", sql("tpx", f"WITH {SIZED}, {SIZED_ISL.format(src='spx')}, nd AS (SELECT *, row_number() OVER (ORDER BY image_id, col, r0) AS v FROM isl)" + """,
  ed AS (SELECT a.v AS u, b.v AS v FROM nd a JOIN nd b ON a.image_id = b.image_id AND b.col = a.col + 1 AND a.r0 <= b.r1 AND b.r0 <= a.r1),
  sym AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed),
  reach AS (SELECT v AS u, v FROM nd UNION SELECT r.u, sym.v FROM reach r JOIN sym ON sym.u = r.v)
  SELECT a.image_id, a.height, a.width, a.col, a.r0, a.r1, x.root FROM nd a JOIN (SELECT reach.u, min(b.r0 * b.width + b.col) AS root FROM reach JOIN nd b ON b.v = reach.v
    GROUP BY reach.u) x ON x.u = a.v""", True))
def components_sized(spark, sf_dir):
    """Images of different size, in blocks that ships cross on both axes."""
    return K.components(sized_truth(spark, sf_dir), "width", keys=SIZED_KEYS, block=6, place=("image_id",))


@query("components_4", sql("tpx", labels_sql("tpx", True) + " SELECT * FROM lab", True))
def components_4(spark, sf_dir):
    return K.components(truth(spark, sf_dir), W, 4)


@query("remove_small", sql("tpx", labels_sql("tpx", False) + " SELECT * FROM lab QUALIFY sum(r1 - r0) OVER (PARTITION BY image_id, root) >= 50", True))
def remove_small(spark, sf_dir):
    return K.remove_small(K.components(truth(spark, sf_dir), W), 50)


INST = """, inst AS (SELECT image_id, root, min(col) AS x, min(r0) AS y, max(col) - min(col) + 1 AS w, max(r1) - min(r0) AS h, sum(r1 - r0)::BIGINT AS area,
   sum(col * (r1 - r0)) AS sx, sum((r0 + r1 - 1) * (r1 - r0) / 2) AS sy FROM lab GROUP BY image_id, root)"""


@query("instances", sql("tpx", labels_sql("tpx", False) + INST + """ SELECT image_id, root, x, y, w, h, area, row_number() OVER (PARTITION BY image_id ORDER BY root) AS id,
   x + w // 2 AS centre_x, y + h // 2 AS centre_y, sx::DOUBLE / area AS mass_x, sy::DOUBLE / area AS mass_y FROM inst""", True))
def instances(spark, sf_dir):
    return K.instances(K.components(truth(spark, sf_dir), W))


@query("crop_boxes", sql("tpx", labels_sql("tpx", False) + INST + """ SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root) AS id, area,
   x + w // 2 AS centre_x, y + h // 2 AS centre_y, greatest(x - 10, 0) AS x1, greatest(y - 10, 0) AS y1, least(x + w + 10, 768) AS x2, least(y + h + 10, 768) AS y2 FROM inst""", True))
def crop_boxes(spark, sf_dir):
    return K.crop_boxes(K.instances(K.components(truth(spark, sf_dir), W)), 10, H, W)


CROSS = "ofs AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc))"


def dil(src: str, out: str) -> str:
    return (f"{out} AS (SELECT DISTINCT image_id, col + dc AS col, row + dr AS row FROM {src}, ofs "
            f"WHERE col + dc BETWEEN 0 AND 767 AND row + dr BETWEEN 0 AND 767)")


def ero(src: str, out: str, neutral: bool = True) -> str:
    need = "1 + (row > 0)::INT + (row < 767)::INT + (col > 0)::INT + (col < 767)::INT" if neutral else "5"
    # a pixel survives when it and all its in-image neighbours vote for it
    return (f"{out} AS (SELECT image_id, col, row FROM (SELECT image_id, col + dc AS col, row + dr AS row, count(*) AS n FROM {src}, ofs GROUP BY ALL) "
            f"WHERE n = {need} AND col BETWEEN 0 AND 767 AND row BETWEEN 0 AND 767)")


def morph_sql(steps: str, final: str) -> str:
    return sql("tpx", f"WITH {CROSS}, {steps}, {islands(final)} SELECT image_id, col, r0, r1 FROM isl")


@query("dilate", morph_sql(dil("tpx", "d"), "d"))
def dilate(spark, sf_dir):
    return O.dilate(truth(spark, sf_dir), 3, H, W)


@query("erode", morph_sql(ero("tpx", "e"), "e"))
def erode(spark, sf_dir):
    return O.erode(M.union(truth(spark, sf_dir)), 3, H, W)


@query("close", morph_sql(dil("tpx", "d") + ", " + ero("d", "e"), "e"))
def close(spark, sf_dir):
    return O.close(truth(spark, sf_dir), 3, H, W)


@query("open", morph_sql(ero("tpx", "e") + ", " + dil("e", "d"), "d"))
def open_(spark, sf_dir):
    return O.open_(M.union(truth(spark, sf_dir)), 3, H, W)


@query("mask_round_trip_sized", sql("tpx", f"WITH {SIZED}, {SIZED_ISL.format(src='spx')} SELECT image_id, height, width, col, r0, r1 FROM isl"))
def mask_round_trip_sized(spark, sf_dir):
    """Written as RLE text and read back, each image by its own height."""
    text = M.encode(sized_truth(spark, sf_dir), "height", SIZED_KEYS)
    return M.union(M.to_segments(M.decode(text, keys=SIZED_KEYS), "height", SIZED_KEYS), SIZED_KEYS)


@query("close_sized", sql("tpx", f"""WITH {SIZED}, {CROSS},
  d AS (SELECT DISTINCT image_id, height, width, col + dc AS col, row + dr AS row FROM spx, ofs WHERE col + dc >= 0 AND col + dc < width AND row + dr >= 0 AND row + dr < height),
  e AS (SELECT image_id, height, width, col, row FROM (SELECT image_id, height, width, col + dc AS col, row + dr AS row, count(*) AS n FROM d, ofs GROUP BY ALL)
   WHERE n = 1 + (row > 0)::INT + (row < height - 1)::INT + (col > 0)::INT + (col < width - 1)::INT AND col >= 0 AND col < width AND row >= 0 AND row < height),
  {SIZED_ISL.format(src='e')} SELECT image_id, height, width, col, r0, r1 FROM isl"""))
def close_sized(spark, sf_dir):
    return O.close(sized_truth(spark, sf_dir), 3, "height", "width", SIZED_KEYS)


def merged_sql(src: str, out: str) -> str:
    """Intervals of a column joined where they meet."""
    w = "PARTITION BY image_id, col ORDER BY r0, r1 ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return (f"{out} AS (SELECT image_id, col, min(r0) AS r0, max(r1) AS r1 FROM (SELECT *, sum(fresh) OVER ({w} CURRENT ROW) AS i FROM "
            f"(SELECT *, CASE WHEN r0 <= max(r1) OVER ({w} 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT image_id, col, r0, r1 FROM {src}))) GROUP BY image_id, col, i)")


def dil_runs(src: str, out: str) -> str:
    return (f"{out}g AS (SELECT image_id, col + dc AS col, greatest(r0 - hh, 0) AS r0, least(r1 + hh, 768) AS r1 FROM {src}, kn WHERE col + dc BETWEEN 0 AND 767), "
            + merged_sql(f"{out}g", out))


def ero_runs(src: str, out: str, reach: int) -> str:
    """Rows that every column of the kernel inside the image still covers."""
    return (f"{out}c AS (SELECT * FROM (SELECT image_id, col - dc AS col, CASE WHEN r0 = 0 THEN 0 ELSE r0 + hh END AS a, CASE WHEN r1 = 768 THEN 768 ELSE r1 - hh END AS b "
            f"FROM {src}, kn WHERE col - dc BETWEEN 0 AND 767) WHERE b > a), "
            f"{out}e AS (SELECT image_id, col, p, sum(d) AS d FROM (SELECT image_id, col, a AS p, 1 AS d FROM {out}c UNION ALL SELECT image_id, col, b, -1 FROM {out}c) GROUP BY ALL), "
            f"{out}s AS (SELECT image_id, col, p AS r0, lead(p) OVER w AS r1, sum(d) OVER w AS n FROM {out}e WINDOW w AS (PARTITION BY image_id, col ORDER BY p)), "
            f"{out}k AS (SELECT * FROM {out}s WHERE r1 IS NOT NULL AND n = least(col + {reach}, 767) - greatest(col - {reach}, 0) + 1), " + merged_sql(f"{out}k", out))


def kernel_sql(size: int) -> str:
    return "kn AS (SELECT * FROM (VALUES " + ", ".join(f"({dc}, {hh})" for dc, hh in O.ellipse(size)) + ") t(dc, hh))"


SMOOTH = ", ".join([islands("tpx"), kernel_sql(5), dil_runs("isl", "m1"), ero_runs("m1", "m2", 2), ero_runs("m2", "m3", 2), dil_runs("m3", "m4"),
                    dil_runs("m4", "m5"), ero_runs("m5", "m6", 2), ero_runs("m6", "m7", 2), dil_runs("m7", "m8")])


@query("smooth", sql("tpx", f"WITH {SMOOTH} SELECT image_id, col, r0, r1 FROM m8"))
def smooth(spark, sf_dir):
    return O.smooth(truth(spark, sf_dir), H, W)


BRIDGE = ", ".join([islands("tpx"), kernel_sql(11), dil_runs("isl", "m1"), ero_runs("m1", "m2", 5), "al AS (SELECT image_id, col, r0, r1 FROM isl UNION ALL SELECT * FROM m2)",
                    merged_sql("al", "m3")])


@query("bridge_gaps", sql("tpx", f"WITH {BRIDGE} SELECT image_id, col, r0, r1 FROM m3"))
def bridge_gaps(spark, sf_dir):
    return O.bridge(truth(spark, sf_dir), H, W)


@query("outline", morph_sql(ero("tpx", "e", False) + ", o AS (SELECT * FROM tpx EXCEPT SELECT image_id, col, row FROM e)", "o"))
def outline(spark, sf_dir):
    return O.boundary(truth(spark, sf_dir), H, W)


@query("boundary_iou", sql("images tpx ppx", f"""WITH {CROSS}, {ero('tpx', 'te')}, {ero('ppx', 'pe')},
  tb AS (SELECT image_id, col, row FROM tpx EXCEPT SELECT image_id, col, row FROM te), pb AS (SELECT image_id, col, row FROM ppx EXCEPT SELECT image_id, col, row FROM pe),
  n AS (SELECT image_id, count(t.row) AS nt, count(p.row) AS np, count(CASE WHEN t.row IS NOT NULL AND p.row IS NOT NULL THEN 1 END) AS nb
   FROM tb t FULL JOIN pb p USING (image_id, col, row) GROUP BY image_id)
  SELECT image_id, (coalesce(nb, 0)::DOUBLE + 1e-6::DOUBLE) / (coalesce(nb, 0)::DOUBLE + coalesce(np - nb, 0)::DOUBLE + coalesce(nt - nb, 0)::DOUBLE + 1e-6::DOUBLE) AS boundary_iou
  FROM images LEFT JOIN n USING (image_id)"""))
def boundary_iou(spark, sf_dir):
    t = O.band(truth(spark, sf_dir), H, W)
    p = O.band(V.pred_segments(spark, sf_dir), H, W)
    m = S.segmentation_metrics(V.images(spark, sf_dir), p, t, PIXELS)
    return m.select("image_id", F.col("iou").alias("boundary_iou"))


BIG = labels_sql("tpx", False) + ", big AS (SELECT image_id, col, unnest(range(r0, r1)) AS row FROM (SELECT * FROM lab QUALIFY sum(r1 - r0) OVER (PARTITION BY image_id, root) >= 10))"


@query("clean_mask", sql("tpx", BIG + f", {CROSS}, {dil('big', 'd1')}, {ero('d1', 'e1')}, {ero('e1', 'e2')}, {dil('e2', 'd2')}, "
       + islands("d2").replace("isl AS", "isl2 AS") + " SELECT image_id, col, r0, r1 FROM isl2", True))
def clean_mask(spark, sf_dir):
    return O.clean(truth(spark, sf_dir), H, W)


@query("postprocess_extent", sql("tpx", f"WITH {CROSS}, {dil('tpx', 'd1')}, {ero('d1', 'e1')}, {ero('e1', 'e2')}, {dil('e2', 'd2')}, " + labels_sql("d2", False, "") + INST
       + """, kept AS (SELECT * FROM inst WHERE area >= 50 AND area <= 50000)
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root) AS id, area, area::DOUBLE / (w * h) AS extent FROM kept""", True))
def postprocess_extent(spark, sf_dir):
    return O.extents(O.postprocess(truth(spark, sf_dir), ["close", "open"], H, W, 3, 50, 50000))


@query("final_mask_rle", sql("tpx", BIG + f", {CROSS}, {dil('big', 'd1')}, {ero('d1', 'e1')}, {ero('e1', 'e2')}, {dil('e2', 'd2')}, "
       + islands("d2").replace("isl AS", "isl2 AS") + " SELECT image_id, string_agg((col * 768 + r0 + 1)::VARCHAR || ' ' || (r1 - r0)::VARCHAR, ' ' ORDER BY col, r0) AS rle "
       "FROM isl2 GROUP BY image_id", True))
def final_mask_rle(spark, sf_dir):
    # disjoint rows, dealt out by image at once
    return M.encode(M.placed(O.clean(truth(spark, sf_dir), H, W), M.KEYS), H)


# straight border edges with the mask on the right hand; w: 0 right, 1 down, 2 left, 3 up
EDGES = """hz AS (SELECT image_id, col, row AS y, 0 AS w FROM {px} p WHERE NOT EXISTS (SELECT 1 FROM {px} q WHERE q.image_id = p.image_id AND q.col = p.col AND q.row = p.row - 1)
   UNION ALL SELECT image_id, col, row + 1, 2 FROM {px} p WHERE NOT EXISTS (SELECT 1 FROM {px} q WHERE q.image_id = p.image_id AND q.col = p.col AND q.row = p.row + 1)),
  vt AS (SELECT image_id, col AS x, row, 3 AS w FROM {px} p WHERE NOT EXISTS (SELECT 1 FROM {px} q WHERE q.image_id = p.image_id AND q.col = p.col - 1 AND q.row = p.row)
   UNION ALL SELECT image_id, col + 1, row, 1 FROM {px} p WHERE NOT EXISTS (SELECT 1 FROM {px} q WHERE q.image_id = p.image_id AND q.col = p.col + 1 AND q.row = p.row)),
  hr AS (SELECT image_id, y, w, min(col) AS a, max(col) + 1 AS b FROM (SELECT *, col - row_number() OVER (PARTITION BY image_id, y, w ORDER BY col) AS g FROM hz) GROUP BY image_id, y, w, g),
  vr AS (SELECT image_id, x, w, min(row) AS a, max(row) + 1 AS b FROM (SELECT *, row - row_number() OVER (PARTITION BY image_id, x, w ORDER BY row) AS g FROM vt) GROUP BY image_id, x, w, g),
  eg AS (SELECT image_id, w, CASE w WHEN 0 THEN a ELSE b END AS x0, y AS y0, CASE w WHEN 0 THEN b ELSE a END AS x1, y AS y1 FROM hr
   UNION ALL SELECT image_id, w, x, CASE w WHEN 1 THEN a ELSE b END, x, CASE w WHEN 1 THEN b ELSE a END FROM vr),
  ei AS (SELECT *, ((y0::BIGINT << 29) | x0) * 4 + w AS id FROM eg),
  su AS (SELECT e.image_id, e.id, e.x0, e.y0, e.x0 * e.y1 - e.x1 * e.y0 AS cr, n.id AS nxt FROM ei e JOIN ei n ON n.image_id = e.image_id AND n.x0 = e.x1 AND n.y0 = e.y1
   QUALIFY count(*) OVER (PARTITION BY e.image_id, e.id) = 1 OR n.w = (e.w + {turn}) % 4),
  wk AS (SELECT image_id, id AS s, id AS cur, 0 AS k FROM su
   UNION ALL SELECT wk.image_id, wk.s, su.nxt, wk.k + 1 FROM wk JOIN su ON su.image_id = wk.image_id AND su.id = wk.cur WHERE su.nxt > wk.s),
  -- a walk that never meets a smaller edge and comes back to its start is a ring
  en AS (SELECT wk.image_id, wk.s FROM wk JOIN su ON su.image_id = wk.image_id AND su.id = wk.cur WHERE su.nxt = wk.s),
  rg AS (SELECT wk.image_id, wk.s AS ring, sum(su.cr) AS a, count(*) AS points, sum(su.x0)::BIGINT AS sx, sum(su.y0)::BIGINT AS sy, string_agg(su.x0 || ' ' || su.y0, ',' ORDER BY wk.k) AS corners
   FROM wk JOIN en ON en.image_id = wk.image_id AND en.s = wk.s JOIN su ON su.image_id = wk.image_id AND su.id = wk.cur GROUP BY ALL)"""
RINGS_OUT = " SELECT image_id, ring, a < 0 AS hole, points::INT AS points, abs(a) / 2.0::DOUBLE AS area, corners FROM rg"
# the mask without every seventh of its pixels in both directions: holes, and corners that touch
HOLED = "hpx AS (SELECT * FROM tpx WHERE NOT (col % 4 = 1 AND row % 7 = 3) AND NOT (col % 4 = 2 AND row % 7 = 4))"


def corner_text(rings):
    text = F.array_join(F.transform(F.slice("corners", 1, F.col("points")), lambda p: F.concat_ws(" ", p["x"].cast("bigint"), p["y"].cast("bigint"))), ",")
    return rings.select("image_id", "ring", "hole", "points", "area", text.alias("corners"))


def holed(spark, sf_dir):
    """Ships with missing pixels."""
    px = M.to_pixels(M.union(truth(spark, sf_dir))).filter("not (col % 4 = 1 and row % 7 = 3) and not (col % 4 = 2 and row % 7 = 4)")
    return px.select("image_id", "col", F.col("row").alias("r0"), (F.col("row") + 1).alias("r1"))


@query("mask_rings", sql("tpx", "WITH " + EDGES.format(px="tpx", turn=1) + RINGS_OUT, True))
def mask_rings(spark, sf_dir):
    return corner_text(R.mask_rings(truth(spark, sf_dir)))


@query("mask_rings_holes", sql("tpx", f"WITH {HOLED}, " + EDGES.format(px="hpx", turn=3) + RINGS_OUT, True))
def mask_rings_holes(spark, sf_dir):
    """Borders that run through touching corners, in blocks that nearly all rings cross."""
    return corner_text(R.mask_rings(holed(spark, sf_dir), 8, block=6))


@query("mask_from_rings", sql("tpx", f"WITH {HOLED}, {islands('hpx')} SELECT image_id, col, r0, r1 FROM isl"))
def mask_from_rings(spark, sf_dir):
    """Rings drawn again give the mask they come from."""
    # rings are dealt out before they unfold into columns
    rings = M.placed(R.mask_rings(holed(spark, sf_dir)), M.KEYS)
    return M.union(E.rasterise(rings, H, W, "image_id", "corners", ()))


@query("mask_polygons", sql("tpx", f"WITH {HOLED}, " + labels_sql("hpx", False, "")
       + """ SELECT image_id, root, (sum(r1 - r0))::DOUBLE AS area FROM lab GROUP BY ALL""", True))
def mask_polygons(spark, sf_dir):
    """One polygon with holes a component; its area is that of the component's pixels."""
    lab = K.components(holed(spark, sf_dir), W)
    keys = ("image_id", "root")
    return R.polygons(R.mask_rings(lab, 8, keys)).select("image_id", "root", "area")


@query("mask_label_lines", sql("tpx", "WITH " + EDGES.format(px="tpx", turn=1) + " SELECT image_id, ring, points::INT AS points, sx, sy FROM rg WHERE a > 0", True))
def mask_label_lines(spark, sf_dir):
    """Label text of the outer rings of a mask, read again as numbers."""
    lines = E.label_lines(R.mask_rings(truth(spark, sf_dir)).filter("not hole"), H, W, "corners")
    values = F.transform(F.slice(F.split("line", " "), 2, 2 * F.col("points")), lambda t: t.cast("double"))
    total = lambda odd, size: F.expr(f"cast(round(aggregate(filter(v, (x, i) -> i % 2 = {odd}), 0.0d, (a, x) -> a + x * {size})) as bigint)")
    return lines.withColumn("v", values).select("image_id", "ring", "points", total(0, W).alias("sx"), total(1, H).alias("sy"))
