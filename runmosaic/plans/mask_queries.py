"""Registered mask and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runmosaic.operators import masks as M
from runmosaic.operators import tiles as T
from runmosaic.plans import views as V
from runmosaic.plans.registry import registry
from runmosaic.plans.views import H, PIXELS, W, sql

QUERIES, ORACLE, query = registry()


def decoded(spark, sf_dir, *keys):
    runs = M.decode(V.manifest(spark, sf_dir), keys=("image_id", *keys), pixels=PIXELS)
    return M.to_segments(runs, H, ("image_id", *keys))


# gaps-and-islands over pixels, used as the SQL side of interval results
def islands(src: str) -> str:
    return (f"isl AS (SELECT image_id, col, min(row) AS r0, max(row) + 1 AS r1 FROM (SELECT *, row - row_number() "
            f"OVER (PARTITION BY image_id, col ORDER BY row) AS g FROM {src}) GROUP BY image_id, col, g)")


LABEL_SQL = """
SELECT image_id, row, col, ship_pixels, ship_pixels / 50176.0::DOUBLE AS ship_pixel_ratio,
       (ship_pixels > 50176 * 0.01)::INT AS has_ship
FROM (SELECT t.image_id, t.row, t.col, count(p.row)::BIGINT AS ship_pixels FROM tiles t
      LEFT JOIN tpx p ON p.image_id = t.image_id AND p.row >= t.row AND p.row < t.row + 224
           AND p.col >= t.col AND p.col < t.col + 224 GROUP BY ALL)"""


@query("tile_labels", sql("tiles tpx", LABEL_SQL))
def tile_labels(spark, sf_dir):
    return T.label_grid(V.images(spark, sf_dir), decoded(spark, sf_dir))


SIZED_LABELS = """WITH {sizes}, ships AS ({ships}), n AS (SELECT i FROM range(8) t(i)),
 r AS (SELECT image_id, i * 192 AS row FROM images, n WHERE i * 192 + 224 <= height{rows}),
 c AS (SELECT image_id, i * 192 AS col FROM images, n WHERE i * 192 + 224 <= width{cols}),
 t AS (SELECT image_id, row, col FROM r JOIN c USING (image_id)),
 px AS (SELECT DISTINCT image_id, x1 + k AS col, unnest(range(y1 + k * slant, y1 + k * slant + hgt)) AS row FROM (SELECT *, unnest(range(w)) AS k FROM ships))
 SELECT image_id, row, col, ship_pixels, ship_pixels / 50176.0::DOUBLE AS ship_pixel_ratio, (ship_pixels > 50176 * 0.01)::INT AS has_ship
 FROM (SELECT t.image_id, t.row, t.col, count(p.row)::BIGINT AS ship_pixels FROM t LEFT JOIN px p ON p.image_id = t.image_id
  AND p.row >= t.row AND p.row < t.row + 224 AND p.col >= t.col AND p.col < t.col + 224 GROUP BY ALL)"""
BORDER = {"none": "", "reference": " UNION SELECT image_id, {n} - 224 FROM images WHERE {n} % 192 <> 0 AND {n} > 224", "cover": " UNION SELECT image_id, {n} - 224 FROM images WHERE {n} >= 224"}


def sized_labels_sql(edge: str) -> str:
    return SIZED_LABELS.format(sizes=SIZES, ships="SELECT " + ", ".join(f"{v} AS {k}" for k, v in V.SHIP_COLUMNS.items()) + " FROM lineitem",
                               rows=BORDER[edge].format(n="height"), cols=BORDER[edge].format(n="width"))


# image sizes that differ per row, for the edge rules
SIZES = "images AS (SELECT o_orderkey AS image_id, 200 + (o_orderkey * 37) % 700 AS height, 200 + (o_orderkey * 53) % 700 AS width FROM orders)"


def sized_images(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as image_id", "200 + (o_orderkey * 37) % 700 as height", "200 + (o_orderkey * 53) % 700 as width")


def sized_labels(edge: str):
    return lambda spark, sf_dir: T.label_grid(sized_images(spark, sf_dir), V.truth_segments(spark, sf_dir), edge=edge)


for _edge in T.EDGES:
    query(f"tile_labels_sized_{_edge}", sized_labels_sql(_edge))(sized_labels(_edge))


@query("tile_table_labels_sized", sized_labels_sql("reference"))
def tile_table_labels_sized(spark, sf_dir):
    """The tile table lists some tiles twice; both copies get the label of one."""
    ships = V.truth_segments(spark, sf_dir)  # first, since images take as many parts as they have
    tiles = T.grid(V.spread(sized_images(spark, sf_dir), "image_id"), edge="reference")
    return T.label_tiles(tiles, ships, 224).select(
        "image_id", "row", "col", "ship_pixels", "ship_pixel_ratio", "has_ship").distinct()


@query("tile_table_labels", sql("tiles tpx", LABEL_SQL))
def tile_table_labels(spark, sf_dir):
    ships = decoded(spark, sf_dir)
    tiles = T.grid(V.spread(V.images(spark, sf_dir), "image_id"), edge="none")
    return T.label_tiles(tiles, ships, 224).select(
        "image_id", "row", "col", "ship_pixels", "ship_pixel_ratio", "has_ship")


@query("mask_decode", sql("truth", "SELECT image_id, ship_id, col * 768 + r0 AS s, col * 768 + r1 AS e FROM truth"))
def mask_decode(spark, sf_dir):
    return M.decode(V.manifest(spark, sf_dir), keys=("image_id", "ship_id"), pixels=PIXELS)


@query("mask_union", sql("tpx", "WITH " + islands("tpx") + " SELECT image_id, col, r0, r1 FROM isl"))
def mask_union(spark, sf_dir):
    return M.union(decoded(spark, sf_dir))


@query("mask_encode", sql("tpx", "WITH " + islands("tpx") + " SELECT image_id, string_agg((col * 768 + r0 + 1)::VARCHAR "
                          "|| ' ' || (r1 - r0)::VARCHAR, ' ' ORDER BY col, r0) AS rle FROM isl GROUP BY image_id"))
def mask_encode(spark, sf_dir):
    return M.encode(decoded(spark, sf_dir), H)


@query("mask_round_trip", sql("manifest", "SELECT image_id, ship_id, rle FROM manifest WHERE ship_id IS NOT NULL"))
def mask_round_trip(spark, sf_dir):
    keys = ("image_id", "ship_id")
    return M.encode(decoded(spark, sf_dir, "ship_id"), H, keys)


def _set_sql(kind: str) -> str:
    return sql("tpx ppx", f"WITH both_px AS ({kind}), " + islands("both_px") + " SELECT image_id, col, r0, r1 FROM isl")


@query("mask_intersect", _set_sql("SELECT image_id, col, row FROM ppx INTERSECT SELECT image_id, col, row FROM tpx"))
def mask_intersect(spark, sf_dir):
    return M.combine(V.pred_segments(spark, sf_dir), V.truth_segments(spark, sf_dir), "intersect")


@query("mask_difference", _set_sql("SELECT image_id, col, row FROM ppx EXCEPT SELECT image_id, col, row FROM tpx"))
def mask_difference(spark, sf_dir):
    return M.combine(V.pred_segments(spark, sf_dir), V.truth_segments(spark, sf_dir), "difference")


@query("mask_xor", _set_sql("(SELECT image_id, col, row FROM ppx EXCEPT SELECT image_id, col, row FROM tpx) UNION "
                            "(SELECT image_id, col, row FROM tpx EXCEPT SELECT image_id, col, row FROM ppx)"))
def mask_xor(spark, sf_dir):
    return M.combine(V.pred_segments(spark, sf_dir), V.truth_segments(spark, sf_dir), "xor")


@query("mask_area", sql("tpx", "SELECT image_id, count(*)::BIGINT AS area FROM tpx GROUP BY image_id"))
def mask_area(spark, sf_dir):
    return M.area(decoded(spark, sf_dir)).withColumn("area", F.col("area").cast("bigint"))


@query("mask_crop", sql("tpx tiles", """
  WITH cropped AS (SELECT t.image_id, t.row AS tile_row, t.col AS tile_col, p.row - t.row AS row, p.col - t.col AS col
    FROM tiles t JOIN tpx p ON p.image_id = t.image_id AND p.row >= t.row AND p.row < t.row + 224
         AND p.col >= t.col AND p.col < t.col + 224)
  SELECT image_id, tile_row, tile_col, col, min(row) AS r0, max(row) + 1 AS r1 FROM (SELECT *, row - row_number() OVER
    (PARTITION BY image_id, tile_row, tile_col, col ORDER BY row) AS g FROM cropped)
  GROUP BY image_id, tile_row, tile_col, col, g"""))
def mask_crop(spark, sf_dir):
    tiles = T.grid(V.images(spark, sf_dir), edge="none")
    return M.crop(M.union(decoded(spark, sf_dir)), tiles)


@query("mask_segments", sql("truth", "SELECT image_id, ship_id, col, r0, r1 FROM truth"))
def mask_segments(spark, sf_dir):
    return decoded(spark, sf_dir, "ship_id")


@query("mask_pixels", sql("tpx", "SELECT image_id, row, count(*)::BIGINT AS n, sum(col)::BIGINT AS cols FROM tpx GROUP BY image_id, row"))
def mask_pixels(spark, sf_dir):
    px = M.to_pixels(M.union(decoded(spark, sf_dir), place=True))
    return px.groupBy("image_id", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("col").alias("cols"))


@query("mask_bbox", sql("truth", "SELECT image_id, ship_id, min(col) AS x, min(r0) AS y, max(col) - min(col) + 1 AS w, "
                        "max(r1) - min(r0) AS h FROM truth GROUP BY image_id, ship_id"))
def mask_bbox(spark, sf_dir):
    return M.bbox(decoded(spark, sf_dir, "ship_id"), ("image_id", "ship_id"))


@query("mask_resize", sql("tpx", "WITH idx AS (SELECT i AS d, (i * 768) // 512 AS s FROM range(512) t(i)), "
       "small AS (SELECT image_id, a.d AS row, b.d AS col FROM tpx JOIN idx a ON a.s = tpx.row JOIN idx b ON b.s = tpx.col), "
       + islands("small") + " SELECT image_id, col, r0, r1 FROM isl"))
def mask_resize(spark, sf_dir):
    return M.resize_nearest(V.truth_segments(spark, sf_dir), (H, W), (512, 512))


@query("mask_stack", sql("tpx ppx", "WITH u AS (SELECT * FROM tpx UNION SELECT * FROM ppx), " + islands("u")
                         + " SELECT image_id, col, r0, r1 FROM isl"))
def mask_stack(spark, sf_dir):
    return M.stack(V.truth_segments(spark, sf_dir), V.pred_segments(spark, sf_dir))


@query("mask_load_origin", sql("images ships", """
  SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM ships WHERE py = 60) THEN 'file'
    WHEN image_id IN (SELECT image_id FROM ships) THEN 'rle' ELSE 'none' END AS origin FROM images"""))
def mask_load_origin(spark, sf_dir):
    files = V.pred_segments(spark, sf_dir, "py").filter("py = 60")
    return M.load_mask(V.images(spark, sf_dir), files, V.truth_segments(spark, sf_dir))[0]


@query("mask_load", sql("pred truth ships", "WITH f AS (SELECT DISTINCT image_id FROM ships WHERE py = 60), "
       "src AS (SELECT p.image_id, p.col, p.r0, p.r1 FROM pred p JOIN ships s USING (image_id, ship_id) WHERE s.py = 60 "
       "UNION ALL SELECT image_id, col, r0, r1 FROM truth WHERE image_id NOT IN (SELECT image_id FROM f)), "
       "px AS (SELECT DISTINCT image_id, col, unnest(range(r0, r1)) AS row FROM src), " + islands("px")
       + " SELECT image_id, col, r0, r1 FROM isl WHERE image_id IN (SELECT o_orderkey FROM orders)"))
def mask_load(spark, sf_dir):
    files = V.pred_segments(spark, sf_dir, "py").filter("py = 60")
    return M.load_mask(V.images(spark, sf_dir), files, V.truth_segments(spark, sf_dir))[1]


@query("mask_alignment", sql("images truth", """
  SELECT image_id, height, width, 768 - image_id % 3 AS mask_height, width AS mask_width, max_end,
    image_id % 3 <> 0 AS size_mismatch, coalesce(max_end > height * width, false) AS runs_outside
  FROM (SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 400 ELSE 768 END AS height, width FROM images) i
  LEFT JOIN (SELECT image_id, max(col * 768 + r1) AS max_end FROM truth GROUP BY image_id) USING (image_id)
  WHERE height <> 768 - image_id % 3 OR coalesce(max_end > height * width, false)""").replace(
      "image_id % 3 <> 0 AS size_mismatch", "height <> 768 - image_id % 3 AS size_mismatch"))
def mask_alignment(spark, sf_dir):
    img = V.images(spark, sf_dir)
    shown = img.withColumn("height", F.expr("case when image_id % 5 = 0 then 400L else 768L end"))
    sizes = img.withColumn("height", F.expr("768 - image_id % 3"))
    return M.alignment_report(shown, sizes, M.decode(V.manifest(spark, sf_dir)))


# every row is tested; the texts are damaged by rule so that each problem occurs
BROKEN_RLE = """case l_linenumber when 1 then concat(s, ' ', n, ' 7') when 2 then concat(s, ' 0') when 3 then
  concat(s + 900, ' ', n, ' ', s, ' ', n) when 4 then concat(s, ' ', n + 5, ' ', s + 2, ' ', n) when 5 then
  concat(s, ' ', 589824) when 6 then concat(s, ' x', n) else concat(s, ' ', n) end"""


@query("rle_issues", """WITH r AS (SELECT l_orderkey AS image_id, l_partkey, l_suppkey, l_linenumber AS k, l_partkey * 7 + 1 AS s,
    l_quantity::BIGINT AS n FROM lineitem)
  SELECT image_id, l_partkey, l_suppkey, issue FROM (
    SELECT *, unnest(CASE k WHEN 1 THEN ['odd_tokens'] WHEN 2 THEN ['not_positive'] WHEN 3 THEN ['unsorted']
      WHEN 4 THEN ['overlap'] WHEN 5 THEN CASE WHEN s > 1 THEN ['out_of_range'] ELSE []::VARCHAR[] END WHEN 6 THEN ['not_a_number']
      ELSE []::VARCHAR[] END) AS issue FROM r)""")
def rle_issues(spark, sf_dir):
    bad = (V.table(spark, sf_dir, "lineitem")
           .selectExpr("l_orderkey as image_id", "l_partkey", "l_suppkey", "l_linenumber", "l_partkey * 7 + 1 as s",
                       "cast(l_quantity as bigint) as n")
           .selectExpr("image_id", "l_partkey", "l_suppkey", BROKEN_RLE + " as rle"))
    return M.rle_issues(bad, PIXELS, keys=("image_id", "l_partkey", "l_suppkey"))


# --- tiles ---------------------------------------------------------------------------------

@query("tile_grid", sql("images", "SELECT image_id, r * 192 AS row, c * 192 AS col FROM images, range(3) a(r), range(3) b(c)"))
def tile_grid(spark, sf_dir):
    return T.grid(V.images(spark, sf_dir), 224, 32, "none").select("image_id", "row", "col")


EDGE_SQL = f"""WITH {SIZES}, n AS (SELECT i FROM range(8) t(i)),
 r AS (SELECT image_id, i * 192 AS row FROM images, n WHERE i * 192 + 224 <= height),
 c AS (SELECT image_id, i * 192 AS col FROM images, n WHERE i * 192 + 224 <= width)"""


@query("tile_grid_reference_edge", EDGE_SQL + """,
 t AS (SELECT image_id, 0 AS pass, row, col FROM r JOIN c USING (image_id)
  UNION ALL SELECT image_id, 1, row, width - 224 FROM r JOIN images USING (image_id) WHERE width % 192 <> 0 AND width > 224
  UNION ALL SELECT image_id, 2, height - 224, col FROM c JOIN images USING (image_id) WHERE height % 192 <> 0 AND height > 224
  UNION ALL SELECT image_id, 3, height - 224, width - 224 FROM images
    WHERE width % 192 <> 0 AND width > 224 AND height % 192 <> 0 AND height > 224)
 SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pass, row, col) - 1 AS patch_id FROM t""")
def tile_grid_reference_edge(spark, sf_dir):
    return T.number_tiles(T.grid(sized_images(spark, sf_dir), 224, 32, "reference")).select(
        "image_id", "pass", "row", "col", "patch_id")


@query("tile_grid_cover", EDGE_SQL + """,
 r2 AS (SELECT * FROM r UNION SELECT image_id, height - 224 FROM images WHERE height >= 224),
 c2 AS (SELECT * FROM c UNION SELECT image_id, width - 224 FROM images WHERE width >= 224)
 SELECT image_id, row, col FROM r2 JOIN c2 USING (image_id)""")
def tile_grid_cover(spark, sf_dir):
    return T.grid(sized_images(spark, sf_dir), 224, 32, "cover").select("image_id", "row", "col")


# uniform-tile filter: the spread of a tile stands in a score column, ids count kept tiles only
@query("tile_numbering", sql("scores", "SELECT image_id, row, col, row_number() OVER (PARTITION BY image_id ORDER BY row, col) - 1 "
                             "AS patch_id FROM scores WHERE confidence >= 0.25"))
def tile_numbering(spark, sf_dir):
    kept = V.patch_scores(spark, sf_dir).filter("confidence >= 0.25").withColumn("pass", F.lit(0))
    return T.number_tiles(kept).select("image_id", "row", "col", "patch_id")


@query("tile_bounds", sql("tiles", """SELECT image_id, row, col, 10.0 * col + image_id * 10000.0 AS minx,
  5000000.0 - 10.0 * (row + 224) AS miny, 10.0 * (col + 224) + image_id * 10000.0 AS maxx, 5000000.0 - 10.0 * row AS maxy,
  10.0 * col + image_id * 10000.0 AS origin_x, 5000000.0 - 10.0 * row AS origin_y FROM tiles""").replace("10.0", "10.0::DOUBLE")
  .replace("10000.0", "10000.0::DOUBLE").replace("5000000.0", "5000000.0::DOUBLE"))
def tile_bounds(spark, sf_dir):
    return T.tile_bounds(T.grid(V.images(spark, sf_dir), edge="none"), V.affine(spark, sf_dir))


@query("tile_mask_paths", sql("tiles tpx", f"""WITH lab AS ({LABEL_SQL}), num AS (SELECT *, row_number() OVER
   (PARTITION BY image_id ORDER BY row, col) - 1 AS patch_id FROM lab)
  SELECT image_id, patch_id, 'tiles/' || image_id || '_patch_' || lpad(patch_id::VARCHAR, 6, '0') || '.tif' AS patch_path,
   CASE WHEN has_ship = 1 THEN 'tiles/' || image_id || '_patch_' || lpad(patch_id::VARCHAR, 6, '0') || '_mask.png' END AS mask_path
  FROM num"""))
def tile_mask_paths(spark, sf_dir):
    lab = T.label_grid(V.images(spark, sf_dir), V.truth_segments(spark, sf_dir)).withColumn("pass", F.lit(0))
    named = T.number_tiles(lab).withColumn("patch_path", T.patch_path("image_id", "patch_id", "tiles"))
    return named.select("image_id", "patch_id", "patch_path", T.mask_path().alias("mask_path"))


@query("sliding_windows", sql("images", """SELECT image_id, count(*)::BIGINT AS windows,
   max(((image_id * 17 + r * 576 + c * 960) % 100) / 100.0::DOUBLE) AS max_score,
   round(avg(((image_id * 17 + r * 576 + c * 960) % 100) / 100.0::DOUBLE), 9) AS mean_score
  FROM images, range(3) a(r), range(3) b(c) GROUP BY image_id"""))
def sliding_windows(spark, sf_dir):
    scored = V.patch_scores(spark, sf_dir, 384, 192)
    return T.ensemble_scores(scored, "confidence").withColumn("mean_score", F.round("mean_score", 9))


# the pairs of the one 3 x 3 grid, listed once and attached to every image
@query("tile_overlaps", sql("images", """WITH g AS (SELECT r * 192 AS row, c * 192 AS col FROM range(3) a(r), range(3) b(c)),
  p AS (SELECT a.row AS row_1, a.col AS col_1, b.row AS row_2, b.col AS col_2, greatest(a.row, b.row) AS row_start,
   least(a.row, b.row) + 224 AS row_end, greatest(a.col, b.col) AS col_start, least(a.col, b.col) + 224 AS col_end
   FROM g a, g b WHERE (a.row < b.row OR (a.row = b.row AND a.col < b.col)) AND abs(a.row - b.row) < 224 AND abs(a.col - b.col) < 224)
  SELECT image_id, p.* FROM images, p"""))
def tile_overlaps(spark, sf_dir):
    return T.overlapping_pairs(T.grid(V.images(spark, sf_dir), edge="none"))


@query("tile_coverage", EDGE_SQL + """,
 rr AS (SELECT image_id, max(row) + 224 AS hh FROM r GROUP BY image_id), cc AS (SELECT image_id, max(col) + 224 AS ww FROM c GROUP BY image_id)
 SELECT image_id, coalesce(hh * ww, 0) AS covered, height * width - coalesce(hh * ww, 0) AS uncovered,
  coalesce(hh * ww, 0)::DOUBLE / (height * width) AS coverage FROM images LEFT JOIN rr USING (image_id) LEFT JOIN cc USING (image_id)""")
def tile_coverage(spark, sf_dir):
    img = sized_images(spark, sf_dir)
    return T.coverage(img, T.grid(img, 224, 32, "none"))


@query("tile_seams", sql("images", """, band AS (SELECT r, c FROM range(768) a(r), range(768) b(c) WHERE
   (r < 608 AND c < 608 AND ((c >= 189 AND c < 195) OR (c >= 381 AND c < 387) OR (r >= 189 AND r < 195) OR (r >= 381 AND r < 387))))
  SELECT image_id, count(*)::BIGINT AS seam_pixels, sum(r)::BIGINT AS row_sum, sum(c)::BIGINT AS col_sum FROM images, band GROUP BY image_id
  """).replace(") , band", "), band"))
def tile_seams(spark, sf_dir):
    seam = T.seam_bands(T.grid(V.spread(V.images(spark, sf_dir), "image_id"), edge="none"), H, W)
    return seam.groupBy("image_id").agg(
        F.expr("sum((r1 - r0) * (c1 - c0))").alias("seam_pixels"),
        F.expr("sum(((r0 + r1 - 1) * (r1 - r0) div 2) * (c1 - c0))").alias("row_sum"),
        F.expr("sum(((c0 + c1 - 1) * (c1 - c0) div 2) * (r1 - r0))").alias("col_sum"))
