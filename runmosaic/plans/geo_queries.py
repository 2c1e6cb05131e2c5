"""Registered vector, GeoJSON and sink-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runmosaic.functions import geometry as G
from runmosaic.operators import components as K
from runmosaic.operators import geo as E
from runmosaic.operators import masks as M
from runmosaic.plans import views as V
from runmosaic.plans.registry import registry
from runmosaic.plans.shape_queries import INST, labels_sql
from runmosaic.plans.views import H, W, sql
from runmosaic.sources import manifest as N
from runmosaic.sources import sinks as O

QUERIES, ORACLE, query = registry()


def polygons(spark, sf_dir):
    """Slanted four-corner outline of each ship, closed."""
    s = V.ships(spark, sf_dir)
    p = lambda x, y: f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"
    ring = f"array({p('x1', 'y1')}, {p('x1 + w', 'y1 + w * slant')}, {p('x1 + w', 'y1 + w * slant + hgt')}, {p('x1', 'y1 + hgt')})"
    return s.selectExpr("image_id", "ship_id", f"{ring} as open_ring").select(
        "image_id", "ship_id", G.close_ring("open_ring").alias("ring"))


AREA = "(w * hgt)::DOUBLE"


@query("ring_closing", sql("ships", "SELECT image_id, ship_id, 5 AS points, true AS closed FROM ships"))
def ring_closing(spark, sf_dir):
    p = polygons(spark, sf_dir)
    return p.select("image_id", "ship_id", F.size("ring").alias("points"), (F.col("ring")[0] == F.element_at("ring", -1)).alias("closed"))


@query("polygon_measures", sql("ships", f"""SELECT image_id, ship_id, {AREA} AS area, round(2 * hgt + 2 * sqrt(w * w + w * slant * w * slant), 6) AS perimeter,
   round(x1 + w / 2.0::DOUBLE, 6) AS cx, round(y1 + (w * slant + hgt) / 2.0::DOUBLE, 6) AS cy, x1::DOUBLE AS minx, y1::DOUBLE AS miny, (x1 + w)::DOUBLE AS maxx,
   (y1 + w * slant + hgt)::DOUBLE AS maxy FROM ships"""))
def polygon_measures(spark, sf_dir):
    c, b = G.centroid("ring"), G.bounds("ring")
    return polygons(spark, sf_dir).select(
        "image_id", "ship_id", G.area("ring").alias("area"), F.round(G.perimeter("ring"), 6).alias("perimeter"), F.round(c["x"], 6).alias("cx"),
        F.round(c["y"], 6).alias("cy"), b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


@query("pixel_to_geo", sql("ships", """SELECT image_id, ship_id, 10 * (x1 + 0.5::DOUBLE) + image_id * 10000.0::DOUBLE AS gx, -10 * (y1 + 0.5::DOUBLE) + 5000000 AS gy,
   x1 + 0.5::DOUBLE AS bx, y1 + 0.5::DOUBLE AS "by" FROM ships"""))
def pixel_to_geo(spark, sf_dir):
    s = V.ships(spark, sf_dir).join(V.affine(spark, sf_dir), "image_id").withColumn("g", G.to_geo(F.col("x1"), F.col("y1")))
    s = s.withColumn("p", G.to_pixel(F.col("g.x"), F.col("g.y")))
    return s.select("image_id", "ship_id", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), F.col("p.x").alias("bx"), F.col("p.y").alias("by"))


@query("mercator", sql("ships", """, p AS (SELECT image_id, ship_id, x1 / 4.5::DOUBLE - 80 AS lon, y1 / 5.0::DOUBLE - 70 AS lat FROM ships)
  SELECT image_id, ship_id, round(radians(lon) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) AS y,
   round(lon, 6) AS lon, round(lat, 6) AS lat FROM p""".replace(", p AS", "WITH p AS", 1)))
def mercator(spark, sf_dir):
    s = V.ships(spark, sf_dir).selectExpr("image_id", "ship_id", "x1 / cast(4.5 as double) - 80 as lon", "y1 / cast(5.0 as double) - 70 as lat")
    s = s.withColumn("m", G.to_mercator(F.col("lon"), F.col("lat"))).withColumn("b", G.from_mercator(F.col("m.x"), F.col("m.y")))
    return s.select("image_id", "ship_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


@query("rasterise", sql("ships", """, px AS (SELECT image_id, ship_id, x1 + k AS col, y1, slant, hgt, k + 0.5::DOUBLE AS u FROM (SELECT *, unnest(range(w)) AS k FROM ships))
  SELECT image_id, ship_id, col, ceil(y1 + u * slant - 0.5)::BIGINT AS r0, ceil(y1 + u * slant + hgt - 0.5)::BIGINT AS r1 FROM px""".replace(", px AS", "WITH px AS", 1)))
def rasterise(spark, sf_dir):
    return E.rasterise(polygons(spark, sf_dir), H, W, "ship_id").select("image_id", "ship_id", "col", "r0", "r1")


NEAR = """, near AS (SELECT a.image_id, a.box_id AS i, b.box_id AS j FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id
   WHERE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
    >= 0.5::DOUBLE * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))"""
SEED = (NEAR + """, r AS (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS k FROM boxes),
  before AS (SELECT near.image_id, r.k, list(s.k ORDER BY s.k) AS cand FROM near JOIN r ON r.image_id = near.image_id AND r.box_id = j
    JOIN r s ON s.image_id = near.image_id AND s.box_id = i GROUP BY ALL),
  go AS (SELECT image_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS seeds, NULL::BIGINT AS own FROM (SELECT DISTINCT image_id FROM boxes)
   UNION ALL SELECT g.image_id, g.k + 1, CASE WHEN hit IS NULL THEN list_append(g.seeds, g.k + 1) ELSE g.seeds END, coalesce(hit, g.k + 1)
   FROM go g JOIN r ON r.image_id = g.image_id AND r.k = g.k + 1 LEFT JOIN before b ON b.image_id = g.image_id AND b.k = g.k + 1,
    LATERAL (SELECT list_filter(b.cand, lambda x: list_contains(g.seeds, x))[1] AS hit)),
  cl AS (SELECT r.image_id, r.box_id, s.box_id AS cluster FROM go JOIN r USING (image_id, k) JOIN r s ON s.image_id = go.image_id AND s.k = go.own)""").replace(", near", "WITH near", 1)


@query("merge_tiles_seed", sql("boxes", SEED + " SELECT image_id, box_id, cluster FROM cl", True))
def merge_tiles_seed(spark, sf_dir):
    return E.merge_clusters(V.boxes(spark, sf_dir)).select("image_id", "box_id", "cluster")


@query("merge_tiles_components", sql("boxes", (NEAR + """, e AS (SELECT image_id, i, j FROM near UNION ALL SELECT image_id, j, i FROM near),
  reach AS (SELECT image_id, box_id AS i, box_id AS j FROM boxes UNION SELECT r.image_id, r.i, e.j FROM reach r JOIN e ON e.image_id = r.image_id AND e.i = r.j)
  SELECT image_id, i AS box_id, min(j) AS cluster FROM reach GROUP BY image_id, i""").replace(", near", "WITH near", 1), True))
def merge_tiles_components(spark, sf_dir):
    return E.merge_clusters(V.boxes(spark, sf_dir), "components").select("image_id", "box_id", "cluster")


MASK_PAIRS = """ar AS (SELECT image_id, ship_id, sum(r1 - r0) AS n FROM pred GROUP BY ALL),
  ov AS (SELECT a.image_id, a.ship_id AS a, b.ship_id AS b, sum(least(a.r1, b.r1) - greatest(a.r0, b.r0)) AS o FROM pred a JOIN pred b ON a.image_id = b.image_id AND a.col = b.col
   AND a.ship_id <> b.ship_id AND a.r0 < b.r1 AND b.r0 < a.r1 GROUP BY ALL),
  mp AS (SELECT ov.image_id, a, b, o::DOUBLE / (x.n + y.n - o) AS iou, o::DOUBLE / least(x.n, y.n) AS share FROM ov JOIN ar x ON x.image_id = ov.image_id AND x.ship_id = a
   JOIN ar y ON y.image_id = ov.image_id AND y.ship_id = b)"""


def mask_features(spark, sf_dir):
    return V.pred_segments(spark, sf_dir, "ship_id").withColumnRenamed("ship_id", "box_id")


# the seed rule over pairs of shapes instead of boxes
MASK_SEED = f"WITH {MASK_PAIRS}, near AS (SELECT image_id, a AS i, b AS j FROM mp WHERE a < b AND share >= 0.5)" + SEED[SEED.index(", r AS (SELECT image_id, box_id"):]


@query("merge_tiles_masks", sql("pred boxes", MASK_SEED + " SELECT image_id, box_id, cluster FROM cl", True))
def merge_tiles_masks(spark, sf_dir):
    """Tile results merged by the overlap of their shapes."""
    return E.merge_mask_clusters(mask_features(spark, sf_dir))


@query("merged_collections", sql("images boxes", SEED + """, t AS (SELECT image_id, 'EPSG:' || (32601 + image_id % 60) AS crs FROM images)
  SELECT t.image_id, 2::BIGINT AS num_tiles_merged, count(DISTINCT cl.cluster)::BIGINT AS num_features, any_value(t.crs) AS crs FROM t LEFT JOIN cl USING (image_id) GROUP BY t.image_id""", True))
def merged_collections(spark, sf_dir):
    """Two tile collections per image; merged features, counts and the first tile's coordinate system."""
    tiles = V.images(spark, sf_dir).selectExpr("image_id", "explode(array(1, 0)) as tile").selectExpr("image_id", "tile", "concat('EPSG:', 32601 + image_id % 60 + tile) as crs")
    merged = E.dissolve(E.merge_clusters(V.boxes(spark, sf_dir))).withColumn("ring", G.box_ring())
    f = merged.select("image_id", "cluster", E.feature("ring", {"class": F.lit("ship")}, "cluster").alias("feature"))
    text = E.merged_collection(f, tiles, "cluster")
    j = lambda n: F.get_json_object("geojson", f"$.properties.{n}").cast("bigint").alias(n)
    return text.select("image_id", j("num_tiles_merged"), j("num_features"), F.get_json_object("geojson", "$.crs.properties.name").alias("crs"))


@query("merge_tiles_dissolve", sql("boxes", SEED + """, px AS (SELECT DISTINCT image_id, cluster, c, unnest(range(y1, y2)) AS r
   FROM (SELECT image_id, cluster, y1, y2, unnest(range(x1, x2)) AS c FROM cl JOIN boxes USING (image_id, box_id))),
  ar AS (SELECT image_id, cluster, count(*)::BIGINT AS area FROM px GROUP BY ALL)
  SELECT image_id, cluster, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*)::BIGINT AS members, any_value(area) AS area
  FROM cl JOIN boxes USING (image_id, box_id) JOIN ar USING (image_id, cluster) GROUP BY image_id, cluster""", True))
def merge_tiles_dissolve(spark, sf_dir):
    return E.dissolve(E.merge_clusters(V.boxes(spark, sf_dir)))


def features(spark, sf_dir):
    box = V.truth_boxes(spark, sf_dir).withColumn("ring", G.box_ring())
    return box.select("image_id", "gt_id", E.feature("ring", {"class": F.lit("ship"), "confidence": F.lit(1.0), "id": F.col("gt_id")}, "gt_id").alias("feature"))


@query("feature_properties", sql("gt", """SELECT image_id, gt_id, 'ship' AS class, 1.0::DOUBLE AS confidence, ((x2 - x1) * (y2 - y1))::DOUBLE AS area,
   (2 * (x2 - x1 + y2 - y1))::DOUBLE AS perimeter, round((x1 + x2) / 2.0::DOUBLE, 6) AS cx, round((y1 + y2) / 2.0::DOUBLE, 6) AS cy FROM gt"""))
def feature_properties(spark, sf_dir):
    p = F.col("feature.properties")
    return features(spark, sf_dir).select("image_id", "gt_id", p["class"].alias("class"), p["confidence"].alias("confidence"), p["area"].alias("area"),
                                          p["perimeter"].alias("perimeter"), F.round(p["centroid"][0], 6).alias("cx"), F.round(p["centroid"][1], 6).alias("cy"))


@query("feature_collections", sql("gt", """SELECT image_id, 'FeatureCollection' AS kind, count(*)::BIGINT AS features, sum((x2 - x1) * (y2 - y1))::DOUBLE AS total_area,
   string_agg(gt_id::VARCHAR, ' ' ORDER BY gt_id) AS ids, 'EPSG:32633' AS crs, count(*)::BIGINT AS declared FROM gt GROUP BY image_id"""))
def feature_collections(spark, sf_dir):
    """Collections written as text and read back."""
    text = E.collections(features(spark, sf_dir), "gt_id", "EPSG:32633")
    doc = text.select("image_id", "geojson", F.from_json("geojson", E.GEOJSON).alias("d"))
    j = lambda path: F.get_json_object("geojson", path)
    return doc.select("image_id", F.col("d.type").alias("kind"), F.size("d.features").cast("bigint").alias("features"),
                      j("$.properties.total_area").cast("double").alias("total_area"), F.array_join("d.features.id", " ").alias("ids"),
                      F.col("d.crs.properties.name").alias("crs"), j("$.properties.num_ships").cast("bigint").alias("declared"))


@query("collection_stats", sql("gt", "SELECT image_id, count(*)::BIGINT AS num_ships, sum((x2 - x1) * (y2 - y1))::DOUBLE AS total_area FROM gt GROUP BY image_id"))
def collection_stats(spark, sf_dir):
    return E.collection_stats(features(spark, sf_dir))


@query("geojson_rings", sql("gt", "SELECT image_id, count(*)::BIGINT AS rings, sum((x2 - x1) * (y2 - y1))::DOUBLE AS area FROM gt GROUP BY image_id"))
def geojson_rings(spark, sf_dir):
    text = E.collections(features(spark, sf_dir), "gt_id")
    f = E.parse(text, "geojson", ["image_id"])
    return f.groupBy("image_id").agg(F.count(F.lit(1)).alias("rings"), F.sum(G.area("ring")).alias("area"))


# every order is a multi-polygon: a square with a hole, and a small rectangle apart from it
SHAPE = "o_orderkey % 500 as x, o_orderkey % 400 as y, 20 + o_orderkey % 30 as s"


@query("geojson_multi_rings", f"""WITH k AS (SELECT o_orderkey AS image_id, {SHAPE} FROM orders)
  SELECT image_id, 3::BIGINT AS rings, s * s - 35 + 63 AS pixels,
   (2 * x + s - 1) * s * s // 2 - 7 * (5 * x + 5 * 5 + 10) + 9 * (7 * (x + 100) + 21) AS col_sum FROM k""")
def geojson_multi_rings(spark, sf_dir):
    k = V.spread(V.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").selectExpr("o_orderkey as image_id", *SHAPE.split(", "))
    box = lambda a, b, c, d: f"concat('[[', {a}, ',', {b}, '],[', {c}, ',', {b}, '],[', {c}, ',', {d}, '],[', {a}, ',', {d}, '],[', {a}, ',', {b}, ']]')"
    text = k.selectExpr("image_id", f"""concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"MultiPolygon","coordinates":[[',
      {box('x', 'y', 'x + s', 'y + s')}, ',', {box('x + 5', 'y + 5', 'x + 10', 'y + 12')}, '],[', {box('x + 100', 'y + 50', 'x + 107', 'y + 59')}, ']]}},"properties":{{}}}}]}}') as geojson""")
    rings = E.parse_rings(text, "geojson", ["image_id"])
    n = rings.groupBy("image_id").agg(F.count(F.lit(1)).alias("rings"))
    px = E.rasterise(rings, H, W, "idx").groupBy("image_id").agg(F.expr("cast(sum(r1 - r0) as bigint)").alias("pixels"), F.expr("cast(sum(col * (r1 - r0)) as bigint)").alias("col_sum"))
    return n.join(px, "image_id")


@query("collection_counts", sql("gt", "SELECT image_id, count(DISTINCT gt_id % 3)::BIGINT AS num_instances, count(*)::BIGINT AS num_polygons FROM gt GROUP BY image_id"))
def collection_counts(spark, sf_dir):
    """Polygons of one instance told apart from instances."""
    box = V.truth_boxes(spark, sf_dir).withColumn("ring", G.box_ring())
    f = box.select("image_id", "gt_id", E.feature("ring", {"instance_id": F.expr("gt_id % 3")}, "gt_id").alias("feature"))
    text = E.collections(f, "gt_id", instance="instance_id")
    j = lambda n: F.get_json_object("geojson", f"$.properties.{n}").cast("bigint").alias(n)
    return text.select("image_id", j("num_instances"), j("num_polygons"))


# every order becomes a small collection text, damaged in turn by rule
DAMAGED = """case o_orderkey % 8
 when 0 then '{"features":[]}' when 1 then '{"type":"Other","features":[]}' when 2 then '{"type":"FeatureCollection"}'
 when 3 then '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{}}]}'
 when 4 then '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{}}]}'
 when 5 then '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}]}'
 when 6 then '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,1],[2,2],[0,0]]]},"properties":{}}]}'
 else '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]},"properties":{}}]}' end"""


@query("geojson_validation", """SELECT o_orderkey AS image_id, unnest(CASE o_orderkey % 8 WHEN 0 THEN [-1] WHEN 1 THEN [-1] WHEN 2 THEN [-1] WHEN 3 THEN [0] WHEN 4 THEN [0] WHEN 5 THEN [0, 0] WHEN 6 THEN [0]
   ELSE []::INT[] END) AS feature, unnest(CASE o_orderkey % 8 WHEN 0 THEN ['missing type'] WHEN 1 THEN ['invalid type: Other'] WHEN 2 THEN ['missing features'] WHEN 3 THEN ['missing type']
   WHEN 4 THEN ['missing geometry'] WHEN 5 THEN ['not closed', 'missing properties'] WHEN 6 THEN ['zero area'] ELSE []::VARCHAR[] END) AS issue FROM orders""")
def geojson_validation(spark, sf_dir):
    docs = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey as image_id", DAMAGED + " as doc")
    return E.validate(docs, "doc", ["image_id"])


# --- sink shapes ---------------------------------------------------------------------------

@query("prediction_rows", sql("manifest", """SELECT image_id AS "ImageId", rle AS "EncodedPixels" FROM manifest WHERE ship_id IS NOT NULL
  UNION ALL SELECT DISTINCT image_id, '' FROM manifest WHERE ship_id IS NULL"""))
def prediction_rows(spark, sf_dir):
    det = V.manifest(spark, sf_dir).groupBy("image_id").agg(F.collect_list(F.when(F.col("ship_id").isNotNull(), F.col("rle"))).alias("rle_masks"))
    return O.prediction_rows(det)


@query("submission_rows", sql("manifest", """SELECT image_id AS "ImageId", coalesce(rle, '') AS "EncodedPixels" FROM manifest"""))
def submission_rows(spark, sf_dir):
    return O.submission_rows(V.manifest(spark, sf_dir))


@query("detections_json", sql("tpx", labels_sql("tpx", False) + INST + """, j AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY root) AS id FROM inst)
  SELECT image_id, '{"image_size":[768,768],"num_ships":' || count(*) || ',"ships":[' || string_agg('{"id":' || id || ',"bbox":[' || x || ',' || y || ',' || w || ',' || h || '],"area":' || area
   || ',"centroid":[' || (x + w // 2) || ',' || (y + h // 2) || ']}', ',' ORDER BY id) || ']}' AS detections FROM j GROUP BY image_id""", True))
def detections_json(spark, sf_dir):
    inst = K.instances(K.components(V.truth_segments(spark, sf_dir), W))
    return O.detections_json(inst, (H, W))


@query("label_lines", sql("ships", """SELECT image_id, ship_id, 4 AS points, true AS same FROM ships"""))
def label_lines(spark, sf_dir):
    """Polygons -> label text -> vertices, which must come back unchanged."""
    p = polygons(spark, sf_dir)
    back = N.label_lines(E.label_lines(p, H, W), (H, W), "line", ("image_id", "ship_id"))
    per = back.groupBy("image_id", "ship_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    j = p.join(per, ["image_id", "ship_id"])
    # dividing and multiplying back may fall one below before truncation
    near = F.expr("forall(v, q -> abs(q.x - get(ring, q.seq).x) <= 1 and abs(q.y - get(ring, q.seq).y) <= 1)")
    return j.select("image_id", "ship_id", F.size("v").alias("points"), near.alias("same"))
