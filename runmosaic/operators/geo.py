"""Feature tables, collections, merging of tile features, validation and rasterising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmosaic.functions import expr as X
from runmosaic.functions import geometry as G
from runmosaic.operators import boxes as B
from runmosaic.operators import masks as M
from runmosaic.operators.graph import connected, greedy_drop
from runmosaic.session import written


def map_ring(ring: str, point) -> Column:
    """Apply ``point(x, y)`` to each vertex."""
    return F.transform(ring, lambda p: point(p["x"], p["y"]))


def feature(ring: str, properties: dict[str, Column], feature_id: str | None = None) -> Column:
    """GeoJSON feature struct; area, perimeter, centroid and bbox are added to the properties."""
    coords = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    c, b = G.centroid(ring), G.bounds(ring)
    props = F.struct(*[v.alias(k) for k, v in properties.items()], G.area(ring).alias("area"), G.perimeter(ring).alias("perimeter"),
                     F.array(c["x"], c["y"]).alias("centroid"), F.array(b["minx"], b["miny"], b["maxx"], b["maxy"]).alias("bbox"))
    parts = [F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"), props.alias("properties")]
    if feature_id is not None:
        parts.append(F.col(feature_id).alias("id"))
    return F.struct(*parts)


def polygon_feature(rings: str, properties: dict[str, Column], feature_id: str | None = None) -> Column:
    """GeoJSON feature struct of a polygon with holes: ``rings`` holds the outer ring, then the holes."""
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    parts = [F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
             F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")]
    if feature_id is not None:
        parts.append(F.col(feature_id).alias("id"))
    return F.struct(*parts)


def collections(features: DataFrame, order: str, crs: str | None = None, keys: Sequence[str] = M.KEYS, instance: str | None = None) -> DataFrame:
    """One FeatureCollection text per key, features in ``order``; ``instance`` names the property that tells instances apart.

    The text of one image is one value and so bounds the list that is collected.
    """
    per = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("feature")))).alias("_f"))
    feats = F.transform("_f", lambda x: x["feature"])
    total = F.aggregate(feats, F.lit(0.0), lambda acc, f: acc + f["properties"]["area"])
    counts = [F.size("_f").alias("num_ships"), total.alias("total_area")]
    if instance is not None:  # an instance may be several polygons
        counts += [F.size(F.array_distinct(F.transform(feats, lambda f: f["properties"][instance]))).alias("num_instances"), F.size("_f").alias("num_polygons")]
    parts = [F.lit("FeatureCollection").alias("type"), feats.alias("features"), F.struct(*counts).alias("properties")]
    if crs:
        parts.append(F.struct(F.lit("name").alias("type"), F.struct(F.lit(crs).alias("name")).alias("properties")).alias("crs"))
    return per.select(*keys, F.to_json(F.struct(*parts)).alias("geojson"))


def collection_stats(features: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Number of features and total area per collection."""
    a = F.col("feature")["properties"]["area"]
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_ships"), F.sum(a).alias("total_area"))


def _distinct_boxes(boxes: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """First of all copies of one rectangle; copies always end in the same cluster."""
    return boxes.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min(ident).alias(ident))


def _clusters(one: DataFrame, near: DataFrame, mode: str, ident: str, keys: Sequence[str]) -> DataFrame:
    """``one`` with the ``cluster`` of each id, from pairs ``id_a < id_b`` that belong together."""
    near = written(near, "near")  # few rows of a costly join, read by the rounds and after them
    if mode == "components":
        lab = connected(near.select(*keys, F.col("id_a").alias("u"), F.col("id_b").alias("v")), keys)
        taken = None if lab is None else lab.select(*keys, F.col("u").alias(ident), F.col("lab").alias("cluster"))
    else:
        dropped = greedy_drop(near, keys)
        taken = None
        if dropped is not None:
            seeds = near.join(dropped.withColumnRenamed("id_b", "id_a"), [*keys, "id_a"], "left_anti")
            taken = (seeds.join(dropped, [*keys, "id_b"]).groupBy(*keys, "id_b").agg(F.min("id_a").alias("cluster"))
                     .withColumnRenamed("id_b", ident))
    if taken is None:
        taken = one.select(*keys, F.col(ident), F.col(ident).alias("cluster"))
    return one.join(taken, [*keys, ident], "left").withColumn("cluster", F.coalesce("cluster", ident))


def merge_clusters(boxes: DataFrame, mode: str = "seed", ratio: float = 0.5, ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """``cluster`` per feature: features whose overlap is at least ``ratio`` of the smaller area.

    ``seed``: in id order each feature not yet taken opens a cluster and takes the later free ones
    that overlap it enough. ``components``: transitive closure of the overlap relation.
    """
    one = _distinct_boxes(boxes, ident, keys)
    pairs = B.overlapping(one, one, ident, ident, keys, sizes=boxes).filter(F.col("id_a") < F.col("id_b"))
    near = B.conflicts(pairs.filter(F.col("overlap") / F.least(X.box_area("_a"), X.box_area("_b")) >= ratio), keys)
    cluster = _clusters(one, near, mode, ident, keys).select(*keys, "x1", "y1", "x2", "y2", "cluster")
    return boxes.join(cluster, [*keys, "x1", "y1", "x2", "y2"])


def merge_mask_clusters(segments: DataFrame, mode: str = "seed", ratio: float = 0.5, ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """``ident, cluster`` of features given as segments, by the true overlap of their shapes over the smaller shape."""
    a = segments.select(*keys, F.col(ident).alias("box_id"), "col", "r0", "r1")
    both = B.mask_iou_pairs(a, None, keys).filter(F.col("pred") < F.col("gt"))
    area = M.area(segments, (*keys, ident))
    of = lambda side, name: area.select(*keys, F.col(ident).alias(name), F.col("area").alias("area" + side))
    near = both.join(of("_a", "pred"), [*keys, "pred"]).join(of("_b", "gt"), [*keys, "gt"])
    near = near.filter(F.col("overlap") / F.least("area_a", "area_b") >= ratio).select(
        *keys, F.col("pred").alias("id_a"), F.col("gt").alias("id_b"), B.block_of("x_p", "y_p").alias("blk_a"), B.block_of("x_g", "y_g").alias("blk_b"))
    return _clusters(segments.select(*keys, ident).distinct(), near, mode, ident, keys)


def merged_collection(features: DataFrame, tiles: DataFrame, order: str, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """One collection text per key from merged features; ``tiles`` (``tile, crs``) lists the collections they come from.

    The coordinate system is that of the first tile; a key whose tiles hold no feature gets an empty collection.
    """
    head = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min_by("crs", "tile").alias("_crs"))
    per = features.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("feature")))).alias("_f"))
    kind = dict(features.select("feature").dtypes)["feature"]
    feats = F.coalesce(F.transform("_f", lambda x: x["feature"]), F.array().cast(f"array<{kind}>"))
    crs = F.when(F.col("_crs").isNotNull(), F.struct(F.lit("name").alias("type"), F.struct(F.col("_crs").alias("name")).alias("properties")))
    doc = F.struct(F.lit("FeatureCollection").alias("type"), feats.alias("features"),
                   F.struct(F.col("_n").alias("num_tiles_merged"), F.size(feats).alias("num_features")).alias("properties"), crs.alias("crs"))
    return head.join(per, list(keys), "left").select(*keys, F.to_json(doc).alias("geojson"))


def dissolve(clustered: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Merged mask area and box per cluster."""
    segs = clustered.select(*keys, "cluster", F.explode(F.expr("sequence(x1, x2 - 1)")).alias("col"), F.col("y1").alias("r0"), F.col("y2").alias("r1"))
    area = M.area(segs, (*keys, "cluster"))
    box = clustered.groupBy(*keys, "cluster").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"),
                                                  F.max("y2").alias("y2"), F.count(F.lit(1)).alias("members"))
    return box.join(area, [*keys, "cluster"])


def rasterise(polygons: DataFrame, h: int | str, w: int | str, ident: str, ring: str = "ring", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Segments of the pixels whose centre lies in the polygon (even-odd rule). Rows of one ``ident`` are rings of
    one shape, so holes and separate parts come out right.

    Edges are spread over the columns whose centre line they cross; the crossings of one polygon and
    column are as few as the polygon's edges.
    """
    edge = polygons.select(*keys, ident, F.explode(F.expr(
        f"transform(slice({ring}, 1, size({ring}) - 1), (p, i) -> named_struct('p', p, 'q', get({ring}, i + 1)))")).alias("e"))
    edge = edge.select(*keys, ident, F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("xe"), F.col("e.q.y").alias("ye"))
    span = edge.withColumn("c0", F.greatest(F.ceil(F.least("x0", "xe") - 0.5), F.lit(0))) \
               .withColumn("c1", F.least(F.ceil(F.greatest("x0", "xe") - 0.5), M.dim(w)) - 1).filter("c1 >= c0")
    cross = span.select(*keys, ident, F.explode(F.expr("sequence(c0, c1)")).alias("col"), "x0", "y0", "xe", "ye")
    y = F.col("y0") + (F.col("col") + 0.5 - F.col("x0")) * (F.col("ye") - F.col("y0")) / (F.col("xe") - F.col("x0"))
    hits = cross.groupBy(*keys, ident, "col").agg(F.sort_array(F.collect_list(y)).alias("ys"))
    pairs = hits.select(*keys, ident, "col", F.explode(F.expr("transform(sequence(0, size(ys) div 2 - 1), i -> struct(get(ys, 2*i) as a, get(ys, 2*i + 1) as b))")).alias("p"))
    segs = pairs.select(*keys, ident, "col", F.greatest(F.ceil(F.col("p.a") - 0.5), F.lit(0)).alias("r0"),
                        F.least(F.ceil(F.col("p.b") - 0.5), M.dim(h)).alias("r1"))
    return segs.filter("r1 > r0")


GEOJSON = ("type string, features array<struct<type string, geometry struct<type string, coordinates array<array<array<double>>>>, "
           "properties map<string,string>, id bigint>>, crs struct<type string, properties struct<name string>>")


def parse(collections: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per feature with its outer ring."""
    doc = collections.select(*keys, F.from_json(F.col(text), GEOJSON).alias("d"))
    f = doc.select(*keys, F.posexplode("d.features").alias("idx", "f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return f.select(*keys, "idx", ring.alias("ring"), F.col("f.properties").alias("properties"))


ANY_GEOMETRY = ("features array<struct<geometry struct<type string, coordinates string>, properties map<string,string>>>")
POLYGON = "array<array<array<double>>>"


def parse_rings(collections: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per ring of each feature, ``idx, part, ring_no``: polygons and multi-polygons, outer rings and holes.

    Rings of one feature together, even-odd, are its area: :func:`rasterise` takes them under one id.
    """
    f = collections.select(*keys, F.from_json(F.col(text), ANY_GEOMETRY).alias("d")).select(*keys, F.posexplode("d.features").alias("idx", "f"))
    return _rings(f, [*keys, "idx"])


FEATURE = "geometry struct<type string, coordinates string>, properties map<string,string>"


def ring_rows(features: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """:func:`parse_rings` for rows that hold the text of one feature each."""
    return _rings(features.select(*keys, F.from_json(F.col(text), FEATURE).alias("f")), keys)


def _rings(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(c, f"array<{POLYGON}>")).when(
        F.col("f.geometry.type") == "Polygon", F.array(F.from_json(c, POLYGON)))
    rings = f.select(*keys, F.col("f.properties").alias("properties"), F.posexplode(parts).alias("part", "_p")).select(
        *keys, "properties", "part", F.posexplode("_p").alias("ring_no", "_r"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return rings.select(*keys, "part", "ring_no", F.transform("_r", point).alias("ring"), "properties")


def validate(collections: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Problems of each collection text, one row each; a sound text gives none."""
    j = lambda path: F.get_json_object(F.col(text), path)
    doc = collections.select(*keys, F.col(text).alias("_t"), F.from_json(F.col(text), GEOJSON).alias("d"), j("$.type").alias("_type"),
                             j("$.features").alias("_features"),
                             F.from_json(j("$.features"), "array<struct<type string, geometry string, properties string>>").alias("_raw"))
    top = doc.select(*keys, F.lit(-1).alias("feature"), F.explode(F.filter(F.array(
        F.when(F.col("_type").isNull(), "missing type").when(F.col("_type") != "FeatureCollection", F.concat(F.lit("invalid type: "), "_type")),
        F.when(F.col("_features").isNull(), "missing features")), lambda x: x.isNotNull())).alias("issue"))
    f = doc.select(*keys, F.posexplode("_raw").alias("feature", "r"), "d").withColumn(
        "ring", F.expr("transform(get(get(d.features, feature).geometry.coordinates, 0), p -> struct(get(p, 0) as x, get(p, 1) as y))"))
    part = f.select(*keys, "feature", F.explode(F.filter(F.array(
        F.when(F.col("r.type").isNull(), "missing type").when(F.col("r.type") != "Feature", "invalid type"),
        F.when(F.col("r.geometry").isNull(), "missing geometry").when(F.col("ring").isNull(), "geometry error").otherwise(G.ring_issue("ring")),
        F.when(F.col("r.properties").isNull(), "missing properties")), lambda x: x.isNotNull())).alias("issue"))
    return top.unionByName(part)


def label_lines(polygons: DataFrame, h: int | str, w: int | str, ring: str = "ring") -> DataFrame:
    """Label text ``0 x1 y1 ...`` with coordinates over width and height (numbers, or names of columns); the closing point is left
    out and polygons under three points are dropped."""
    open_ring = F.expr(f"case when size({ring}) > 1 and get({ring}, 0) = get({ring}, size({ring}) - 1) then slice({ring}, 1, size({ring}) - 1) else {ring} end")
    df = polygons.select("*", X.once(F.when(F.size(open_ring) >= 3, open_ring)).alias("_r")).filter("_r is not null")
    nums = F.flatten(F.transform("_r", lambda p: F.array((p["x"] / M.dim(w)).cast("string"), (p["y"] / M.dim(h)).cast("string"))))
    return df.select("*", X.once(F.concat(F.lit("0 "), F.array_join(nums, " "))).alias("line")).drop("_r")
