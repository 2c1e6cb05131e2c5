"""Mask-shaped views over the benchmark tables, once for Spark and once as DuckDB CTE text.

Every row of ``lineitem`` is one ship of image ``l_orderkey``: a slanted bar whose place, size
and score come from integer arithmetic on the row. Every row of ``orders`` is one image, so
images without ships exist. All images are 768 x 768.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmosaic.session import image_parts

H = W = 768
PIXELS = H * W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out by their image before they unfold into many times their bytes, so that steps within an image need no other shuffle.

    The number is stated: else adaptive execution joins the partitions again, since narrow rows look small.
    """
    return df.repartition(image_parts(df), *keys)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(H).cast("bigint").alias("height"),
        F.lit(W).cast("bigint").alias("width"))


SHIP_COLUMNS = {
    "image_id": "l_orderkey",
    "ship_id": "(l_partkey * 10000000 + l_suppkey) * 10 + l_linenumber",
    "x1": "(l_orderkey * 7919) % 600 + (l_partkey * 13 + l_linenumber * 17) % 64",
    "y1": "(l_orderkey * 104729) % 540 + (l_suppkey * 29 + l_partkey * 7) % 64",
    "w": "1 + l_partkey % 8",
    "hgt": "cast(l_quantity as bigint)",
    "slant": "cast(l_linenumber % 2 as bigint)",
    "px": "case when l_returnflag = 'A' then 1 else 0 end",
    "py": "case when l_returnflag = 'R' then 60 when l_returnflag = 'A' then 2 else 0 end",
    "score": "((l_orderkey * 37 + l_partkey) % 1000) / cast(1000.0 as double)",
}


def ships(spark: SparkSession, sf_dir: str, score: str = SHIP_COLUMNS["score"]) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")
    return spread(used, "l_orderkey").selectExpr(
        *[f"{v} as {k}" for k, v in {**SHIP_COLUMNS, "score": score}.items()])


def _segments(df: DataFrame, x: str, y: str, extra: tuple[str, ...]) -> DataFrame:
    return (df.selectExpr("image_id", *extra, "x1", "y1", "hgt", "slant", "px", "py",
                          "explode(sequence(0L, w - 1)) as k")
            .selectExpr("image_id", *extra, f"{x} + k as col", f"{y} + k * slant as r0", f"{y} + k * slant + hgt as r1"))


def truth_segments(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return _segments(ships(spark, sf_dir), "x1", "y1", extra)


def pred_segments(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The same ships seen by an imperfect model: some exact, some shifted, some displaced."""
    return _segments(ships(spark, sf_dir), "(x1 + px)", "(y1 + py)", extra)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ship with its RLE text, one row without text per shipless image."""
    ship = ships(spark, sf_dir).selectExpr(
        "image_id", "ship_id",
        f"array_join(transform(sequence(0L, w - 1), k -> concat((x1 + k) * {H} + y1 + k * slant + 1, ' ', hgt)), ' ') as rle")
    empty = table(spark, sf_dir, "orders").join(
        ship.select(F.col("image_id").alias("o_orderkey")), "o_orderkey", "left_anti").selectExpr(
        "o_orderkey as image_id", "cast(null as bigint) as ship_id",
        "case o_orderstatus when 'F' then '' when 'P' then '0' end as rle")
    return ship.unionByName(empty)


def boxes(spark: SparkSession, sf_dir: str, score: str = SHIP_COLUMNS["score"]) -> DataFrame:
    """Predicted boxes with score."""
    return ships(spark, sf_dir, score).selectExpr(
        "image_id", "ship_id as box_id", "x1 + px as x1", "y1 + py as y1", "x1 + px + w as x2",
        "y1 + py + (w - 1) * slant + hgt as y2", "score")


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ships(spark, sf_dir).selectExpr(
        "image_id", "ship_id as gt_id", "x1", "y1", "x1 + w as x2", "y1 + (w - 1) * slant + hgt as y2")


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and labelled rows: quality label, score from the text length."""
    return (table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
            .selectExpr("doc_id", "quality as label", "least(n_chars, 5000) / cast(5000.0 as double) as prob"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "user_id as image_id", "(value - 50) / cast(25.0 as double) as logit",
        "cast(event_type = 'error' as int) as target")


def patch_scores(spark: SparkSession, sf_dir: str, patch: int = 224, overlap: int = 32, place: bool = False) -> DataFrame:
    """A score for every grid tile of every image; with ``place`` images are dealt out before their tiles unfold."""
    from runmosaic.operators import tiles
    img = images(spark, sf_dir)
    return tiles.grid(spread(img, "image_id") if place else img, patch, overlap, "none").selectExpr(
        "image_id", "row", "col", "height", "width",
        "((image_id * 17 + row * 3 + col * 5) % 100) / cast(100.0 as double) as confidence")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as image", "case o_orderstatus when 'F' then 'success' when 'O' then 'no_valid_patches' "
        "else 'error' end as status", "(o_orderkey % 97) / cast(10.0 as double) as seconds", "o_custkey % 7 as ships")


def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as image_id", "cast(10 as double) as a", "cast(0 as double) as b",
        "cast(o_orderkey * 10000 as double) as c", "cast(0 as double) as d", "cast(-10 as double) as e",
        "cast(5000000 as double) as f")


# --- the same views for DuckDB ------------------------------------------------------------

def _ships_sql() -> str:
    return "ships AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SHIP_COLUMNS.items()) + " FROM lineitem)"


SQL = {
    "images": "images AS (SELECT o_orderkey AS image_id, 768::BIGINT AS height, 768::BIGINT AS width FROM orders)",
    "ships": _ships_sql(),
    "truth": "truth AS (SELECT image_id, ship_id, score, x1 + k AS col, y1 + k * slant AS r0, y1 + k * slant + hgt AS r1 "
             "FROM (SELECT *, unnest(range(w)) AS k FROM ships))",
    "pred": "pred AS (SELECT image_id, ship_id, score, x1 + px + k AS col, y1 + py + k * slant AS r0, "
            "y1 + py + k * slant + hgt AS r1 FROM (SELECT *, unnest(range(w)) AS k FROM ships))",
    "tpx": "tpx AS (SELECT DISTINCT image_id, col, unnest(range(r0, r1)) AS row FROM truth)",
    "ppx": "ppx AS (SELECT DISTINCT image_id, col, unnest(range(r0, r1)) AS row FROM pred)",
    "manifest": "manifest AS (SELECT image_id, ship_id, list_aggregate(list_transform(range(w), lambda k: "
                "((x1 + k) * 768 + y1 + k * slant + 1)::VARCHAR || ' ' || hgt::VARCHAR), 'string_agg', ' ') AS rle FROM ships "
                "UNION ALL SELECT o_orderkey, NULL, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN '0' END FROM orders "
                "WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))",
    "boxes": "boxes AS (SELECT image_id, ship_id AS box_id, x1 + px AS x1, y1 + py AS y1, x1 + px + w AS x2, "
             "y1 + py + (w - 1) * slant + hgt AS y2, score FROM ships)",
    "gt": "gt AS (SELECT image_id, ship_id AS gt_id, x1, y1, x1 + w AS x2, y1 + (w - 1) * slant + hgt AS y2 FROM ships)",
    "classifier": "classifier AS (SELECT doc_id, quality AS label, least(n_chars, 5000) / 5000.0::DOUBLE AS prob "
                  "FROM labels JOIN documents USING (doc_id))",
    "logits": "logits AS (SELECT event_id AS id, user_id AS image_id, (value - 50) / 25.0::DOUBLE AS logit, "
              "(event_type = 'error')::INT AS target FROM events)",
    "tiles": "tiles AS (SELECT image_id, r * 192 AS row, c * 192 AS col, 224 AS height, 224 AS width FROM images, "
             "range(3) a(r), range(3) b(c))",
    "scores": "scores AS (SELECT *, ((image_id * 17 + row * 3 + col * 5) % 100) / 100.0::DOUBLE AS confidence FROM tiles)",
    "runlog": "runlog AS (SELECT o_orderkey AS image, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN "
              "'no_valid_patches' ELSE 'error' END AS status, (o_orderkey % 97) / 10.0::DOUBLE AS seconds, "
              "o_custkey % 7 AS ships FROM orders)",
}

NEEDS = {
    "truth": ["ships"], "pred": ["ships"], "tpx": ["truth"], "ppx": ["pred"], "manifest": ["ships"],
    "boxes": ["ships"], "gt": ["ships"], "tiles": ["images"], "scores": ["tiles"],
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views and whatever they build on as leading CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        need(v)
    ctes = ", ".join(SQL[n] for n in order)
    body = body.strip()
    more = body[5:] if body.upper().startswith("WITH ") else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ctes + (", " + more if more is not None else " " + body)
