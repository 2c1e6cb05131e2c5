"""Registered pixel queries. Every customer row is one 64 x 64 RGB image drawn from its numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from runmosaic.operators import images as I
from runmosaic.operators import sampling as P
from runmosaic.operators import scores as C
from runmosaic.operators import scoring as D
from runmosaic.operators import stitch as G
from runmosaic.plans import views as V
from runmosaic.plans.registry import registry
from runmosaic.plans.report_queries import ratio
from runmosaic.session import image_batches, shared_path

QUERIES, ORACLE, query = registry()

SIDE = 64


_drawn: dict[tuple[str, str], str] = {}


def rendered(spark, sf_dir):
    """The image table, drawn once per application and read by all queries."""
    image_batches(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _drawn:
        path = shared_path(spark, "images")
        drawn(spark, sf_dir).write.parquet(path)
        _drawn[key] = path
    return spark.read.parquet(_drawn[key])


def drawn(spark, sf_dir):
    """Patterned background with two bright rectangles; every tenth image is uniform."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j, b = np.meshgrid(np.arange(SIDE), np.arange(SIDE), np.arange(3), indexing="ij")
        for pdf in batches:
            out = []
            for k in pdf["image_id"]:
                if k % 10 == 0:
                    a = np.full((SIDE, SIDE, 3), 60, np.int64)
                else:
                    a = (i * 7 + j * 13 + b * 29 + k * 31) % 50 + 50
                    y, x, s = k * 17 % 40, k * 23 % 40, 8 + k % 12
                    a[y:y + s, x:x + s] = 255
                    y, x = k * 29 % 44, k * 37 % 44
                    a[y:y + 6, x:x + 6] = 220
                out.append(a.astype(np.uint8).tobytes())
            yield pdf.assign(height=SIDE, width=SIDE, channels=3, data=out)

    src = V.spread(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id")), "image_id")
    return src.mapInPandas(run, "image_id bigint, height int, width int, channels int, data binary")


IMG = """WITH px AS (SELECT c_custkey AS image_id, i, j, b, CASE WHEN c_custkey % 10 = 0 THEN 60
   WHEN i >= c_custkey * 29 % 44 AND i < c_custkey * 29 % 44 + 6 AND j >= c_custkey * 37 % 44 AND j < c_custkey * 37 % 44 + 6 THEN 220
   WHEN i >= c_custkey * 17 % 40 AND i < c_custkey * 17 % 40 + 8 + c_custkey % 12 AND j >= c_custkey * 23 % 40 AND j < c_custkey * 23 % 40 + 8 + c_custkey % 12 THEN 255
   ELSE (i * 7 + j * 13 + b * 29 + c_custkey * 31) % 50 + 50 END AS v FROM customer, range(64) x(i), range(64) y(j), range(3) z(b))"""
TILES = """, og AS (SELECT * FROM (VALUES (0, 0, 0), (0, 0, 24), (0, 24, 0), (0, 24, 24), (1, 0, 32), (1, 24, 32), (2, 32, 0), (2, 32, 24), (3, 32, 32)) t(pass, row, col)),
  tl AS (SELECT image_id, pass, row, col, stddev_pop(v) AS std, avg(v) AS mean, sum((v > 200)::INT) / 3072.0::DOUBLE AS bright FROM px JOIN og ON i >= row AND i < row + 32 AND j >= col AND j < col + 32
    GROUP BY ALL HAVING stddev_pop(v) >= 1.0)"""


@query("image_bytes", IMG + " SELECT image_id, 64 AS height, 64 AS width, sum(v)::BIGINT AS total, sum(v * ((i * 64 + j) * 3 + b))::BIGINT AS weighted FROM px GROUP BY image_id")
def image_bytes(spark, sf_dir):
    return I.byte_sums(rendered(spark, sf_dir))


@query("image_tiles", IMG + TILES + " SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pass, row, col) - 1 AS patch_id, row, col, round(std, 6) AS std FROM tl")
def image_tiles(spark, sf_dir):
    t = I.extract_tiles(rendered(spark, sf_dir), 32, 8, "reference", 1.0)
    return t.select("image_id", "patch_id", "row", "col", F.round("std", 6).alias("std"))


@query("image_scores", IMG + TILES + " SELECT image_id, row, col, round(mean / 255, 9) AS probability, mean / 255 >= 0.4 AS has_ship FROM tl")
def image_scores(spark, sf_dir):
    t = I.extract_tiles(rendered(spark, sf_dir), 32, 8, "reference", 1.0)
    s = t.withColumn("probability", D.score_udf(D.mean_brightness, 32)("data"))
    return s.select("image_id", "row", "col", F.round("probability", 9).alias("probability"), (F.col("probability") >= 0.4).alias("has_ship"))


@query("scorer_evaluation", IMG + TILES + f""", e AS (SELECT (bright > 0.1)::INT AS label, (mean / 255 > 0.4)::INT AS predicted FROM tl),
  k AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
   count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM e)
  SELECT tp, fp, fn, tn, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall FROM k""")
def scorer_evaluation(spark, sf_dir):
    """One model gives the labels, another is rated against them."""
    t = I.extract_tiles(rendered(spark, sf_dir), 32, 8, "reference", 1.0)
    s = t.select(D.score_udf(D.mean_brightness, 32)("data").alias("prob"), D.score_udf(D.bright_share(200), 32)("data").alias("share"))
    s = s.withColumn("label", (F.col("share") > 0.1).cast("int"))
    return C.rates(C.confusion(C.predicted(s, 0.4))).select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall")


@query("segmenter_evaluation", IMG + """, p AS (SELECT image_id, i, j, avg(v) > 200 AS m, avg(v) > 240 AS t FROM px GROUP BY ALL),
  n AS (SELECT image_id, count(*) FILTER (m AND t)::DOUBLE AS tp, count(*) FILTER (m AND NOT t)::DOUBLE AS fp, count(*) FILTER (t AND NOT m)::DOUBLE AS fn FROM p GROUP BY image_id)
  SELECT image_id, tp, fp, fn, 4096 - tp - fp - fn AS tn, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 9) AS iou, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 9) AS dice FROM n""")
def segmenter_evaluation(spark, sf_dir):
    """A segmenter with a low threshold against the mask of a high one."""
    img, ids = rendered(spark, sf_dir), V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    tiles = I.extract_tiles(img, SIDE, 0, "none", 1.0)
    truth = G.stitch_dense(tiles.select("image_id", "row", "col", F.lit(1.0).alias("confidence"), F.col("patch_id").alias("seq"), D.mask_udf(D.bright_mask(240), SIDE)("data").alias("mask")),
                           SIDE, 0, SIDE, SIDE)
    m = D.evaluate_segmenter(img, D.mask_udf(D.bright_mask(200), 32)("data"), truth, (SIDE, SIDE), 32, 8, "cover", 1.0, ids=ids)
    return m.select("image_id", "tp", "fp", "fn", "tn", F.round("iou", 9).alias("iou"), F.round("dice", 9).alias("dice"))


SUMS = "count(*)::BIGINT AS n, sum(v)::BIGINT AS total, sum(v * ((i * {w} + j) * 3 + b))::BIGINT AS weighted"


@query("image_resize", IMG + """, s AS (SELECT image_id, i // 2 AS i, j // 2 AS j, b, round_even(avg(v), 0)::BIGINT AS v FROM px GROUP BY ALL)
  SELECT image_id, 32 AS height, 32 AS width, sum(v)::BIGINT AS total, sum(v * ((i * 32 + j) * 3 + b))::BIGINT AS weighted FROM s GROUP BY image_id""")
def image_resize(spark, sf_dir):
    return I.byte_sums(I.resize_images(rendered(spark, sf_dir), 32, 32))


@query("image_windows", IMG + """, w AS (SELECT image_id, oi AS row, oj AS col, (i - oi) // 2 AS i, (j - oj) // 2 AS j, b, round_even(avg(v), 0)::BIGINT AS v FROM px, (SELECT unnest([0, 16, 32]) AS oi), (SELECT unnest([0, 16, 32]) AS oj)
   WHERE i >= oi AND i < oi + 32 AND j >= oj AND j < oj + 32 GROUP BY ALL)
  SELECT image_id, row, col, 16 AS height, 16 AS width, sum(v)::BIGINT AS total, sum(v * ((i * 16 + j) * 3 + b))::BIGINT AS weighted FROM w GROUP BY ALL""")
def image_windows(spark, sf_dir):
    return I.byte_sums(I.windows_to_patches(rendered(spark, sf_dir), 32, 16, 16), keep=("row", "col"))


def _digit(i: int) -> str:
    return f"('0x' || substr(md5('3:1:' || image_id), {i}, 1))::INT"


@query("image_augment", IMG + f""", p AS (SELECT DISTINCT image_id, {_digit(1)} < 8 AS hf, {_digit(2)} < 8 AS vf, {_digit(3)} % 4 AS t FROM px),
  f AS (SELECT image_id, t, CASE WHEN vf THEN 63 - i ELSE i END AS r, CASE WHEN hf THEN 63 - j ELSE j END AS c, b, v FROM px JOIN p USING (image_id)),
  g AS (SELECT image_id, CASE t WHEN 0 THEN r WHEN 1 THEN 63 - c WHEN 2 THEN 63 - r ELSE c END AS i, CASE t WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 63 - c ELSE 63 - r END AS j, b, v FROM f)
  SELECT image_id, 64 AS height, 64 AS width, sum(v)::BIGINT AS total, sum(v * ((i * 64 + j) * 3 + b))::BIGINT AS weighted FROM g GROUP BY image_id""")
def image_augment(spark, sf_dir):
    img = rendered(spark, sf_dir)
    return I.byte_sums(I.augment_images(img, P.augment_plan(img.select("image_id"), 3, 1)))


def _u(tag: str) -> str:
    return f"(('0x' || substr(md5(md5('5:' || image_id) || '{tag}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 2 - 1)"


@query("image_jitter", IMG + f""", p AS (SELECT image_id, 1 + {_u(':c')} * 0.2::DOUBLE AS a, {_u(':b')} * 0.2::DOUBLE AS s FROM (SELECT DISTINCT image_id FROM px)),
  g AS (SELECT image_id, i, j, b, least(greatest(round_even(v * a + 255 * s, 0), 0), 255)::BIGINT AS v FROM px JOIN p USING (image_id))
  SELECT image_id, 64 AS height, 64 AS width, sum(v)::BIGINT AS total, sum(v * ((i * 64 + j) * 3 + b))::BIGINT AS weighted FROM g GROUP BY image_id""")
def image_jitter(spark, sf_dir):
    return I.byte_sums(I.jitter_images(rendered(spark, sf_dir), 5))


BOX = "greatest(image_id * 17 % 40 - 3, 0) AS y1, greatest(image_id * 23 % 40 - 3, 0) AS x1, least(image_id * 17 % 40 + 11, 64) AS y2, least(image_id * 23 % 40 + 11, 64) AS x2"


@query("image_crops", IMG + f""", q AS (SELECT DISTINCT image_id, {BOX} FROM px)
  SELECT image_id, 1 AS id, (y2 - y1)::INT AS height, (x2 - x1)::INT AS width, sum(v)::BIGINT AS total, sum(v * (((i - y1) * (x2 - x1) + j - x1) * 3 + b))::BIGINT AS weighted
  FROM px JOIN q USING (image_id) WHERE i >= y1 AND i < y2 AND j >= x1 AND j < x2 GROUP BY image_id, y1, y2, x1, x2""")
def image_crops(spark, sf_dir):
    img = rendered(spark, sf_dir)
    boxes = img.selectExpr(
        "image_id", "1 as id", "greatest(image_id * 17 % 40 - 3, 0) as y1", "greatest(image_id * 23 % 40 - 3, 0) as x1",
        "least(image_id * 17 % 40 + 11, 64) as y2", "least(image_id * 23 % 40 + 11, 64) as x2")
    return I.byte_sums(I.crop_images(img, boxes), keep=("id",))


@query("detector_rows", IMG + """, m AS (SELECT image_id, i, j, avg(v) AS g FROM px GROUP BY ALL HAVING avg(v) > 200),
  isl AS (SELECT image_id, min(p) AS s, max(p) + 1 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS k FROM (SELECT image_id, j * 64 + i AS p FROM m)) GROUP BY image_id, k),
  t AS (SELECT image_id, string_agg((s + 1)::VARCHAR || ' ' || (e - s)::VARCHAR, ' ' ORDER BY s) AS rle FROM isl GROUP BY image_id)
  SELECT c_custkey AS image_id, coalesce(rle, '') AS rle, (rle IS NOT NULL)::INT AS num_ships, x1, y1, x2, y2 FROM customer LEFT JOIN t ON t.image_id = c_custkey
  LEFT JOIN (SELECT image_id, min(j)::DOUBLE AS x1, min(i)::DOUBLE AS y1, (max(j) + 1)::DOUBLE AS x2, (max(i) + 1)::DOUBLE AS y2 FROM m GROUP BY image_id) b ON b.image_id = c_custkey""")
def detector_rows(spark, sf_dir):
    d = D.detect(rendered(spark, sf_dir), D.bright_detector(200))
    at = lambda i: F.get(F.get("boxes", F.lit(0)), F.lit(i))
    return d.select("image_id", F.coalesce(F.get("rle_masks", F.lit(0)), F.lit("")).alias("rle"), "num_ships", *[at(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def run_cascade(spark, sf_dir):
    return D.cascade(rendered(spark, sf_dir), D.score_udf(D.bright_share(200), 32)("data"), D.mask_udf(D.bright_mask(200), 32)("data"),
                     (SIDE, SIDE), 32, 8, 0.01, "reference", 1.0, 10, ids=V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id")))


@query("cascade_instances")
def cascade_instances(spark, sf_dir):
    return run_cascade(spark, sf_dir)["instances"]


@query("cascade_log")
def cascade_log(spark, sf_dir):
    return run_cascade(spark, sf_dir)["log"]
