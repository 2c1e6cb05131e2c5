"""Registered evaluation reports, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from runmosaic.functions import expr as X
from runmosaic.operators import masks as M
from runmosaic.operators import metrics as S
from runmosaic.operators import scores as C
from runmosaic.plans import views as V
from runmosaic.plans.registry import registry
from runmosaic.plans.views import PIXELS, sql

QUERIES, ORACLE, query = registry()


def r9(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 9))
    return df


METRIC_SQL = """
 n AS (SELECT image_id, count(t.row) AS nt, count(p.row) AS np, count(CASE WHEN t.row IS NOT NULL AND p.row IS NOT NULL THEN 1 END) AS nb
   FROM tpx t FULL JOIN ppx p USING (image_id, col, row) GROUP BY image_id),
 b AS (SELECT image_id, coalesce(nb, 0)::DOUBLE AS tp, coalesce(np - nb, 0)::DOUBLE AS fp, coalesce(nt - nb, 0)::DOUBLE AS fn
   FROM images LEFT JOIN n USING (image_id)),
 m0 AS (SELECT *, 589824.0::DOUBLE - tp - fp - fn AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
   CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM b),
 m AS (SELECT *, (tp + 1e-6::DOUBLE) / (tp + fp + fn + 1e-6::DOUBLE) AS iou, (2 * tp + 1e-6::DOUBLE) / (2 * tp + fp + fn + 1e-6::DOUBLE) AS dice,
   (tp + tn) / 589824.0::DOUBLE AS pixel_acc,
   CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM m0)"""
LONG = "l AS (UNPIVOT (SELECT iou, dice, pixel_acc, precision, recall, f1, tp, fp, fn, tn FROM m) ON COLUMNS(*) INTO NAME metric VALUE value)"


def metrics_sql(body: str) -> str:
    return sql("images tpx ppx", "WITH " + METRIC_SQL + body)


def image_metrics(spark, sf_dir):
    return S.segmentation_metrics(V.images(spark, sf_dir), V.pred_segments(spark, sf_dir), V.truth_segments(spark, sf_dir), PIXELS)


RATES = ("iou", "dice", "pixel_acc", "precision", "recall", "f1")


@query("segmentation_metrics", metrics_sql(" SELECT image_id, tp, fp, fn, tn, " + ", ".join(RATES) + " FROM m"))
def segmentation_metrics(spark, sf_dir):
    return image_metrics(spark, sf_dir)


@query("segmentation_batch_means", metrics_sql(" SELECT round(avg(iou), 9) AS mean_iou, round(avg(dice), 9) AS mean_dice, "
       "round(avg(tp / (tp + fp + fn + 1e-6::DOUBLE)), 9) AS mean_iou_plain FROM m"))
def segmentation_batch_means(spark, sf_dir):
    return r9(S.batch_means(image_metrics(spark, sf_dir)), "mean_iou", "mean_dice", "mean_iou_plain")


@query("segmentation_summary", metrics_sql(", " + LONG + """ SELECT metric, count(*)::BIGINT AS n, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 9) AS min, round(max(value), 9) AS max FROM l GROUP BY metric"""))
def segmentation_summary(spark, sf_dir):
    df = r9(S.summary(image_metrics(spark, sf_dir)), "min", "max")
    return df.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("segmentation_error_report", metrics_sql(""", q AS (SELECT quantile_cont(iou, 0.25) AS q1, quantile_cont(iou, 0.5) AS q2,
   quantile_cont(iou, 0.75) AS q3 FROM m)
  SELECT count(*)::BIGINT AS total_samples, round(avg(iou), 9) AS mean_iou, round(stddev_samp(iou), 9) AS std_iou, round(avg(dice), 9) AS mean_dice,
   round(stddev_samp(dice), 9) AS std_dice, round(avg((iou < 0.5)::INT::DOUBLE), 9) AS failure_rate,
   count(*) FILTER (iou > 0.95)::BIGINT AS perfect_predictions, count(*) FILTER (iou < q1)::BIGINT AS poor_predictions,
   round(any_value(q1), 9) AS poor_threshold, round(any_value(q1), 9) AS q1, round(any_value(q2), 9) AS median, round(any_value(q3), 9) AS q3 FROM m, q"""))
def segmentation_error_report(spark, sf_dir):
    return r9(S.error_report(image_metrics(spark, sf_dir)), "mean_iou", "std_iou", "mean_dice", "std_dice", "failure_rate",
              "poor_threshold", "q1", "median", "q3")


@query("segmentation_histogram", metrics_sql(", " + LONG + """, s AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM l GROUP BY metric)
  SELECT metric, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30), 29) ELSE 15 END::INT AS bin, count(*)::BIGINT AS n
  FROM l JOIN s USING (metric) GROUP BY ALL"""))
def segmentation_histogram(spark, sf_dir):
    return S.histogram(image_metrics(spark, sf_dir))


@query("error_heatmap", sql("images tpx ppx", """WITH x AS ((SELECT * FROM tpx EXCEPT SELECT * FROM ppx) UNION ALL (SELECT * FROM ppx EXCEPT SELECT * FROM tpx))
  SELECT col, sum(row)::BIGINT AS row_sum, count(*)::BIGINT AS wrong,
   round(count(*) / (SELECT count(*) FROM images)::DOUBLE, 9) AS mean_error FROM x GROUP BY col"""))
def error_heatmap(spark, sf_dir):
    heat = S.error_heatmap(V.images(spark, sf_dir), V.pred_segments(spark, sf_dir), V.truth_segments(spark, sf_dir))
    n = F.col("r1") - F.col("r0")
    return heat.groupBy("col").agg(
        F.expr("sum(((r0 + r1 - 1) * (r1 - r0) div 2) * wrong)").alias("row_sum"), F.sum(n * F.col("wrong")).alias("wrong"),
        F.round(F.sum(F.col("mean_error") * n), 9).alias("mean_error"))


P = "1 / (1 + exp(-logit))"
SOFT = "ln(1 + exp(-abs(logit))) + greatest(-logit, 0)"


@query("losses", sql("logits", f"""WITH r AS (SELECT image_id, logit, target, {P} AS p, (1 - target) * logit + {SOFT} AS bce,
    (1 - target) * logit + (1 + 2.0::DOUBLE * target) * ({SOFT}) AS bw FROM logits),
  g AS (SELECT image_id, avg(bce) AS bce, avg(bw) AS bw, avg((0.25::DOUBLE * target + 0.75::DOUBLE * (1 - target)) * bce *
    pow(1 - (p * target + (1 - p) * (1 - target)), 2)) AS focal, sum(p * target) AS i, sum(p) AS a, sum(target) AS b FROM r GROUP BY image_id)
  SELECT image_id, round(bce, 6) AS bce, round(bw, 6) AS bce_weighted, round(focal, 6) AS focal,
   round(1 - (2 * i + 1e-5::DOUBLE) / (a + b + 1e-5::DOUBLE), 6) AS dice,
   round(0.5::DOUBLE * (1 - (2 * i + 1e-5::DOUBLE) / (a + b + 1e-5::DOUBLE)) + 0.5::DOUBLE * bce, 6) AS dice_bce,
   round(1 - i / (a + b - i + 1e-6::DOUBLE), 6) AS soft_iou FROM g"""))
def losses(spark, sf_dir):
    out = S.losses(V.logits(spark, sf_dir), pos_weight=3.0)
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "image_id"])


# --- classifier ----------------------------------------------------------------------------

PRED = "c AS (SELECT *, (prob > 0.5)::INT AS predicted FROM classifier)"
CONF = ("k AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, "
        "count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM c)")


def classified(spark, sf_dir):
    return C.predicted(V.classifier(spark, sf_dir))


def csql(body: str, extra: str = "") -> str:
    return sql("classifier", f"WITH {PRED}{extra} {body}")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END"


@query("confusion_counts", csql("SELECT * FROM k", ", " + CONF))
def confusion_counts(spark, sf_dir):
    return C.confusion(classified(spark, sf_dir))


@query("classifier_metrics", csql(f"""SELECT tp, fp, fn, tn, accuracy, precision, recall, specificity, npv,
   CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
   f", {CONF}, r AS (SELECT *, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision, "
   f"{ratio('tp', 'tp + fn')} AS recall, {ratio('tn', 'tn + fp')} AS specificity, {ratio('tn', 'tn + fn')} AS npv FROM k)"))
def classifier_metrics(spark, sf_dir):
    return C.rates(C.confusion(classified(spark, sf_dir)))


@query("roc_auc", csql("""SELECT round(sum(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 9) AS roc_auc
  FROM (SELECT prob FROM c WHERE label = 1) p, (SELECT prob FROM c WHERE label = 0) n"""))
def roc_auc(spark, sf_dir):
    return r9(C.roc_auc(V.classifier(spark, sf_dir)), "roc_auc")


@query("roc_points", csql("""SELECT 'infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
  SELECT t.prob, count(*) FILTER (c.label = 0) / (SELECT count(*) FROM c WHERE label = 0)::DOUBLE,
   count(*) FILTER (c.label = 1) / (SELECT count(*) FROM c WHERE label = 1)::DOUBLE
  FROM (SELECT DISTINCT prob FROM c) t JOIN c ON c.prob >= t.prob GROUP BY t.prob"""))
def roc_points(spark, sf_dir):
    return C.roc_points(V.classifier(spark, sf_dir))


@query("probability_histogram", csql("""SELECT label, bin, n, round(n * 30.0::DOUBLE / sum(n) OVER (PARTITION BY label), 9) AS density
  FROM (SELECT label, least(floor(prob * 30), 29)::INT AS bin, count(*)::BIGINT AS n FROM c GROUP BY ALL)"""))
def probability_histogram(spark, sf_dir):
    return r9(C.probability_histogram(V.classifier(spark, sf_dir)), "density")


@query("confusion_percent", csql("""SELECT label, predicted, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label) AS percent
  FROM (SELECT label, predicted, count(*)::BIGINT AS n FROM c GROUP BY ALL)"""))
def confusion_percent(spark, sf_dir):
    return C.confusion_percent(classified(spark, sf_dir))


@query("classification_report", csql(f"""SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
  FROM (SELECT label::VARCHAR AS class, precision, recall, f1, support FROM f UNION ALL
   SELECT 'accuracy', any_value(a), any_value(a), any_value(a), sum(support)::BIGINT FROM f, (SELECT avg((label = predicted)::INT) AS a FROM c) UNION ALL
   SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f UNION ALL
   SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)""",
   f""", p AS (SELECT y.label, count(*) FILTER (c.label = y.label AND c.predicted = y.label) AS hit, count(*) FILTER (c.predicted = y.label) AS said,
     count(*) FILTER (c.label = y.label) AS support FROM c, (SELECT unnest([0, 1]) AS label) y GROUP BY y.label),
   e AS (SELECT label, support, {ratio('hit', 'said')} AS precision, {ratio('hit', 'support')} AS recall FROM p),
   f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM e)"""))
def classification_report(spark, sf_dir):
    return r9(C.classification_report(classified(spark, sf_dir)), "precision", "recall", "f1")


ERR = ", e AS (SELECT *, CASE WHEN predicted = 1 THEN prob ELSE 1 - prob END AS confidence FROM c WHERE label <> predicted)"


@query("error_statistics", csql("""SELECT count(*)::BIGINT AS total_errors, count(*) FILTER (label = 0)::BIGINT AS false_positives,
  count(*) FILTER (label = 1)::BIGINT AS false_negatives, round(avg(confidence), 9) AS avg_error_confidence, max(confidence) AS max_error_confidence FROM e""", ERR))
def error_statistics(spark, sf_dir):
    return r9(C.error_statistics(classified(spark, sf_dir)), "avg_error_confidence")


@query("top_errors", csql("SELECT doc_id, label AS true_label, predicted AS predicted_label, prob AS prediction_prob, confidence FROM e "
                          "ORDER BY confidence DESC, doc_id LIMIT 20", ERR))
def top_errors(spark, sf_dir):
    return C.top_errors(classified(spark, sf_dir), 20, "doc_id").select(
        "doc_id", F.col("label").alias("true_label"), F.col("predicted").alias("predicted_label"),
        F.col("prob").alias("prediction_prob"), "confidence")


@query("error_confidence", csql("SELECT doc_id, CASE WHEN predicted = 1 THEN prob ELSE 1 - prob END AS confidence FROM c"))
def error_confidence(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", X.error_confidence("predicted", "prob").alias("confidence"))


THRESHOLDS = (0.1, 0.25, 0.3, 0.4, 0.5, 0.75, 0.9)


@query("threshold_sweep", csql(f"""SELECT threshold, tp, fp, fn, tn, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, precision, recall,
   {ratio('tn', 'tn + fp')} AS specificity, {ratio('tn', 'tn + fn')} AS npv,
   CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1
  FROM (SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall FROM (
   SELECT threshold, count(*) FILTER (label = 1 AND prob >= threshold) AS tp, count(*) FILTER (label = 0 AND prob >= threshold) AS fp,
    count(*) FILTER (label = 1 AND prob < threshold) AS fn, count(*) FILTER (label = 0 AND prob < threshold) AS tn
   FROM c, (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS threshold) GROUP BY threshold))"""))
def threshold_sweep(spark, sf_dir):
    return C.threshold_sweep(V.classifier(spark, sf_dir), THRESHOLDS)


@query("class_balance", sql("manifest", "SELECT split, count(*)::BIGINT AS rows, count(rle)::BIGINT AS positives, round(avg((rle IS NOT NULL)::INT), 9) AS positive_rate "
                            "FROM (SELECT *, CASE WHEN image_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM manifest) GROUP BY split"))
def class_balance(spark, sf_dir):
    df = V.manifest(spark, sf_dir).withColumn("label", X.has_ship("rle")).withColumn(
        "split", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train"))
    return r9(C.class_balance(df, split="split"), "positive_rate")


@query("class_weights", sql("classifier", "SELECT label, count(*)::BIGINT AS n, (CASE WHEN label = 1 THEN 2.5 ELSE 1.0 END)::DOUBLE * (1 / count(*)::DOUBLE) AS weight FROM classifier GROUP BY label"))
def class_weights(spark, sf_dir):
    return C.class_weights(V.classifier(spark, sf_dir), 2.5)


@query("submission_stats", sql("manifest", """SELECT count(DISTINCT image_id)::BIGINT AS total_images, count(*) FILTER (coalesce(rle, '') <> '')::BIGINT AS nonempty_rows,
  count(*)::BIGINT AS total_rows, count(DISTINCT CASE WHEN coalesce(rle, '') <> '' THEN image_id END)::BIGINT AS images_with_ships FROM manifest"""))
def submission_stats(spark, sf_dir):
    return C.submission_stats(V.manifest(spark, sf_dir))


@query("batch_summary", sql("runlog", """SELECT count(*)::BIGINT AS processed, count(*) FILTER (status = 'success')::BIGINT AS successful,
  count(*) FILTER (status <> 'success')::BIGINT AS failed, (sum(ships) FILTER (status = 'success'))::BIGINT AS total_ships,
  round(sum(seconds), 4) AS total_seconds, round(avg(seconds), 6) AS mean_seconds FROM runlog"""))
def batch_summary(spark, sf_dir):
    df = C.batch_summary(V.run_log(spark, sf_dir))
    return df.withColumn("total_seconds", F.round("total_seconds", 4)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("latency", sql("runlog", "SELECT round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS std, min(seconds) AS min, "
                      "max(seconds) AS max, round(1 / avg(seconds), 6) AS fps FROM runlog"))
def latency(spark, sf_dir):
    df = C.latency(V.run_log(spark, sf_dir))
    return df.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "fps") else c for c in df.columns])


@query("ship_statistics", sql("truth", """, a AS (SELECT sum(r1 - r0)::BIGINT AS area FROM truth GROUP BY image_id, ship_id)
  SELECT count(*)::BIGINT AS num_ships, sum(area)::DOUBLE AS total_area, round(avg(area), 6) AS mean_area, round(stddev_pop(area), 6) AS std_area,
   min(area)::DOUBLE AS min_area, max(area)::DOUBLE AS max_area, count(*) FILTER (area < 100)::BIGINT AS small,
   count(*) FILTER (area >= 100 AND area < 500)::BIGINT AS medium, count(*) FILTER (area >= 500)::BIGINT AS large FROM a""").replace(") , a AS", "), a AS"))
def ship_statistics(spark, sf_dir):
    keys = ("image_id", "ship_id")
    per = M.area(V.truth_segments(spark, sf_dir, "ship_id"), keys)
    df = C.ship_statistics(per)
    return df.withColumn("mean_area", F.round("mean_area", 6)).withColumn("std_area", F.round("std_area", 6))


# --- projections, filters, joins -----------------------------------------------------------

@query("has_ship", sql("manifest", "SELECT image_id, ship_id, (rle IS NOT NULL)::INT AS has_ship, 'images/' || image_id AS patch_path FROM manifest"))
def has_ship(spark, sf_dir):
    return V.manifest(spark, sf_dir).select("image_id", "ship_id", X.has_ship("rle").alias("has_ship"),
                                            X.image_path("images/", "image_id").alias("patch_path"))


@query("positives_only", sql("manifest", "SELECT image_id, ship_id FROM manifest WHERE rle IS NOT NULL"))
def positives_only(spark, sf_dir):
    from runmosaic.sources.manifest import positives
    return positives(V.manifest(spark, sf_dir)).select("image_id", "ship_id")


@query("positives_fallback", sql("manifest", "SELECT image_id, ship_id FROM manifest WHERE ship_id IS NULL"))
def positives_fallback(spark, sf_dir):
    """No positive row is present, so every row comes back."""
    from runmosaic.sources.manifest import positives
    none = V.manifest(spark, sf_dir).filter("ship_id is null").withColumn("rle", F.lit(None).cast("string"))
    return positives(none).select("image_id", "ship_id")


@query("score_filter", sql("scores", "SELECT image_id, row, col, confidence, confidence > 0.5 AS strict FROM scores WHERE confidence >= 0.5"))
def score_filter(spark, sf_dir):
    s = V.patch_scores(spark, sf_dir).filter(X.decide("confidence", 0.5))
    return s.select("image_id", "row", "col", "confidence", X.decide("confidence", 0.5, inclusive=False).alias("strict"))


@query("size_filter", sql("truth", "SELECT image_id, ship_id, area, CASE WHEN area < 100 THEN 'small' WHEN area < 500 THEN 'medium' ELSE 'large' END AS size_class "
                          "FROM (SELECT image_id, ship_id, sum(r1 - r0)::BIGINT AS area FROM truth GROUP BY ALL) WHERE area >= 50 AND area <= 50000"))
def size_filter(spark, sf_dir):
    a = M.area(V.truth_segments(spark, sf_dir, "ship_id"), ("image_id", "ship_id")).withColumn("area", F.col("area").cast("bigint"))
    return a.filter(X.size_filter("area", 50, 50000)).withColumn("size_class", X.size_class("area"))


@query("pixel_normalise", """SELECT event_id, round((v / 255.0::DOUBLE - 0.485) / 0.229, 9) AS red, round((v / 255.0::DOUBLE - 0.456) / 0.224, 9) AS green,
  round((v / 255.0::DOUBLE - 0.406) / 0.225, 9) AS blue, round(least(greatest((v / 255.0::DOUBLE - 0.5) * 8 * 0.229 + 0.485, 0), 1), 9) AS back
  FROM (SELECT event_id, value AS v FROM events)""")
def pixel_normalise(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", "value")
    return e.select("event_id", *[F.round(X.normalise("value", i), 9).alias(n) for i, n in enumerate(("red", "green", "blue"))],
                    F.round(X.denormalise((F.col("value") / 255 - 0.5) * 8, 0), 9).alias("back"))


@query("logit_decision", sql("logits", "SELECT id, round(1 / (1 + exp(-logit)), 9) AS probability, (1 / (1 + exp(-logit)) > 0.5)::INT AS predicted FROM logits"))
def logit_decision(spark, sf_dir):
    z = V.logits(spark, sf_dir).withColumn("p", X.sigmoid("logit"))
    return z.select("id", F.round("p", 9).alias("probability"), X.binarise("p").alias("predicted"))


@query("grey_binarise", "SELECT event_id, (value * 2.55::DOUBLE > 127)::INT AS bit FROM events")
def grey_binarise(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", X.binarise(F.col("value") * 2.55, 127).alias("bit"))


@query("uniform_filter", """SELECT user_id, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id HAVING stddev_pop(value) >= 25""")
def uniform_filter(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("std"))
    return e.filter("std >= 25").withColumn("std", F.round("std", 6))


@query("box_forms", sql("boxes", """SELECT image_id, box_id, x2 - x1 AS w, y2 - y1 AS h, greatest(x1 - 10, 0) AS px1, greatest(y1 - 10, 0) AS py1,
  least(x2 + 10, 768) AS px2, least(y2 + 10, 768) AS py2, round(x1 - (x2 - x1) * 0.05::DOUBLE, 6) AS ex1, round(y2 + (y2 - y1) * 0.05::DOUBLE, 6) AS ey2 FROM boxes"""))
def box_forms(spark, sf_dir):
    names = ("x1", "y1", "x2", "y2")
    b = V.boxes(spark, sf_dir).select("image_id", "box_id", *names, F.struct(*X.xyxy_to_xywh(*names)).alias("s"),
                                      F.struct(*X.pad_box(*names, 10, 768, 768)).alias("p"),
                                      F.struct(*X.expand_box(*names, 1.1)).alias("e"))
    back = F.struct(*X.xywh_to_xyxy("s.x", "s.y", "s.w", "s.h"))
    b = b.filter(back == F.struct(*[F.col(n) for n in names]))
    return b.select("image_id", "box_id", "s.w", "s.h", *[F.col(f"p.{n}").alias("p" + n) for n in names],
                    F.round("e.x1", 6).alias("ex1"), F.round("e.y2", 6).alias("ey2"))


@query("join_images_masks", sql("images manifest", "SELECT image_id, height, count(rle)::BIGINT AS masks FROM images LEFT JOIN manifest USING (image_id) GROUP BY ALL"))
def join_images_masks(spark, sf_dir):
    per = V.manifest(spark, sf_dir).groupBy("image_id").agg(F.count("rle").alias("masks"))
    return V.images(spark, sf_dir).join(per, "image_id", "left").select("image_id", "height", F.coalesce("masks", F.lit(0)).alias("masks"))


@query("join_predictions", sql("scores images", "SELECT image_id, row, col, confidence, height FROM scores JOIN images USING (image_id)").replace(
    "SELECT image_id, row, col, confidence, height FROM", "SELECT image_id, row, col, confidence, images.height AS height FROM"))
def join_predictions(spark, sf_dir):
    return V.patch_scores(spark, sf_dir).drop("height").join(V.images(spark, sf_dir), "image_id").select(
        "image_id", "row", "col", "confidence", "height")


@query("missing_images", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_images(spark, sf_dir):
    return V.images(spark, sf_dir).join(V.ships(spark, sf_dir), "image_id", "left_anti").select("image_id")


@query("split_members", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def split_members(spark, sf_dir):
    return V.images(spark, sf_dir).join(V.ships(spark, sf_dir).filter("hgt > 40"), "image_id", "left_semi").select("image_id")


@query("positive_subset", sql("scores", "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY row, col) - 1 AS patch_id, confidence "
                              "FROM scores QUALIFY confidence >= 0.7"))
def positive_subset(spark, sf_dir):
    from runmosaic.operators import tiles as T
    numbered = T.number_tiles(V.patch_scores(spark, sf_dir).withColumn("pass", F.lit(0)))
    return numbered.filter(X.decide("confidence", 0.7)).select("image_id", "patch_id", "confidence")
